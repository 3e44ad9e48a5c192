import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from paneloom.llm import repeats


def brute(rows, length):
    """rows: list of bytes. Removed mask of each."""
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        mask = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i] += 1
                mask[i + length] -= 1
        out.append(np.cumsum(mask[:-1]) > 0 if len(t) else np.zeros(0, bool))
    return out


def expected(rows, length):
    out = []
    for (doc_id, t), gone in zip(rows, brute([t for _, t in rows], length), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)) if len(t) else 0
        out.append((str(doc_id), len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def tricky(spark):
    rnd = random.Random(7)
    text = lambda n, a="abcdeé ": "".join(rnd.choice(a) for _ in range(n))
    passage, long = text(60), text(300)
    rows = [long, long, long[:100] + "X" + long[101:], "pre" + passage + text(50), text(30) + passage, text(20) + passage[:45] + text(20)]
    rows += ["a" * 130, "ab" * 70, text(39), text(40), "z" * 41, "\0" * 45, passage + passage]
    rows += [text(rnd.randrange(80)) + passage[rnd.randrange(10) : 50 + rnd.randrange(10)] + text(rnd.randrange(80)) for _ in range(60)]
    rows += [long[: rnd.randrange(300)] + text(5) + long[rnd.randrange(300) :] for _ in range(40)]
    rows += [text(rnd.randrange(200), "ab") for _ in range(40)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("most_variants", [3, 4096])
@pytest.mark.parametrize("gram", [8, 20])
def test_tricky(tricky, gram, most_variants):
    rows = [(r["doc_id"], r["text"].encode()) for r in tricky.collect()]
    got = repeats.remove_repeats(tricky, length=40, gram=gram, batch_bytes=500, index_bytes=300, most_variants=most_variants)
    assert found(got) == expected(rows, 40)


def test_tables(any_docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in any_docs.collect()]
    assert found(repeats.remove_repeats(any_docs)) == expected(rows, 400)


def test_index():
    rnd = random.Random(1)
    for _ in range(30):
        parts = [bytes(rnd.choice(b"ab\0c") for _ in range(rnd.randrange(1, 60))) for _ in range(rnd.randrange(1, 12))]
        parts += [parts[0], parts[-1][:20] + b"c" + parts[0][:30]]
        length = rnd.randrange(2, 9)
        seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in parts]
        assert [s.tolist() for s in repeats.repeated_starts(parts, length)] == want


def passage_words(rows, words):
    """rows: list of str. How many words of each lie in ``words`` words that start elsewhere too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in rows]
    seen = Counter(tuple(t[i : i + words]) for t in split for i in range(len(t) - words + 1))
    return [len({k for i in range(len(t) - words + 1) if seen[tuple(t[i : i + words])] > 1 for k in range(i, i + words)}) for t in split]


@pytest.mark.parametrize("most_variants", [2, 4096])
@pytest.mark.parametrize("word_gram", [2, 6])
def test_short_passages(spark, word_gram, most_variants):
    """Passages of over 50 words with less than 400 bytes show, under other blanks and ids too."""
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["ab", "é", "cde", "x1", "\x1c", "　z"]) + str(rnd.randrange(50)) for _ in range(n))
    passage = text(55)
    assert len(passage.encode()) < 400
    rows = [f"{text(30)} {passage}\n{text(20)}" for _ in range(9)] + [text(40) + "\t" + passage.replace(" ", " \r\n\x0b"), passage, passage + "q", "q" + passage]
    rows += [" ".join(passage.split(" ")[:50]), passage.replace(" ", " "), " ".join(passage.split(" ")[4:]), "", None, " \n", text(300), "a " * 51, "a " * 60, text(51)]
    rows += [f"{text(9)} {' '.join(passage.split(' ')[k : k + 51])} {text(9)}" for k in range(5)] + [rows[0].replace(" ", "  ")]
    ids = [7, None, None, *range(len(rows) - 3)]
    docs = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string")
    got = repeats.remove_repeats(docs, word_gram=word_gram, batch_bytes=700, index_bytes=900, most_variants=most_variants)
    key = lambda r: (str(r[0]), *r[1:])
    want = [(i, len((t or "").encode()), n) for i, t, n in zip(ids, rows, passage_words([t or "" for t in rows], 51), strict=True)]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_passage_words"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert sum(n > 0 for *_, n in want) >= 20


def test_passages_of_tables(any_docs):
    rows = [(str(r["doc_id"]), r["text"] or "") for r in any_docs.collect()]
    want = sorted(zip([i for i, _ in rows], passage_words([t for _, t in rows], 51), strict=True))
    assert sorted((str(r["doc_id"]), r["n_passage_words"]) for r in repeats.remove_repeats(any_docs).collect()) == want


def test_index_of_numbers():
    rnd = random.Random(2)
    for _ in range(30):
        parts = [np.array([rnd.choice([0, 1, 70000]) for _ in range(rnd.randrange(1, 40))]) for _ in range(rnd.randrange(1, 8))]
        parts.append(parts[0])
        length = rnd.randrange(1, 6)
        seen = Counter(tuple(p[i : i + length]) for p in parts for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[tuple(p[i : i + length])] > 1] for p in parts]
        assert [s.tolist() for s in repeats.repeated_starts(parts, length)] == want


def test_large_index():
    """Too large for keys that carry their place."""
    rnd = np.random.default_rng(4)
    one, two = (rnd.integers(0, 256, 1_100_000, np.uint8).tobytes() for _ in range(2))
    two = two[:5000] + one[700:760] + two[5000:] + one[-40:]
    assert [s.tolist() for s in repeats.repeated_starts([one, two], 40)] == [[*range(700, 721), len(one) - 40], [*range(5000, 5021), len(two) - 40]]
