"""Alignment of two tokenizers against whole texts and plain counters."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paneloom.llm import alignment

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def brute_links(a, ends_a, b, ends_b):
    """All pairs of tokens whose bytes overlap, over all pairs of a short stretch."""
    spans = lambda ids, ends: list(zip(ids, [0, *ends[:-1]], ends))
    other, out, start = spans(b, ends_b), [], 0
    for i, s, e in spans(a, ends_a):
        while other[start][2] <= s:
            start += 1
        for k in range(start, len(other)):
            if other[k][1] >= e:
                break
            out.append((i, other[k][0]))
    return out


def brute_align(rows):
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    chars, count, found = alignment.byte_level(), Counter(), []
    for d, t in rows:
        kept = None
        if t:
            a, b = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
            bytes_a = [bytes(chars[c] for c in first.id_to_token(i)) for i in a]
            bytes_b = [alignment.piece_bytes(second.id_to_piece(i)) for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ends_a, ends_b = (np.cumsum(list(map(len, x))).tolist() for x in (bytes_a, bytes_b))
                groups, i, k = [], 0, 0
                for e in sorted(set(ends_a) & set(ends_b)):
                    i2, k2 = ends_a.index(e, i) + 1, ends_b.index(e, k) + 1
                    groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[k:k2])))
                    i, k = i2, k2
                links = brute_links(a, ends_a, b, ends_b)
                count.update(set(links))
                kept = len(a), len(b), groups, links
        found.append((d, kept))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for d, kept in found:
        if kept is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = kept
        hits = sum(count[x] == best[x[0]] for x in links)
        out.append((d, n_a, n_b, len(groups), len(links), hits, sum(count[x] for x in links), sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_texts():
    rnd = random.Random(3)
    alphabet = [*"ab c\n\n \t\r\x0b\x1c\x85\xa0'\"._<s>|", "  ", "▁", "<|endoftext|>", "</s>", "<0x0A>", "é", "é", "ﬁ", "½", "漢字", "👍🏽", "‍", " ", "　", "don't", " 12 345", "'ll"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 30))) for _ in range(1500)]
    return [(k, t) for k, t in enumerate(["", None, " ", "\n", "\n\n", " a", "a ", "a\n", "\na", "<unk>", "x" * 5000, *texts])]


def test_align(any_docs):
    got = alignment.align(any_docs, A, B).collect()
    assert sorted(map(tuple, got), key=str) == brute_align([(r["doc_id"], r["text"]) for r in any_docs.collect()])


@pytest.mark.parametrize("limits", [{}, {"chunk_docs": 7, "postings": 50, "chars": 100}])
def test_odd_texts_and_chunks(spark, limits):
    rows = odd_texts()
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, **limits).collect()
    want = brute_align(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert 500 < sum(r[1] > 0 for r in want) < len(want)


def test_text_ids_and_other_columns(spark):
    df = spark.createDataFrame([("x", "the cat", 1, 2), (None, "the dog", 3, 4), ("x", "the cat", 1, 2)], "doc_id string, text string, slot int, plane int")
    got = alignment.align(df, A, B).collect()
    assert sorted(map(tuple, got), key=str) == brute_align([("x", "the cat"), (None, "the dog"), ("x", "the cat")])


def test_bitmaps():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 100, 4095, 4096, 40_000, 65_536):
        slots = np.sort(rnd.choice(alignment.CHUNK, n, replace=False))
        bitmap = alignment.pack(slots)
        assert len(bitmap) <= alignment.BITSET and np.array_equal(alignment.unpack(bitmap), slots)


def test_planes(spark):
    """A pair's links come from its planes, its documents from plane 0."""
    docs = spark.createDataFrame([(1, "a a a a a"), (2, "a a"), (3, "b")], "doc_id long, text string")
    _, index = alignment.pair_index(docs, A, B)
    rows = sorted(alignment.pair_counts(index).collect(), key=lambda r: -r["links"])
    assert [(r["docs"], r["links"]) for r in rows] == [(2, 7), (1, 1)]


def test_latin_units_do_not_call_the_library_of_a():
    """Bare words and words after a line feed get the ids that the library gives; others still ask it."""
    path_a, path_b = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
    units = ["été,", "\nWas", "don't%%%", "\n42a", "<|endoftext|>", "x\u0301y", " a\tb", "\n\u4e2d", "ﬁ"]
    aligner, asked = alignment.Aligner(path_a, path_b), []
    library = aligner.a

    class Asked:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    aligner.a = Asked()
    new, ids, sizes = aligner._ids_a(units)
    assert sorted(new) == sorted(units) and sorted(asked) == sorted([" x\u0301y", " a\tb", "\n\u4e2d", " ﬁ"])
    at = 0
    for unit, n in zip(new, sizes.tolist(), strict=True):
        want = library.encode(unit if unit[0] in " \n" else " " + unit, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want, unit
        at += n
    assert at == len(ids)
