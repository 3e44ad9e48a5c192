"""Decontamination, line alignment and the pipeline against brute force."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from paneloom.llm import decontaminate, linededup

PLAIN = re.compile(r"[^\W_]+")


def brute_leaks(docs, items, k=5, least=0.8):
    """Best similarity of each (document, item) over all windows."""
    out = {}
    for d, text in docs:
        words = PLAIN.findall((text or "").lower())
        for i, item in items:
            mine = PLAIN.findall((item or "").lower())
            n, size = min(k, len(mine)), len(mine)
            if not mine:
                continue
            target = Counter(tuple(mine[j : j + n]) for j in range(size - n + 1))
            all_windows = [tuple(words[j : j + n]) for j in range(len(words) - n + 1)]
            for s in range(len(words) - size + 1):
                window = Counter(all_windows[s : s + size - n + 1])
                common = sum((window & target).values())
                sim = common / (2 * (size - n + 1) - common)
                if sim >= least and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, s)
    return out


def leaks(df):
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in df.collect()}


def same(got, want):
    return got.keys() == want.keys() and all(abs(got[x][0] - want[x][0]) < 1e-12 for x in got)


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "w" + str(rnd.randrange(300))
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 6, 20, 60, 90])))) for i in range(12)] + [(50, None), (51, "..."), (52, " ".join(["la"] * 30))]
    docs = []
    for d in range(80):
        item = items[d % 12][1].split()
        if d % 3 == 0:
            item[rnd.randrange(len(item))] = "changed"
        body = [word() for _ in range(rnd.randrange(40))] + (item if d % 4 else []) + [word() for _ in range(rnd.randrange(40))]
        docs.append((d, " ".join(body).upper().replace("W1", "w1,")))
    docs += [(100, None), (101, ""), (102, " ".join(["la"] * 200)), (102, " ".join(["la"] * 200)), (103, " ".join(w for w in items[4][1].split() * 2))]
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("size", F.lit(2))
    right = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = leaks(decontaminate.contamination(left, right))
    want = brute_leaks(docs, items)
    assert want and same(got, want)
    assert decontaminate.contamination(left.where("false"), right).count() == 0
    assert decontaminate.contamination(left, right.where("false")).count() == 0


def test_leaks_of_tables(spark, sf_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute_leaks([(r["doc_id"], r["text"]) for r in sf_docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert want and same(leaks(decontaminate.contamination(sf_docs, items)), want)


def test_simhash_planes(spark):
    rnd = random.Random(1)
    rows = [([rnd.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 3, 31, 32, 63)]
    got = spark.createDataFrame(rows, "h array<long>").select("h", decontaminate.simhash(F.col("h"), 6).alias("fp")).collect()
    for r in got:
        bits = [x & (2**64 - 1) for x in r["h"]]
        assert r["fp"] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in bits) > len(bits))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(s):
    return signed(xxhash.xxh64_intdigest(s.encode(), 42))


def brute_lines(rows, min_words=4, rare_share=0.5):
    """(kept lines) of each (id, text), by dictionaries."""
    key = lambda d, t: (2**63 - 1 if d is None else d, hash_of(t))
    seeds, parsed = {}, {}
    for d, t in rows:
        ls = t.split("\n")
        telling = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= min_words for x in ls]
        parsed[key(d, t)] = (ls, telling)
        own = {("line", x) for x, y in zip(ls, telling, strict=True) if y}
        seeds.setdefault(key(d, t), own | ({("text", t)} if own else set()))
    holders = Counter()
    first = {}
    for k in (key(d, t) for d, t in rows):
        for s in seeds[k]:
            holders[s] += 1
            first[s] = min(first.get(s, k), k)
    limit = max(2.0, len(rows) * rare_share)
    gone = {}
    for k, own in seeds.items():
        for e in {first[s] for s in own if 1 < holders[s] <= limit and first[s] < k}:
            a = [hash_of(x) for x in parsed[e][0]]
            b = [hash_of(x) for x in parsed[k][0]]
            gone.setdefault(k, set()).update(linededup.common_blocks(a, b, parsed[k][1]))
    return {k: [x for i, x in enumerate(ls) if i not in gone.get(k, ())] for k, (ls, _) in parsed.items()}, key


def test_lines(any_docs):
    rows = [(r["doc_id"], r["text"]) for r in any_docs.collect()]
    want, key = brute_lines([(d, t or "") for d, t in rows])
    got = linededup.line_dedup(any_docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    expected = Counter((d, None if t is None else "\n".join(want[key(d, t)])) for d, t in rows)
    assert Counter((r["doc_id"], r["text"]) for r in got) == expected


def test_line_cases(spark):
    a = "one two three four five\nsix seven eight nine ten\nshort\nlast line of the first text"
    rows = [
        (1, a, "x"),
        (2, "something new in this text\nsix seven eight nine ten\nshort\nmore new words come here", "x"),
        (3, a, "x"),
        (4, "nothing shared at all here\nshort", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {r["doc_id"]: r for r in linededup.line_dedup(docs, rare_share=1.0).collect()}
    assert got[1]["text"] == a and got[4]["text"] == rows[3][1]
    assert got[2]["text"] == "something new in this text\nmore new words come here" and got[2]["n_deleted_lines"] == 2
    assert got[3]["text"] == "" and got[3]["n_lines"] == 4


@pytest.mark.parametrize("seed", range(20))
def test_patience(seed):
    rnd = random.Random(seed)
    a = [rnd.randrange(30) for _ in range(rnd.randrange(40))]
    b = [x for x in a if rnd.random() < 0.8]
    b[len(b) // 2 : len(b) // 2] = [99] * rnd.randrange(3)
    pairs = linededup.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert linededup.patience(a, a) == [(i, i) for i in range(len(a))]
