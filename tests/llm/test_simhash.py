import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paneloom.llm import graph, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = WORD.findall(low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_roots(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_near_duplicates(any_docs):
    rows = [(r["doc_id"], brute_print(r["text"] or "")) for r in any_docs.collect()]
    prints = sorted({p for _, p in rows})
    linked = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2]
    root = brute_roots(prints, linked)
    low = {}
    for d, p in rows:
        if d is not None:
            low[root[p]] = min(d, low.get(root[p], d))
    want = sorted((str(d), f"{p:016x}", str(low.get(root[p]))) for d, p in rows)
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(any_docs).collect())
    assert got == want


@pytest.mark.parametrize("bucket_rows", [2, 48])
def test_crowded_buckets(spark, bucket_rows):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:5]:
        for _ in range(120):
            x = b
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(simhash._signed(p) for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = simhash.near_links(df, 2, bucket_rows=bucket_rows)
    links = [(r["a"], r["b"]) for r in got.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    arr = np.array(prints, np.int64).view(np.uint64)
    near = [(prints[i], prints[j]) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2) if i < j]
    want = brute_roots(prints, near)
    assert brute_roots(prints, links) == want
    nodes = {r["node"]: r["root"] for r in graph.components(got).collect()}
    assert all(want[n] == r for n, r in nodes.items())
    assert {n for n in prints if want[n] != n} <= set(nodes)


def test_allocation_guarantee():
    rnd = np.random.default_rng(4)
    sample = rnd.integers(0, 1 << 62, 300).astype(np.uint64)
    for radius in (0, 2, 4):
        groups, e = simhash.allocate(sample, 10_000, radius)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(e) == radius - len(groups) + 1


def test_hash_is_spark_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("ab cd ef")).alias("h")).first()
    assert row["h"] % 2**64 == xxhash.xxh64_intdigest(b"ab cd ef", 42)
