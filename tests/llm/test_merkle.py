"""The Merkle manifest against trees built level by level."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from paneloom.llm import merkle


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def way(tree, i):
    for level in tree[:-1]:
        a = i - i % 3
        yield level[a:i], level[i + 1 : a + 3]
        i //= 3


def brute_manifest(rows):
    leaf = lambda r, t: digest(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: levels([leaf(r, r["text"]) for r in by[s]]) for s in order}
    top, out = levels([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path, t = [*way(trees[s], i), *way(top, k)], r["text"]
            if r["doc_id"] is not None and t is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                t = t.replace("\n", "")
            h = leaf(r, t)
            for left, right in path:
                h = digest(*left, h, *right)
            proof = digest(*["".join(a + b) for a, b in path])
            out.append((r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], top[-1][0], proof, h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 6])
def test_depths(sf_docs, depth):
    got = merkle.manifest(sf_docs, depth=depth).drop("position").collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest([r.asDict() for r in sf_docs.collect()])


def test_manifest(any_docs):
    if "n_chars" not in any_docs.columns:
        any_docs = any_docs.withColumn("n_chars", F.col("fp"))
    got = merkle.manifest(any_docs, depth=2).drop("position").collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest([r.asDict() for r in any_docs.collect()])


def test_many_sources(sf_docs):
    docs = sf_docs.withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("ü"), "doc_id")))
    got = merkle.manifest(docs, depth=2).drop("position").collect()
    assert sorted(map(tuple, got), key=str) == brute_manifest([r.asDict() for r in docs.collect()])


def test_text_ids(spark):
    df = spark.createDataFrame([("b", None, None, 1, "x\ny"), ("a", "s", "en", None, None)], "doc_id string, source string, lang string, n_chars int, text string")
    assert {r["doc_id"] for r in merkle.manifest(df).collect()} == {"a", "b"}


def postorder(n, height):
    """(level, index) in completion order, by recursion."""
    sizes = merkle.level_sizes(n, 3, height)

    def below(level, index):
        if level:
            for i in range(3 * index, min(3 * index + 3, sizes[level - 1])):
                yield from below(level - 1, i)
        yield level, index

    return list(below(len(sizes) - 1, 0))


@pytest.mark.parametrize("height", [None, 4])
def test_positions(height):
    for n in range(1, 82):
        order = postorder(n, height)
        assert [merkle.position(level, i, n, 3, height) for level, i in order] == list(range(len(order)))
        leaves = [sha256(bytes([i])).digest() for i in range(n)]
        log = merkle.complete(leaves, 3, height)
        assert len(log) == 32 * len(order)
        assert [log[32 * k : 32 * k + 32] for k, (level, _) in enumerate(order) if level == 0] == leaves
        root = log[-32:].hex()
        assert all(merkle.fold(leaves[i].hex(), merkle.path_of(log, i, n, 3, height)) == root for i in range(n))


def test_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    for key in ("op11_source_mixing", "op13_merkle_manifest"):
        want = con.execute(entry.oracle_sql()[key]).df().sort_values("doc_id").reset_index(drop=True)
        got = entry.queries()[key](spark, folder).toPandas()[list(want.columns)].sort_values("doc_id").reset_index(drop=True)
        assert got.equals(want.astype(got.dtypes.to_dict())), key
