"""Each stage of the pipeline on its own input, against brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from test_pairs import brute_leaks, brute_lines
from test_rows import crc, encoded
from test_simhash import brute_print, brute_roots

from paneloom.llm import toxicity
from paneloom.session import cut_lineage

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = cut_lineage(spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS))
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = cut_lineage(stage(spark, docs, SF))
        if name != "pack":
            assert after.columns == corpus_pipeline.COLUMNS
        rows = [(r["doc_id"], r["text"]) for r in after.collect()] if name != "pack" else after.collect()
        if name == "toxicity":
            grammar = toxicity.fit_grammar(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert dict(rows).keys() == {r["doc_id"] for r in toxicity.scores(docs, grammar).where("toxicity < 0.7").collect()}
        elif name == "line_dedup":
            lines, key = brute_lines(before)
            want = {d: "\n".join(lines[key(d, t)]) for d, t in before}
            old = dict(before)
            assert dict(rows) == {d: t for d, t in want.items() if t == old[d] or t.strip()}
            assert {r["doc_id"]: r["n_chars"] for r in after.collect() if r["text"] != old[r["doc_id"]]} == {d: len(t) for d, t in rows if t != old[d]}
        elif name == "near_dedup":
            prints = sorted({brute_print(t) for _, t in before})
            root = brute_roots(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2])
            first = {}
            for d, t in before:
                r = root[brute_print(t)]
                first[r] = min(d, first.get(r, d))
            assert sorted(d for d, _ in rows) == sorted(first.values())
        elif name == "decontaminate":
            bad = {d for d, _ in brute_leaks(before, benchmark)}
            assert sorted(d for d, _ in rows) == sorted(d for d, _ in before if d not in bad)
        else:
            want = Counter()
            for d, ids in encoded(docs, "word_bpe_49k.json"):
                want.update((d, k, crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048)))
            assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == want
        docs = after


@pytest.mark.parametrize("kind", ["edge_docs", "empty_docs"])
def test_edges(spark, kind, request):
    docs = request.getfixturevalue(kind).selectExpr("doc_id", "text", "lang", "source", "cast(fp as long) as n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF))
        assert (docs.count() > 0) == (kind == "edge_docs"), name


def test_run_has_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_leaks_without_id(spark):
    """A leaking row goes and a clean row stays, also without id or with a shared id."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = " ".join(f"clean{k}" for k in range(80))
    rows = [(None, f"before {item} after"), (None, clean), (7, item), (7, clean + " seven"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "1 AS th")
    got = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_near_duplicates_without_id(spark):
    """One row of each class stays: the smallest id, else the row without id."""
    text = " ".join(f"word{k}" for k in range(90))
    other = " ".join(f"other{k}" for k in range(90))
    rows = [(5, text), (4, text), (None, text), (None, other), (None, other), (4, other + " tail of more words that differ quite a lot from all of the rest")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars", "1 AS root")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([rows[1], rows[3], rows[5]], key=str)
