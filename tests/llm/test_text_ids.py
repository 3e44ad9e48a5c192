"""Ids that are texts give what number ids of the same order give."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from paneloom.llm import linededup, repeats, sharding


def named(docs):
    return docs.withColumn("doc_id", F.concat(F.lit("d-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")))


def rows(df):
    return Counter(map(str, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("apply", [linededup.line_dedup, repeats.remove_repeats], ids=["lines", "repeats"])
def test_same_rows(any_docs, apply):
    docs = any_docs.select("doc_id", "text").orderBy("doc_id")
    assert rows(apply(named(docs))) == rows(named(apply(docs)))


def test_shards(any_docs):
    got = sharding.shard(named(any_docs), shards=5).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in named(any_docs).collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
