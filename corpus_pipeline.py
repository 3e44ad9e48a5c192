"""A training-text pipeline: toxicity, line and near deduplication, decontamination, packing."""

from __future__ import annotations

import os
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paneloom.llm import decontaminate, linededup, packing, simhash, toxicity  # noqa: E402
from paneloom.llm.queries import tokenizer  # noqa: E402
from paneloom.session import cut_lineage  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7.

    Rows are judged one by one: null and empty texts by the score of a text
    without matches, repeated rows alike, rows without id like others. An empty
    table gives none; columns beyond those of ``documents`` are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.scores(docs, toxicity.fit_grammar(docs, labels))
    return scored.where(F.col("toxicity") < 0.7).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks of earlier documents; those left without a word go, n_chars follows.

    Null texts and texts without a word from the start stay as they are; of
    repeated rows the first keeps its lines; an empty table gives none;
    columns beyond those of ``documents`` are dropped.
    """
    cleaned = linededup.line_dedup(docs)
    emptied = (F.col("n_deleted_lines") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    length = F.when(F.col("n_deleted_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(*COLUMNS)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of SimHash fingerprints (3-word shingles, links of at most 2 bits).

    First means the smallest id (null ids last), then the smallest hash of the
    text, so rows without an id stay if their class has no row with one. Rows
    equal in id and text are one document: the smallest of them stays. Null,
    empty and blank texts share one fingerprint, hence one row of them stays.
    An empty table gives none; columns beyond those of ``documents`` are dropped.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = simhash.near_classes(docs, shingle=3, radius=2).groupBy("root").agg(F.min(order).alias("first"))
    found = first.select(F.col("first.doc_id").alias("id2"), F.col("first.text_hash").alias("th2"))
    hashed = docs.withColumn("th", text_hash())
    kept = hashed.join(found, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left_semi")
    rows = kept.groupBy("doc_id", "th").agg(F.min(F.struct("text", *COLUMNS[2:])).alias("row"))
    return rows.select("doc_id", *[F.col("row")[c].alias(c) for c in COLUMNS[1:]])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is near a benchmark item.

    A row goes if its own text leaks, whatever its id: rows without id are
    judged too, and a clean row that shares its id with a leaking one stays.
    Null and empty texts stay, repeated rows share their fate, an empty table
    gives none, columns beyond those of ``documents`` are dropped.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.contamination(docs, benchmark).select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("th2")).distinct()
    hashed = docs.withColumn("th", text_hash())
    return hashed.join(leaks, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens.

    Null and empty texts are one piece with the end id; repeated rows and rows
    without id are packed like others; an empty table gives none; other
    columns are not read.
    """
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: Learned weights, alignment and token ids are not for SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again.

    What a stage does with nulls, empties, ties and repeats is said there; empty
    ``documents`` give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
