"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.ranges import prefix_sums
from paneloom.operators.verbs import attach
from paneloom.session import cut_lineage


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``source, source_size, top, bottom``: the target of a source is top / bottom words.

    ``sizes`` has one row per source (source, source_size). The sources, by
    code point with null last, weigh ``weights`` in turn. They divide
    ``share[0] / share[1]`` of all words by weight; a target stops at ``most``
    times its source's size and the rest is divided again among the others,
    until no target is above. That is a water level: with the sources in order
    of size per weight, the full ones are a prefix, and the level follows from
    the prefix sums of size and weight at the first source that is not full.
    All of it is one pass over ranges of sources, whatever their number.
    """
    placed = prefix_sums(sizes, [], [F.col("source").isNull(), "source"], {"__at": F.lit(1).cast("long")})
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    placed = placed.withColumn("__w", F.get(turn, F.pmod("__at", F.lit(len(weights))).cast("int")))
    filled = cut_lineage(
        prefix_sums(placed, [], [F.col("source_size") / F.col("__w"), "__at"], {"__size": "source_size", "__weight": "__w"})
    )
    whole = filled.agg(F.sum("source_size").alias("__sizes"), F.sum("__w").alias("__weights"))
    up, down = share
    # level at a source: (words to give - words of the full ones) / weight of the rest, as a fraction
    level = attach(filled, whole, []).selectExpr(
        "source", "source_size", "__w", "__at", f"__sizes * {up} - __size * {down * most} AS __top", f"(__weights - __weight) * {down} AS __bottom"
    )
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of words and weights pass 64 bits

    def above(top: str, bottom: str) -> Column:
        return wide(top) * F.col("__w") > wide("source_size") * most * F.col(bottom)

    open_ = level.where(~above("__top", "__bottom"))
    first = open_.agg(F.min_by(F.struct("__top", "__bottom"), F.struct(F.col("source_size") / F.col("__w"), "__at")).alias("__level"))
    fit = attach(level.select("source", "source_size", "__w"), first, [])
    full = F.col("__level").isNull() | above("__level.__top", "__level.__bottom")
    return fit.select(
        "source",
        "source_size",
        F.when(full, F.col("source_size") * most).otherwise(F.col("__level.__top") * F.col("__w")).alias("top"),
        F.when(full, F.lit(1).cast("long")).otherwise(F.col("__level.__bottom")).alias("bottom"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: words that a mix takes of each document.

    A document has a key at random: the MD5 of seed, id and text. Within its
    source the documents are put in order of the key by range partitions, with
    prefix sums of their words. The source's budget is its target in whole
    words. Full epochs take every document once; the last epoch takes documents
    in order up to the budget and cuts the one on its edge, so a source gives
    exactly its budget and a document at most ``most`` times its words. Reruns
    agree, whatever the partitions.

    Null and empty texts have no words and give none; a null id counts as an
    empty key part, a null source is a source; rows equal in id and text share
    a key and have equal sizes, so their order is of no matter but for the row
    at the edge; an empty table gives no rows; other columns are not read.
    Targets are double, computed as one division of whole numbers.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    lean = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("__key")))
    # size breaks no tie between different texts in practice; it makes rows of one key interchangeable
    ordered = prefix_sums(lean, ["source"], ["__key", "size"], {"__before": "size"})
    goal = cut_lineage(targets(lean.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    goal = goal.withColumns({"target": F.col("top") / F.col("bottom"), "__budget": F.expr("top div bottom")})
    goal = goal.withColumns({"__epochs": F.expr("CASE WHEN source_size > 0 THEN __budget div source_size ELSE 0 END")})
    goal = goal.withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("source_size"))
    met = attach(ordered, goal.drop("top", "bottom", "__budget"), ["source"])
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("__rest") - F.col("__before")))
    return met.select("doc_id", "source", "size", "source_size", "target", (F.col("__epochs") * F.col("size") + last).alias("taken"))
