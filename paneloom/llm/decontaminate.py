"""Benchmark decontamination with SimHash windows, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import let
from paneloom.session import cut_lineage

#: Fingerprints are matched in 4 blocks of 16 bits.
BLOCKS, WIDTH = 4, 16


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order."""

    def windows(w: Column) -> Column:
        n = F.size(w) - (k - 1)
        columns = [F.slice(w, i + 1, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(k)]
        zipped = F.transform(F.arrays_zip(*columns), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(k)]))
        return F.when(n > 0, zipped).otherwise(F.array().cast("array<long>"))

    return let(words, windows)


def simhash(hashes: Column, planes: int) -> Column:
    """Bits set in over half of the hashes (at most ``2 ** planes - 1`` of them).

    All 64 counters run at once: plane p holds bit p of each counter, and a
    hash is added by carrying from plane to plane.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(f"p{i}") for i in range(planes)])

    def add(acc: Column, h: Column) -> Column:
        fields, carry = [], h
        for i in range(planes):
            fields.append(acc[f"p{i}"].bitwiseXOR(carry).alias(f"p{i}"))
            carry = acc[f"p{i}"].bitwiseAND(carry)
        return F.struct(*fields)

    def majority(acc: Column) -> Column:
        need = F.floor(F.size(hashes) / 2).cast("int") + 1
        more, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
        for i in reversed(range(planes)):
            bit = F.when(F.expr("1").cast("int").bitwiseAND(F.shiftright(need, i)) == 1, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
            plane = acc[f"p{i}"]
            more = more.bitwiseOR(equal.bitwiseAND(plane).bitwiseAND(F.bitwise_not(bit)))
            equal = equal.bitwiseAND(F.bitwise_not(plane.bitwiseXOR(bit)))
        return more.bitwiseOR(equal)

    return let(F.aggregate(hashes, zero, add), majority)


def _block(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, block * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    radius: int = 15,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, text_hash, item_id, similarity, distance, start_word, n_words``: the best window of each leak.

    An item of n words is compared with windows of n words of the documents; a
    document of fewer words is one window, compared with all its words.
    Windows that share no shingle with any item of their size have similarity
    0, so only windows around shared shingles are formed. Their SimHash
    fingerprints meet the items' by multi-index blocks: with 4 blocks of 16
    bits, two fingerprints within ``radius`` bits differ by at most
    ``radius // 4`` in some block, and the item side lists all block values
    that near, so no pair within the radius is missed. Candidates are verified
    by the exact weighted Jaccard similarity of their shingles, the weight of
    a shingle being how often it occurs.

    Words are lower-case runs of letters and digits; a shingle is ``shingle``
    words, for shorter items the whole item. Null and empty texts hold no
    windows, items without words match nothing, null ids are reported as null,
    equal windows: the first counts, repeated rows count once (rows equal in
    id and text; ``text_hash`` tells rows of one id, or without id, apart),
    empty tables give no rows, other columns are not read.

    Documents are read twice: once for shared shingles (against the
    benchmark's shingles, a written table that Spark broadcasts only below its
    size limit), once for those that hold any.
    """
    items = cut_lineage(
        benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.coalesce(F.col(item_text_col), F.lit(""))).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
    )
    spread = items.agg(F.max(F.size("words")), F.collect_set(F.least(F.size("words"), F.lit(shingle)))).first()
    longest, sizes = spread[0] or 1, sorted(spread[1] or [])
    planes = longest.bit_length()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    near = [sum(1 << b for b in c) for k in range(radius // BLOCKS + 1) for c in combinations(range(WIDTH), k)]
    out = None
    for k in sizes:
        own = items.where(F.least(F.size("words"), F.lit(shingle)) == k).select("item_id", F.size("words").alias("size"), shingle_hashes(F.col("words"), k).alias("hashes"))
        own = cut_lineage(own.withColumn("fp", simhash(F.col("hashes"), planes)))
        found = _matches(base, own, k, near, radius, planes, similarity)
        out = found if out is None else out.union(found)
    if out is None:
        kinds = (docs.schema[id_col].dataType, benchmark.schema[item_col].dataType)
        empty = docs.where("false").select(F.lit(None).cast(kinds[0]).alias("doc_id"), F.lit(None).cast(kinds[1]).alias("item_id"))
        return empty.selectExpr("doc_id", "0L as text_hash", "item_id", "0D as similarity", "0 as distance", "0 as start_word", "0 as n_words")
    return out


def _matches(base: DataFrame, items: DataFrame, k: int, near: list[int], radius: int, planes: int, similarity: float) -> DataFrame:
    lengths = cut_lineage(items.select("size", F.explode("hashes").alias("h")).groupBy("h").agg(F.collect_set("size").alias("sizes")))
    shared = base.select("doc_id", "th", plain_words(F.col("text")).alias("words")).select("doc_id", "th", F.size("words").alias("n"), F.posexplode(shingle_hashes(F.col("words"), k)).alias("pos", "h"))
    anchors = shared.join(lengths, "h").select("doc_id", "th", "n", "pos", F.explode("sizes").alias("size"))
    # a shorter document is one window; it can't be more similar than its share of the item's shingles
    anchors = anchors.where((F.col("size") <= F.col("n")) | ((F.col("n") - (k - 1)) / (F.col("size") - (k - 1)) >= similarity))
    # the run of window starts that cover an anchor
    runs = anchors.select("doc_id", "th", "size", F.greatest(F.col("pos") + k - F.col("size"), F.lit(0)).alias("lo"), F.least("pos", F.greatest(F.col("n") - F.col("size"), F.lit(0))).alias("hi"))
    starts = (
        runs.groupBy("doc_id", "th", "size")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
        .select("doc_id", "th", "size", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"])))).alias("starts"))
        .groupBy("doc_id", "th")
        .agg(F.collect_list(F.struct("size", "starts")).alias("wanted"))
    )
    starts = cut_lineage(starts)
    wanted = starts.select(F.col("doc_id").alias("id2"), F.col("th").alias("th2"), "wanted")
    # always by merge: a broadcast on small inputs would say nothing about large ones
    holders = base.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")))
    # words are cut after the join, for the holders alone
    holders = holders.select("doc_id", "th", plain_words(F.col("text")).alias("words"), "wanted").select("doc_id", "th", shingle_hashes(F.col("words"), k).alias("hashes"), "wanted")
    holders = holders.select("doc_id", "th", "hashes", F.inline("wanted")).select("doc_id", "th", "size", "hashes", F.explode("starts").alias("start"))
    cut = F.slice("hashes", F.col("start") + 1, F.col("size") - (k - 1))
    windows = holders.select("doc_id", "th", "size", "start", cut.alias("hashes"))
    windows = cut_lineage(windows.withColumn("fp", simhash(F.col("hashes"), planes)))

    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)])
    probes = windows.select("doc_id", "th", "size", "start", "fp", F.inline(blocks))
    masks = F.array(*[F.lit(m).cast("long") for m in near])
    index = cut_lineage(  # written, as Spark can't size a table before it is exploded
        items.select("item_id", "size", F.col("fp").alias("item_fp"), F.inline(blocks))
        .select("item_id", "size", "item_fp", "block", F.col("value").alias("centre"), F.explode(masks).alias("mask"))
        .select("item_id", "size", "item_fp", "block", F.col("centre").bitwiseXOR(F.col("mask")).alias("value"))
    )
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    candidates = (
        probes.join(index, ["size", "block", "value"])
        .select("doc_id", "th", "size", "start", "item_id", distance.alias("distance"))
        .where(F.col("distance") <= radius)
        .distinct()
    )
    window = windows.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("size").alias("s2"), F.col("start").alias("b2"), F.size("hashes").alias("have"), "hashes")
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("size") == F.col("s2")) & (F.col("start") == F.col("b2"))
    place = ["doc_id", "th", "size", "start", "item_id", "distance", "have"]
    counted = candidates.join(window.hint("merge"), same).select(*place, F.explode("hashes").alias("h")).groupBy(*place, "h").agg(F.count("*").alias("n"))
    weights = items.select("item_id", F.explode("hashes").alias("h")).groupBy("item_id", "h").agg(F.count("*").alias("m"))
    common = counted.join(weights, ["item_id", "h"]).groupBy(*place).agg(F.sum(F.least("n", "m")).alias("common"))
    both = F.col("have") + F.col("size") - (k - 1)
    scored = common.withColumn("similarity", F.col("common") / (both - F.col("common"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "th", "item_id").agg(
        F.max(F.struct(F.col("similarity"), (-F.col("distance")).alias("d"), (-F.col("start")).alias("s"), (F.col("have") + (k - 1)).alias("size"))).alias("best")
    )
    return best.select(
        "doc_id",
        F.col("th").alias("text_hash"),
        "item_id",
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.d")).alias("distance"),
        (-F.col("best.s")).alias("start_word"),
        F.col("best.size").alias("n_words"),
    )
