"""Shards of near equal bytes from sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.common import number_of, ship
from paneloom.session import cut_lineage


def _below(splitters: list[bytes]):
    cuts = np.array([np.frombuffer(s, ">u8") for s in splitters], dtype=np.uint64).reshape(-1, 2)

    def find(h: pd.Series, i: pd.Series) -> pd.Series:
        hi = h.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        lo = i.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        at = np.searchsorted(cuts[:, 0], hi, "left")
        end = np.searchsorted(cuts[:, 0], hi, "right")
        for k in np.flatnonzero(at < end):  # splitters inside one hash: the id decides
            at[k] += np.searchsorted(cuts[at[k] : end[k], 1], lo[k], "right")
        return pd.Series(at.astype(np.int32))

    return find


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
    ranges_per_shard: int = 32,
    samples_per_range: int = 48,
    whole_group_share: float = 0.01,
) -> DataFrame:
    """Puts each row into one of ``shards`` ranges of near equal bytes.

    The key is (hash of the text, id), so equal texts are neighbours. A sample
    of keys, drawn with a chance in proportion to size, gives splitters of
    ``shards * ranges_per_shard`` fine ranges. Records are dealt to the ranges;
    exact byte totals of the ranges give each range its offset, and an overfull
    range, one that a shard boundary crosses, is subdivided at the record
    where the boundary falls. A group of equal texts that a boundary would cut
    moves whole to the shard of its middle if it holds at most
    ``whole_group_share`` of a shard's bytes; larger groups are divided by id.

    ``slot`` counts the rows of a shard from 0 in key order. Null texts count
    as empty; a null id sorts first; ids that are no whole numbers sort by a hash
    of their text; repeated rows are placed one by one, in any order among themselves; an empty table gives no rows; other columns
    are not read.

    Only (id, hash, size, checksum) moves, once. The driver sees the sample and
    one total for each range, both bounded by the parameters; no range holds
    more than its share of bytes, whatever the texts are.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lean = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(number_of(docs, id_col), F.lit(-(2**63)).cast("long")).alias("order_id"),
            F.xxhash64(text).alias("text_hash"),
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
    )
    total = lean.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    wanted = ranges * samples_per_range
    chance = F.abs(F.xxhash64(F.lit("sample"), "order_id", "text_hash") % (1 << 30)) / F.lit(float(1 << 30))
    drawn = lean.where(chance < F.col("size") * F.lit(wanted / max(total, 1))).select("text_hash", "order_id").distinct()
    sample = drawn.orderBy("text_hash", "order_id").toPandas()
    picks = sample.iloc[[len(sample) * k // ranges for k in range(1, ranges)]].drop_duplicates() if len(sample) else sample
    splitters = [
        (int(h) + (1 << 63)).to_bytes(8, "big") + (int(i) + (1 << 63)).to_bytes(8, "big") for h, i in picks.itertuples(index=False)
    ]
    range_of = F.pandas_udf(_below(splitters), "int")
    dealt = cut_lineage(lean.withColumn("range", range_of("text_hash", "order_id")))
    totals = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").collect()
    offsets, rows, size = [], 0, 0
    for r in totals:
        offsets.append((r["range"], size, rows))
        size, rows = size + r["bytes"], rows + r["rows"]
    starts = F.broadcast(spark.createDataFrame(offsets, "range int, byte_start long, row_start long"))

    within = Window.partitionBy("range").orderBy("text_hash", "order_id")
    target = max(total, 1) / shards
    middle = F.col("byte_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") / 2
    placed = cut_lineage(
        dealt.join(starts, "range").select(
            "doc_id",
            "text_hash",
            "size",
            "text_crc32",
            (F.col("row_start") + F.row_number().over(within) - 1).alias("place"),
            F.least(F.floor(middle / F.lit(target)), F.lit(shards - 1)).cast("int").alias("shard"),
            middle.alias("middle"),
        )
    )
    cut = (
        placed.groupBy("text_hash")
        .agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.sum("size").alias("bytes"), F.avg("middle").alias("centre"))
        .where((F.col("lo") < F.col("hi")) & (F.col("bytes") <= F.lit(target * whole_group_share)))
        .select("text_hash", F.least(F.floor(F.col("centre") / F.lit(target)), F.lit(shards - 1)).cast("int").alias("whole"))
    )  # at most one group for each of the inner boundaries
    moved = placed.join(F.broadcast(cut), "text_hash", "left").withColumn("shard", F.coalesce("whole", "shard"))
    first = moved.groupBy("shard").agg(F.min("place").alias("first"))
    return moved.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
