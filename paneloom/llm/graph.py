"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links`` (a, b): root is the smallest node it can reach.

    Alternates two steps until nothing changes: hang larger neighbours on the
    smallest neighbour, then smaller ones. Both are a minimum by node (summed
    map-side) joined back, so a node with a third of all links is not one
    task's work. Each round is written; a lost executor costs one round.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        root = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(root, "u")
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct())
        after = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
