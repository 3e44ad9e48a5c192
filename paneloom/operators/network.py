"""Trade networks as edge and vertex tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneloom.operators.verbs import first_per_key, lookup
from paneloom.session import cut_lineage, drop_stage


def edges(flows: DataFrame, min_value: float | None = None, exporter: str | None = None, importer: str | None = None) -> DataFrame:
    """src, dst, weight: directed edges above a threshold, of all units or of one exporter / importer."""
    out = flows.where(F.col("value").isNotNull())
    if min_value is not None:
        out = out.where(F.col("value") > min_value)
    if exporter is not None:
        out = out.where(F.col("exporter") == exporter)
    if importer is not None:
        out = out.where(F.col("importer") == importer)
    return out.select(F.col("exporter").alias("src"), F.col("importer").alias("dst"), F.col("value").alias("weight"))


def vertices(edge_table: DataFrame) -> DataFrame:
    """Every unit at either end of an edge, from one pass over the edges."""
    return edge_table.select(F.explode(F.array("src", "dst")).alias("name")).distinct()


def degree(edge_table: DataFrame) -> DataFrame:
    """name, out_links, in_links: active links per unit, from one pass over the edges."""
    ends = F.array(
        F.struct(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return edge_table.select(F.inline(ends)).groupBy("name").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))


def geo_edges(edge_table: DataFrame, coords: DataFrame, key: str, order: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """Edges with the coordinates of both ends; the first coordinate of a repeated key is used."""
    points = first_per_key(coords.select(key, "lat", "lon"), [key], list(order))
    out = lookup(edge_table, points, {"src": key}, {"lat": "src_lat", "lon": "src_lon"})
    return lookup(out, points, {"dst": key}, {"lat": "dst_lat", "lon": "dst_lon"})


def bounding_box(coords: DataFrame) -> DataFrame:
    return coords.agg(
        F.min("lon").alias("left"), F.min("lat").alias("bottom"), F.max("lon").alias("right"), F.max("lat").alias("top")
    )


def connected_components(links: DataFrame) -> DataFrame:
    """name, component for every node of ``links`` (src, dst): component is the smallest node it can reach.

    Two steps alternate until nothing changes: the larger neighbours of a node
    hang on its smallest one, then the smaller ones. Each is a minimum by node,
    summed map-side and joined back, so a node with a third of the links is no
    one task's work. Rounds grow with the logarithm of the longest chain; each
    is written and the round before it dropped.
    """
    nodes = vertices(links)
    links = cut_lineage(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        down = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = cut_lineage(rest.union(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop_stage(links)
        links = hung
        after = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == before:
            found = links.groupBy("u").agg(F.min("v").alias("component"))
            return lookup(nodes, found, {"name": "u"}, ["component"]).select("name", F.coalesce("component", "name").alias("component"))
        before = after
