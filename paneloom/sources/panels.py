"""Panel tables derived from the order tables.

``flow_cells`` is the one heavy job: a line-item fact table joined to its
dimensions and summed to (exporter, importer, year, item). Everything else is
derived from those cells. No broadcast hints are given: the sizes of customer,
supplier, part and orders grow with the data, so Spark's own size threshold
(static and at run time) decides between broadcast and shuffled joins, and
adaptive execution splits skewed join partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paneloom.session import cut_lineage

CELL_KEYS = ["exporter", "exporter_code", "importer", "importer_code", "year", "item"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _within_years(df: DataFrame, when: str, first_year: int | None, last_year: int | None) -> DataFrame:
    """Range test on the raw date column: it reaches the scan, before any join."""
    kind = df.schema[when].dataType
    if first_year is not None:
        df = df.where(F.col(when) >= F.lit(f"{first_year}-01-01").cast(kind))
    if last_year is not None:
        df = df.where(F.col(when) < F.lit(f"{last_year + 1}-01-01").cast(kind))
    return df


def flow_cells(
    spark: SparkSession,
    folder: str,
    first_year: int | None = None,
    last_year: int | None = None,
    items: Sequence[str] | None = None,
) -> DataFrame:
    """Value and quantity per (exporter, importer, year, item)."""
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    line = _within_years(line, "l_shipdate", first_year, last_year)
    part = table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("item"))
    if items is not None:
        part = part.where(F.col("item").isin(list(items)))
    seller = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("exporter_code"))
    buyer = (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey")
        .join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", F.col("c_nationkey").alias("importer_code"))
    )
    cells = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(buyer, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("exporter_code", "importer_code", F.year("l_shipdate").alias("year"), "item")
        .agg(
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("exp_val"),
            F.sum("l_quantity").alias("exp_quant"),
        )
    )
    # Names are attached to the cells, not to the line items.
    nation = table(spark, folder, "nation")
    for end in ("exporter", "importer"):
        names = nation.select(F.col("n_nationkey").alias(f"{end}_code"), F.col("n_name").alias(end))
        cells = cells.join(names, f"{end}_code")
    return cells.select(*CELL_KEYS, "exp_val", "exp_quant")


def _long(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """Measure columns to (element, value) rows in one pass over the cells."""
    keys = [c for c in cells.columns if c not in names]
    entries = F.array(*[F.struct(F.lit(text).alias("element"), F.col(c).alias("value")) for c, text in names.items()])
    return cells.select(*keys, F.inline(entries))


def staged_cells(spark: SparkSession, folder: str, **limits) -> DataFrame:
    """The flow cells as a written table, for queries that read them in several roles.

    Different filters per role would otherwise run the fact-table join once per
    role; the cells are small beside the fact table.
    """
    return cut_lineage(flow_cells(spark, folder, **limits))


def flows(
    spark: SparkSession, folder: str, cells: DataFrame | None = None, elements: Sequence[str] | None = None, **limits
) -> DataFrame:
    """Long bilateral panel with export elements; measures of unwanted elements are not summed."""
    cells = flow_cells(spark, folder, **limits) if cells is None else cells
    names = {"exp_val": "Export Value", "exp_quant": "Export Quantity"}
    if elements is not None:
        cells = cells.drop(*[c for c, text in names.items() if text not in elements])
        names = {c: text for c, text in names.items() if text in elements}
    return _long(cells, names)


def mirrored_flows(spark: SparkSession, folder: str, cells: DataFrame | None = None, **limits) -> DataFrame:
    """Long reporter / partner panel with export and import elements.

    The importing side reports the same cell as an import.
    """
    cells = flow_cells(spark, folder, **limits) if cells is None else cells

    def side(reporter: str, partner: str, element: str, value: str) -> Column:
        return F.struct(
            F.col(reporter).alias("reporter"),
            F.col(f"{reporter}_code").alias("reporter_code"),
            F.col(partner).alias("partner"),
            F.col(f"{partner}_code").alias("partner_code"),
            F.lit(element).alias("element"),
            F.col(value).alias("value"),
        )

    entries = F.array(
        side("exporter", "importer", "Export Value", "exp_val"),
        side("exporter", "importer", "Export Quantity", "exp_quant"),
        side("importer", "exporter", "Import Value", "exp_val"),
        side("importer", "exporter", "Import Quantity", "exp_quant"),
    )
    return cells.select("year", "item", F.inline(entries))


def country_panel(
    spark: SparkSession, folder: str, cells: DataFrame | None = None, elements: Sequence[str] | None = None, **limits
) -> DataFrame:
    """Long country panel: production and the four trade elements per area, year and item.

    Only the wanted elements are built; measures that none of them needs are not summed.
    """
    cells = flow_cells(spark, folder, **limits) if cells is None else cells
    abroad = F.col("exporter") != F.col("importer")

    def entry(side: str, element: str, value: str) -> Column:
        return F.struct(
            F.col(side).alias("area"), F.col(f"{side}_code").alias("area_code"), F.lit(element).alias("element"), F.col(value).alias("value")
        )

    trade = {
        "Export Quantity": ("exporter", "exp_quant"),
        "Export Value": ("exporter", "exp_val"),
        "Import Quantity": ("importer", "exp_quant"),
        "Import Value": ("importer", "exp_val"),
    }
    traded = [entry(side, name, value) for name, (side, value) in trade.items() if elements is None or name in elements]
    if elements is None or "Production" in elements:
        made = entry("exporter", "Production", "exp_quant")
        entries = F.when(abroad, F.array(made, *traded)).otherwise(F.array(made)) if traded else F.array(made)
    else:
        cells, entries = cells.where(abroad), F.array(*traded)
    return (
        cells.select("year", "item", F.inline(entries))
        .groupBy("area", "area_code", "year", "item", "element")
        .agg(F.sum("value").alias("value"))
    )


def income(spark: SparkSession, folder: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """Income proxy per area and year (thousands)."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    return (
        _within_years(orders, "o_orderdate", first_year, last_year)
        .join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.year("o_orderdate").alias("year"))
        .agg(F.sum("o_totalprice").alias("total"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_name").alias("area"), "year", (F.col("total") / 1000).alias("gdp"))
    )


def with_distance(spark: SparkSession, folder: str, rows: DataFrame, name: str = "distw") -> DataFrame:
    """Add the distance between exporter and importer, from the attributes of the two ends.

    Only ends of given rows meet the area table; no pair is made that does not
    trade. Ends that are no known area give NULL.
    """
    nation = table(spark, folder, "nation")
    out = rows
    for end in ("exporter", "importer"):
        ends = nation.select(F.col("n_name").alias(end), F.col("n_nationkey").alias(f"__{end}_key"), F.col("n_regionkey").alias(f"__{end}_region"))
        out = out.join(ends, end, "left")
    apart = F.when(F.col("__exporter_region") != F.col("__importer_region"), 1000).otherwise(0)
    distance = 500 + 100 * F.abs(F.col("__exporter_key") - F.col("__importer_key")) + apart
    return out.select(*rows.columns, distance.cast("double").alias(name))


def distances(spark: SparkSession, folder: str, pairs: DataFrame) -> DataFrame:
    """Distance table: one row per pair of areas that occurs in ``pairs``.

    ``distw`` and ``distcap`` are numbers; ``distwces`` is text, "." within an area.
    """
    pairwise = with_distance(spark, folder, pairs.select("exporter", "importer").distinct())
    weighted = F.when(F.col("exporter") == F.col("importer"), ".").otherwise((F.col("distw") * 0.75).cast("string"))
    return pairwise.withColumns({"distcap": F.col("distw") * 1.25, "distwces": weighted})


def sea_distances(spark: SparkSession, folder: str, pairs: DataFrame) -> DataFrame:
    """Sea distance of the pairs in ``pairs`` that are farther apart than 1000; others have no sea route."""
    return (
        with_distance(spark, folder, pairs.select("exporter", "importer").distinct())
        .where("distw > 1000")
        .select("exporter", "importer", (F.col("distw") * 2).alias("seadistance"))
    )


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Latitude and longitude per area."""
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("area"),
        (3 * F.col("n_nationkey") - 36).cast("double").alias("lat"),
        (7 * F.col("n_nationkey") - 84).cast("double").alias("lon"),
    )


def area_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Area name, code and region code: the country-code dimension."""
    return table(spark, folder, "nation").select(
        F.col("n_name").alias("area"), F.col("n_nationkey").alias("area_code"), F.col("n_regionkey").alias("region_code")
    )
