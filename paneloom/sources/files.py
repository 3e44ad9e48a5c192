"""Scans and sinks: CSV and Parquet in, partitioned Parquet / CSV out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.scalars import slug


def wide_schema(keys: Sequence[tuple[str, str]], years: Sequence[int], prefix: str = "Y") -> T.StructType:
    """Schema of a wide source file: key columns, then one double column per year."""
    schema = T.StructType()
    for name, kind in keys:
        schema = schema.add(name, kind)
    for y in years:
        schema = schema.add(f"{prefix}{y}", "double")
    return schema


# Raw header -> panel column names of the two wide source files.
COUNTRY_FILE_NAMES = {
    "Area Code": "area_code",
    "Area Code (M49)": "area_code_m49",
    "Item Code": "item_code",
    "Element Code": "element_code",
}
FLOW_FILE_NAMES = {
    "Reporter Countries": "reporter_country",
    "Reporter Country Code": "reporter_country_code",
    "Partner Countries": "partner_country",
    "Partner Country Code": "partner_country_code",
    "Item Code": "item_code",
    "Element Code": "element_code",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Header CSV. Pass a schema for large files: inference costs one more full scan."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def normalise_columns(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Rename the given columns, then put every column name in lower case."""
    df = df.withColumnsRenamed(dict(names or {}))
    return df.toDF(*[c.lower() for c in df.columns])


def write_parquet(df: DataFrame, path: str, partition_by: str | Sequence[str] = "year", mode: str = "errorifexists") -> None:
    """Parquet partitioned by year, so later year filters read only their folders.

    The rebalance hint lets adaptive execution bring the rows of a folder
    together (few files), yet split a year that holds a third of all rows.
    """
    by = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_series(df: DataFrame, path: str, item: str, area: str, mode: str = "errorifexists") -> None:
    """One output folder per item and area, all written by a single job.

    Groups without rows simply produce no file, which replaces per-group error handling.
    """
    marked = df.withColumns({"item_slug": slug(item), "area_slug": slug(area)})
    write_parquet(marked, path, ["item_slug", "area_slug"], mode)


def unpivot_years(df: DataFrame, keys: Sequence[str], pattern: str = r"^[yY](\d{4})$", value: str = "value") -> DataFrame:
    """Year columns to (year, value) rows. Flag columns such as ``y1997f`` do not match the pattern."""
    import re

    years = [c for c in df.columns if re.match(pattern, c)]
    return df.unpivot(list(keys), years, "year", value).withColumn(
        "year", F.regexp_extract("year", pattern, 1).cast("int")
    )
