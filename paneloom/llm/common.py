"""Helpers that several text operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: blank and the characters 9 to 13.
BLANKS = "[\\x20\\x09-\\x0D]+"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "paneloom-text"), "zip", root, "paneloom")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def whole_number(docs: DataFrame, column: str) -> bool:
    """Whether a column holds whole numbers of at most 64 bits."""
    return docs.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


def number_of(docs: DataFrame, column: str) -> Column:
    """An id as a number: itself, or a hash of its text where it is no whole number."""
    return F.col(column).cast("long") if whole_number(docs, column) else F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast("string")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column that is read inside a lambda would be computed anew for each
    element; a lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs without blanks."""
    trimmed = F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", "")
    return F.filter(F.split(trimmed, BLANKS), lambda w: w != F.lit(""))
