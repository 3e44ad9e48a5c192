"""Aggregate helpers with the panel NULL rules. All combine map-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paneloom.functions.scalars import col


def sum0(c: str | Column) -> Column:
    """Sum over the known values; a group with none of them gives 0, not NULL."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def count_rows() -> Column:
    """All rows, whether their value is known or not."""
    return F.count(F.lit(1))


def count_known(c: str | Column) -> Column:
    """Rows with a known value: the number of active links."""
    return F.count(col(c))


def count_positive(c: str | Column) -> Column:
    return F.count_if(col(c) > 0)
