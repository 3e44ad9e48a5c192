"""Column helpers that fix the NULL, division and pattern rules of the panel verbs.

All of them are plain built-in expressions, so they stay inside code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` that is NULL, never an error or infinity, when ``den`` is 0."""
    return F.try_divide(col(num), col(den))


def log_or_null(x: str | Column) -> Column:
    """Natural logarithm; zero and negative input give NULL so that models drop the row."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


def flag(condition: Column) -> Column:
    """1.0 / 0.0, and NULL when the condition is NULL."""
    return F.when(condition, F.lit(1.0)).when(~condition, F.lit(0.0))


def label(c: str | Column, names: Mapping[str, str]) -> Column:
    """Relabel the listed values; any other value gives NULL."""
    out = None
    for value, text in names.items():
        test = col(c) == F.lit(value)
        out = F.when(test, F.lit(text)) if out is None else out.when(test, F.lit(text))
    return out if out is not None else F.lit(None).cast("string")


def label_rules(rules: Sequence[tuple[Column, str]]) -> Column:
    """First matching rule wins; no match gives NULL."""
    out = None
    for test, text in rules:
        out = F.when(test, F.lit(text)) if out is None else out.when(test, F.lit(text))
    return out


def range_label(c: str | Column, ranges: Sequence[tuple[int, int, str]]) -> Column:
    """Label of the half-open range ``[low, high)`` that holds the value."""
    c = col(c)
    return label_rules([((c >= low) & (c < high), text) for low, high, text in ranges])


# Area-code ranges of the continents in the source classification.
CONTINENT_CODE_RANGES = [
    (5100, 5200, "Africa"),
    (5200, 5300, "America"),
    (5300, 5400, "Asia"),
    (5400, 5500, "Europe"),
    (5500, 5600, "Oceania"),
]


def slug(c: str | Column) -> Column:
    """Text usable as a file or folder name: comma, brackets, blanks and slash become ``_``."""
    return F.regexp_replace(col(c), r"[,() \t/]", "_")


def remove_first(c: str | Column, pattern: str) -> Column:
    """Drop the first match of ``pattern`` only."""
    return F.regexp_replace(col(c), f"^(.*?)(?:{pattern})", "$1")


def year_of(c: str | Column) -> Column:
    """Year number out of a column name such as ``y1997``."""
    return F.regexp_replace(col(c), "^[yY]", "").try_cast("int")


def to_number(c: str | Column) -> Column:
    """Text to double; text that is no number gives NULL."""
    return col(c).try_cast("double")


def combined_key(*cols: str | Column, sep: str = "^") -> Column:
    """Several keys joined to one categorical key; NULL if any part is NULL."""
    parts = [col(c).cast("string") for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p)
    return out


def stars(p: str | Column) -> Column:
    """Significance marks at the 10, 5 and 1 percent levels."""
    p = col(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")
