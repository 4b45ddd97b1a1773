"""Tolerant reading of loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_text(c: Column, default: str = "") -> Column:
    """The trimmed text; null, blank and the spellings of nothing give the default."""
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | F.lower(t).isin("", "nan", "none", "null"), F.lit(default)).otherwise(t)


def as_int(c: Column) -> Column:
    """The whole number before a dot, or null."""
    return F.split_part(F.trim(c.cast("string")), F.lit("."), F.lit(1)).try_cast("int")


def as_bool(c: Column, default: bool = True) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    yes, no = t.isin("true", "t", "yes", "y", "1", "current"), t.isin("false", "f", "no", "n", "0", "superseded", "withdrawn")
    return F.when(yes, True).when(no, False).otherwise(F.lit(default))


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cols])
