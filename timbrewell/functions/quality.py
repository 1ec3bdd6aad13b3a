"""Ranges, clamps, nulls: checks that report and mends that keep nulls apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrewell.schema import FEATURES, HIGHEST

#: What the narrow check looks at; the wide one looks at all 56.
NARROW = ("CON", "FL")


def clamped(name: str) -> Column:
    """The value within its range; null stays null (least and greatest would skip it)."""
    c = F.col(name)
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(HIGHEST[name]), c)))


def clamp(presets: DataFrame) -> DataFrame:
    return presets.withColumns({f: clamped(f) for f in FEATURES})


def _long(presets: DataFrame, values: dict[str, Column], name: str) -> DataFrame:
    """One pass over the table, then a row for each parameter."""
    one = presets.agg(*[v.cast("long").alias(f"c{k}") for k, v in enumerate(values.values())])
    pairs = ", ".join(f"'{f}', c{k}" for k, f in enumerate(values))
    return one.selectExpr(f"stack({len(values)}, {pairs}) AS (parameter, {name})")


def clamp_report(presets: DataFrame) -> DataFrame:
    """Values that a clamp changes, nulls counted among them."""
    return _long(presets, {f: F.count_if(F.col(f).isNull() | (F.col(f) != clamped(f))) for f in FEATURES}, "changed").where("changed > 0")


def range_violations(presets: DataFrame, narrow: bool = False) -> DataFrame:
    """Values outside their range, nulls not counted."""
    names = NARROW if narrow else FEATURES
    return _long(presets, {f: F.coalesce(F.count_if((F.col(f) < 0) | (F.col(f) > HIGHEST[f])), F.lit(0)) for f in names}, "invalid").where("invalid > 0")


def completeness(presets: DataFrame, columns: tuple[str, ...] = ("Game", "CON", "FL")) -> DataFrame:
    """Missing values of columns that matter, where there are any."""
    return _long(presets, {c: F.count_if(F.col(c).isNull()) for c in columns}, "missing").where("missing > 0")


def number_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type."""
    return [n for n, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def filled(presets: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing numbers as 0, as longs."""
    return presets.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in columns or FEATURES})
