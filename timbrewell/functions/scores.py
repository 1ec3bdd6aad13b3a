"""Derived scores of a preset. Sums of integers come first, so results don't depend on the order of additions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrewell.schema import SLOTS


def _over_slots(param: str) -> Column:
    return reduce(add, [F.col(f"{s}_{param}") for s in SLOTS]).cast("double")


def brightness() -> Column:
    """0.4 for low total levels, 0.3 for attack rates, 0.3 for multipliers, within 0 to 1."""
    level, attack, multiple = (_over_slots(p) / 4 for p in ("TL", "AR", "MUL"))
    score = F.lit(0.4) * (F.lit(1.0) - level / 127) + F.lit(0.3) * (attack / 31) + F.lit(0.3) * (multiple / 15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def complexity() -> Column:
    """0.4 for the algorithm, 0.4 for audible operators, 0.2 for feedback."""
    audible = reduce(add, [(F.col(f"{s}_TL") < 127).cast("int") for s in SLOTS]).cast("double")
    return F.lit(0.4) * (F.col("CON").cast("double") / 7) + F.lit(0.4) * (audible / 4) + F.lit(0.2) * (F.col("FL").cast("double") / 7)


def with_scores(presets: DataFrame) -> DataFrame:
    return presets.withColumns({"Brightness_Index": brightness(), "Complexity_Score": complexity()})
