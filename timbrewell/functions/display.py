"""Values as users see them: clusters, flags, map coordinates, colours, percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrewell.schema import CLUSTER_COLOURS, CLUSTERS, NO_COLOUR

YES = ("true", "1", "yes", "y", "gems")
NO = ("false", "0", "no", "n", "")
FLAGS = {"Japan": "JP", "USA": "US", "UK": "UK"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def cluster_id(cluster: Column, spare: Column | None = None, name: Column | None = None) -> Column:
    """By name if it is known, else the number or the spare one; outside the known numbers 0."""
    number = F.coalesce(cluster, spare if spare is not None else F.lit(None).cast("int"), F.lit(0))
    number = F.when(number.between(0, max(CLUSTERS)), number).otherwise(F.lit(0))
    if name is None:
        return number.cast("int")
    by_name = F.element_at(_map({v: k for k, v in CLUSTERS.items()}), name)
    return F.coalesce(by_name, number).cast("int")


def cluster_info(cluster: Column, spare: Column | None = None, name: Column | None = None) -> Column:
    """Struct of id, name and colour."""
    k = cluster_id(cluster, spare, name)
    return F.struct(k.alias("id"), F.element_at(_map(CLUSTERS), k).alias("name"), F.coalesce(F.element_at(_map(CLUSTER_COLOURS), k), F.lit(NO_COLOUR)).alias("colour"))


def is_yes(value: Column, number: bool = False) -> Column:
    """Flag of a boolean or text, or of a number: unknown words that aren't blank count as yes."""
    if number:
        return F.coalesce(value != 0, F.lit(False))
    text = F.lower(F.trim(value.cast("string")))
    return F.when(value.isNull(), False).when(text.isin(*YES), True).otherwise(~text.isin(*NO))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def country_flag(nationality: Column, other: str = "??") -> Column:
    return F.coalesce(F.element_at(_map(FLAGS), nationality), F.lit(other))


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100.0 / whole + 0.5)).otherwise(0).cast("int")


def padded_bounds(points: DataFrame, x: str = "x", y: str = "y", pad: float = 0.05) -> DataFrame:
    """One row: the bounds of the points, with a share of the extent on each side."""
    one = points.agg(F.min(x).alias("x_lo"), F.max(x).alias("x_hi"), F.min(y).alias("y_lo"), F.max(y).alias("y_hi"))
    out = {}
    for a in ("x", "y"):
        width = (F.col(f"{a}_hi") - F.col(f"{a}_lo")) * pad
        out |= {f"{a}_min": F.col(f"{a}_lo") - width, f"{a}_max": F.col(f"{a}_hi") + width}
    return one.withColumns(out).select("x_min", "x_max", "y_min", "y_max")


def on_map(points: DataFrame, width: float, height: float) -> DataFrame:
    """points with px and py, their places on a map of the given size; the bounds are one row."""
    bounds = F.broadcast(padded_bounds(points))
    scaled = {"px": (F.col("x") - F.col("x_min")) / (F.col("x_max") - F.col("x_min")) * width, "py": (F.col("y") - F.col("y_min")) / (F.col("y_max") - F.col("y_min")) * height}
    return points.crossJoin(bounds).withColumns(scaled).drop("x_min", "x_max", "y_min", "y_max")


def in_view(width: float, height: float, margin: float = 10.0) -> Column:
    return F.col("px").between(-margin, width + margin) & F.col("py").between(-margin, height + margin)


def greyed(colour: Column, share: float) -> Column:
    """A #rrggbb colour mixed with its grey."""
    parts = [F.conv(F.substring(colour, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]
    grey = (parts[0] + parts[1] + parts[2]) / 3.0
    mixed = [F.floor(p + (grey - p) * share + 0.5).cast("int") for p in parts]
    return F.format_string("#%02x%02x%02x", *mixed)


def wave_height(sample: Column, height: float) -> Column:
    """Height of an unsigned 8-bit sample on a display."""
    return sample / 128.0 * height / 2.0
