"""Deduplication and joins with the dimensions of games, composers and tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbrewell.functions.naming import normal_composer, normal_game
from timbrewell.functions.naming import pair_key as key_of_pair
from timbrewell.schema import FEATURES, LEVELS

#: Rows of a dimension that are broadcast at most; above it the join shuffles.
SMALL_DIMENSION = 200_000


def if_small(dim: DataFrame, rows: int = SMALL_DIMENSION) -> DataFrame:
    """dim with a broadcast hint if it has few enough rows, which is looked up first."""
    return F.broadcast(dim) if dim.limit(rows + 1).count() <= rows else dim


def dedup_but_levels(presets: DataFrame) -> DataFrame:
    """The first preset (by preset_id) of each set of equal game and parameters, total levels left out.

    Keys are grouped with a partial minimum before the shuffle, so a key in many rows makes no large partition.
    """
    keys = ["Game", *[f for f in FEATURES if f not in LEVELS]]
    rest = [c for c in presets.columns if c not in keys and c != "preset_id"]
    row = F.struct("preset_id", *[F.col(f"`{c}`") for c in rest])
    first = presets.groupBy(*keys).agg(F.min_by(row, "preset_id").alias("_row"))
    return first.select(*keys, "_row.*").select(*[F.col(f"`{c}`") for c in presets.columns])


def dedup_report(presets: DataFrame) -> DataFrame:
    """One row: rows before and after, removed and the removed percentage in hundredths."""
    keys = ["Game", *[f for f in FEATURES if f not in LEVELS]]
    counts = presets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.sum("n").alias("before"), F.count(F.lit(1)).alias("after"))
    return one.select("before", "after", (F.col("before") - F.col("after")).alias("removed"), F.expr("(before - after) * 10000 div before").alias("removed_bp"))


def first_non_null(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each key: each column's first value that is not null, by order."""
    picks = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*picks)


def with_composers(presets: DataFrame, composers: DataFrame, order: str = "ord") -> DataFrame:
    """presets with Composer and Nationality of their game, where there are any."""
    tidy = composers.withColumns({"Game": normal_game(F.col("Game")), "Composer": normal_composer(F.col("Composer"))})
    return presets.join(if_small(first_non_null(tidy, "Game", order, ["Composer", "Nationality"])), "Game", "left")


def with_tool_flag(presets: DataFrame, games: DataFrame, flag: str = "Uses_GEMS") -> DataFrame:
    """presets with a flag: the game is in the list, letter for letter."""
    listed = games.select("Game").where("Game IS NOT NULL").distinct().withColumn("_listed", F.lit(True))
    return presets.join(if_small(listed), "Game", "left").withColumn(flag, F.col("_listed").isNotNull()).drop("_listed")


def in_list(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_semi")


def not_in_list(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def split_active(rows: DataFrame, active: DataFrame, on: str = "preset_id") -> DataFrame:
    """rows with is_active: the id is among the active ones."""
    marked = active.select(on).distinct().withColumn("_there", F.lit(True))
    return rows.join(marked, on, "left").withColumn("is_active", F.col("_there").isNotNull()).drop("_there")


def align(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """left with columns of the first row of right (by preset_id) that has the same game and name."""
    keyed = right.withColumn("_k", key_of_pair(F.col("Game"), F.col("Name")))
    first = keyed.groupBy("_k").agg(F.min_by(F.struct(*columns), "preset_id").alias("_r"))
    return left.withColumn("_k", key_of_pair(F.col("Game"), F.col("Name"))).join(first, "_k", "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in columns])


def numbered(rows: DataFrame, order: str, name: str = "n", ranges: int = 64) -> DataFrame:
    """rows with their number, from 1, in the order of a whole-number column without ties.

    Ranges between quantiles of the column are numbered apart and moved by the rows before them, so that no window
    holds more than a range. Nulls come first.
    """
    cuts = rows.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] or []
    part = sum([(F.col(order) > F.lit(x)).cast("int") for x in sorted(set(cuts))], F.lit(0))
    dealt = rows.withColumn("_part", F.coalesce(part, F.lit(-1)))
    sums = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")


def by_position(frames: list[DataFrame], ordinal: str) -> DataFrame:
    """Rows side by side by an explicit ordinal; shorter frames end in nulls."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, ordinal, "full")
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def normalized(presets: DataFrame) -> DataFrame:
    return presets.withColumn("Game", normal_game(F.col("Game")))


def row_number_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
