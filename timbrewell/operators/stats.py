"""Grouped and global statistics. Modes break ties towards the smallest value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUARTILES = (0.25, 0.5, 0.75)
RANK_CELLS = 1024


def mode(c: str) -> Column:
    return F.mode(c, True).alias(f"{c}_mode")


def value_counts(rows: DataFrame, c: str, least_first: bool = False) -> DataFrame:
    """Values other than null with their counts, most frequent first, ties by value."""
    counts = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(c) if least_first else counts.orderBy(F.desc("n"), c)


def group_stats(scored: DataFrame, key: str, more: list[Column] | None = None, spread: bool = True) -> DataFrame:
    """For each group: modes of CON and FL, means (and sample deviations) of the scores, rows with a file name."""
    out = [mode("CON"), mode("FL"), F.avg("Brightness_Index").alias("brightness_mean"), F.avg("Complexity_Score").alias("complexity_mean")]
    if spread:
        out += [F.stddev_samp("Brightness_Index").alias("brightness_std"), F.stddev_samp("Complexity_Score").alias("complexity_std")]
    return scored.where(F.col(key).isNotNull()).groupBy(key).agg(*out, F.count("Filename").alias("presets"), *(more or []))


def composer_stats(scored: DataFrame) -> DataFrame:
    first = F.min_by("Nationality", F.when(F.col("Nationality").isNotNull(), F.col("preset_id"))).alias("Nationality")
    return group_stats(scored, "Composer", [first])


def nationality_stats(scored: DataFrame) -> DataFrame:
    return group_stats(scored, "Nationality", spread=False)


def cluster_stats(scored: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return group_stats(scored, cluster, [mode("Game")], spread=False)


def crosstab_percent(rows: DataFrame, key: str, value: str, values: list[int]) -> DataFrame:
    """Share of each value in each group, in percent, 0 where there is none."""
    total = F.count(F.lit(1))
    cells = [(F.count_if(F.col(value) == v) * 100.0 / total).alias(f"v{v}") for v in values]
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(*cells)


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample deviation, least, quartiles by linear interpolation, greatest, of each column.

    Quartiles are exact and no task sees all values: values are counted, the counts of RANK_CELLS equal cells between
    least and greatest say which cells hold the wanted ranks, and only those cells are ordered.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*").where("v IS NOT NULL")
    one = long.groupBy("metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    cell = F.when(F.col("greatest") > F.col("least"), F.floor((F.col("v") - F.col("least")) / (F.col("greatest") - F.col("least")) * RANK_CELLS)).otherwise(F.lit(0))
    counts = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(one), "metric").select("metric", "v", "c", "n", cell.alias("cell"))
    cells = counts.groupBy("metric", "cell", "n").agg(F.sum("c").alias("c"))
    cells = cells.withColumn("before", F.sum("c").over(Window.partitionBy("metric").orderBy("cell")) - F.col("c"))
    place = F.col("q") * (F.col("n") - 1)
    ranks = F.explode(F.array(*[F.lit(q) for q in QUARTILES]))
    wanted = cells.withColumn("q", ranks).withColumn("rank", F.explode(F.array(F.floor(place), F.ceil(place)))).where("rank >= before AND rank < before + c")
    wanted = wanted.select("metric", "cell", "before", "q", "rank", place.alias("place")).distinct()
    upto = F.sum("c").over(Window.partitionBy("metric", "cell").orderBy("v"))
    there = counts.join(wanted.select("metric", "cell").distinct(), ["metric", "cell"], "left_semi").withColumn("upto", upto)
    met = there.join(wanted, ["metric", "cell"]).where("rank < before + upto AND rank >= before + upto - c")
    weight = F.when(F.floor("place") == F.ceil("place"), F.lit(1.0)).when(F.col("rank") == F.floor("place"), F.ceil("place") - F.col("place")).otherwise(F.col("place") - F.floor("place"))
    found = met.groupBy("metric", "q").agg(F.sum(F.col("v") * weight).alias("x"))
    wide = found.groupBy("metric").agg(*[F.max(F.when(F.col("q") == q, F.col("x"))).alias(f"q{int(q * 100)}") for q in QUARTILES])
    order = ["metric", "n", "mean", "std", "least", *[f"q{int(q * 100)}" for q in QUARTILES], "greatest"]
    # a column without values has a row of its own too
    names = rows.sparkSession.createDataFrame([(c,) for c in columns], "metric string")
    return names.join(one, "metric", "left").join(wide, "metric", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).select(*order)


def histogram(rows: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins from the least to the greatest value; the last bin holds the greatest."""
    bounds = F.broadcast(rows.agg(F.min(c).alias("lo"), F.max(c).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    number = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(c) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return rows.where(F.col(c).isNotNull()).crossJoin(bounds).groupBy(number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def flag_split(rows: DataFrame, flag: str) -> DataFrame:
    """For both sides of a flag: rows, games, share of all rows, mean rows of a game (two levels of grouping)."""
    games = rows.where("Game IS NOT NULL").groupBy(flag, "Game").agg(F.count(F.lit(1)).alias("n"))
    per = games.groupBy(flag).agg(F.count(F.lit(1)).alias("games"), F.avg("n").alias("mean_presets"))
    all_ = rows.groupBy(flag).agg(F.count(F.lit(1)).alias("presets"))
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))
    return all_.join(per, flag, "left").crossJoin(total).select(flag, "presets", "games", "mean_presets", (F.col("presets") * 100.0 / F.col("total")).alias("percent"))


def flag_compare(scored: DataFrame, flag: str) -> DataFrame:
    """Metrics side by side for both sides of a flag."""
    sides = {"with_flag": F.col(flag), "without_flag": ~F.col(flag)}
    rows = []
    for name, of in (("CON_mode", "CON"), ("FL_mode", "FL")):
        rows.append(F.struct(F.lit(name).alias("metric"), *[F.mode(F.when(on, F.col(of)), True).cast("double").alias(s) for s, on in sides.items()]))
    for name, of in (("brightness_mean", "Brightness_Index"), ("complexity_mean", "Complexity_Score")):
        rows.append(F.struct(F.lit(name).alias("metric"), *[F.avg(F.when(on, F.col(of))).alias(s) for s, on in sides.items()]))
    return scored.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def top_games(rows: DataFrame, flag: str, k: int = 15) -> DataFrame:
    """The k games with the most rows on each side of a flag."""
    from timbrewell.operators.enrich import row_number_by

    counts = rows.where("Game IS NOT NULL").groupBy(flag, "Game").agg(F.count(F.lit(1)).alias("n"))
    return row_number_by(counts, [flag], [F.desc("n"), "Game"]).where(F.col("rank") <= k)


def compare(scored: DataFrame, a: Column, b: Column) -> DataFrame:
    """One pass: statistics of the rows that match a and of those that match b; a row may match both."""
    out = []
    for side, on in (("a", a), ("b", b)):
        out += [F.count_if(on).alias(f"{side}_presets"), F.mode(F.when(on, F.col("CON")), True).alias(f"{side}_CON"), F.mode(F.when(on, F.col("FL")), True).alias(f"{side}_FL")]
        out += [F.avg(F.when(on, F.col(c))).alias(f"{side}_{n}") for n, c in (("brightness", "Brightness_Index"), ("complexity", "Complexity_Score"))]
    return scored.agg(*out)


def profile(scored: DataFrame, on: Column) -> DataFrame:
    """Count, algorithms in use, modes and means of the rows that match."""
    used = F.array_join(F.transform(F.array_sort(F.collect_set("CON")), lambda x: x.cast("string")), ",")
    return scored.where(on).agg(F.count(F.lit(1)).alias("presets"), used.alias("algorithms"), mode("CON"), mode("FL"), F.avg("Brightness_Index").alias("brightness_mean"), F.avg("Complexity_Score").alias("complexity_mean"))


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts over the whole dataset."""
    return rows.agg(F.count(F.lit(1)).alias("presets"), F.count_distinct("Game").alias("games"), F.count_distinct("Composer").alias("composers"), F.count_distinct("Nationality").alias("nationalities"), F.count_if("Uses_GEMS").alias("flagged"))


def entity_stats(scored: DataFrame, key: str) -> DataFrame:
    """For the published dataset: each entity with its games (at most a sorted set), count and means."""
    games = F.array_join(F.array_sort(F.collect_set("Game")), "|").alias("games")
    return scored.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), games, F.avg("Brightness_Index").alias("brightness_mean"), F.avg("Complexity_Score").alias("complexity_mean"))


def first_composers(rows: DataFrame, k: int = 3) -> DataFrame:
    """Each game's count and its first k composers, by ord."""
    from timbrewell.operators.enrich import row_number_by

    firsts = rows.where("Composer IS NOT NULL").groupBy("Game", "Composer").agg(F.min("ord").alias("ord"))
    top = row_number_by(firsts, ["Game"], ["ord"]).where(F.col("rank") <= k)
    names = top.groupBy("Game").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "Composer"))), lambda x: x["Composer"]), ", ").alias("composers"))
    return rows.groupBy("Game").agg(F.count(F.lit(1)).alias("n")).join(names, "Game", "left")
