"""Scaling, principal components, a map in the plane, and clusters."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbrewell.operators.enrich import SMALL_DIMENSION, if_small, numbered
from timbrewell.operators.means import KMeans, Sweep
from timbrewell.operators.nearest import all_neighbours
from timbrewell.schema import FEATURES
from timbrewell.sources.files import remove, scratch

#: Seeds of the restarts, of which the least inertia counts.
RESTARTS = tuple(range(42, 52))


def scaled(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns less their mean over their population deviation; constant ones become 0.

    The moments, two numbers a column, are taken in one pass over one array column and stand in the plan as numbers.
    """
    columns = columns or FEATURES
    cells = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("k", "v"))
    found = {r["k"]: r for r in cells.groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).collect()}
    out = {}
    for k, c in enumerate(columns):
        mean, std = (found[k]["mean"], found[k]["std"]) if k in found else (None, None)
        out[c] = (F.col(c) - F.lit(mean)) / F.lit(std if std and std > 0 else 1.0)
    return rows.withColumns(out)


def assembled(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key and features, one vector for each row."""
    return rows.select(key, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"))


def principal(vectors: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """vectors (centred) with their k components as an array, and each component's share of the variance."""
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(vectors)
    return model.transform(vectors).withColumn("components", vector_to_array("_pca")).drop("_pca"), [float(x) for x in model.explainedVariance]


def components_for(shares: list[float], wanted: float = 0.95) -> int:
    """How many components reach the wanted share of the variance; one more than all if they don't."""
    total = 0.0
    for k, share in enumerate(shares, 1):
        total += share
        if total >= wanted - 1e-12:
            return k
    return len(shares) + 1


def variance_table(spark, shares: list[float]) -> DataFrame:
    """component, share and the running sum."""
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(shares, 1)], "component int, share double")
    return rows.withColumn("upto", F.sum("share").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))


def plane(vectors: DataFrame, key: str, rows: DataFrame | None = None) -> DataFrame:
    """key, embed_x and embed_y: a deterministic map by the first two components, signs fixed by the largest loading.

    rows: those of the vectors that are placed, if not all.
    """
    model = PCA(k=2, inputCol="features", outputCol="_pca").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] > 0 else -1.0 for j in range(2)]
    at = vector_to_array("_pca")
    return model.transform(vectors if rows is None else rows).select(key, (at[0] * signs[0]).alias("embed_x"), (at[1] * signs[1]).alias("embed_y"))


def fuzzy_graph(vectors: DataFrame, key: str, neighbours: int = 30) -> DataFrame:
    """a, b (a < b) and weight of the edges between nearest neighbours, each row's distances scaled by its own spread.

    A row's weights are 1 for its nearest and fall off so that they sum to log2(neighbours), the rate found by halving;
    the two weights of an edge are joined as the chance that one of two independent events happens.
    """
    near = all_neighbours(vectors.select(key, vector_to_array("features").alias("v")), key, "v", neighbours, "euclidean")
    rows = near.groupBy("query").agg(F.collect_list(F.struct((-F.col("similarity")).alias("d"), F.col("neighbour").alias("n"))).alias("near"))
    rows = rows.withColumn("least", F.coalesce(F.array_min(F.transform(F.filter("near", lambda x: x["d"] > 0), lambda x: x["d"])), F.lit(0.0)))
    rows = rows.withColumn("over", F.transform("near", lambda x: F.greatest(x["d"] - F.col("least"), F.lit(0.0))))

    def halved(held, _):
        mid = (held["lo"] + held["hi"]) / 2
        total = F.aggregate("over", F.lit(0.0), lambda s, x: s + F.exp(-x / mid))
        much = total > float(np.log2(neighbours))
        return F.struct(F.when(much, held["lo"]).otherwise(mid).alias("lo"), F.when(much, mid).otherwise(held["hi"]).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), (F.array_max("over") * 20 + 1e-9).alias("hi"))
    rows = rows.withColumn("rate", F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halved, lambda held: held["hi"]))
    edges = rows.select("query", "least", "rate", F.explode("near").alias("e"))
    weight = F.exp(-F.greatest(F.col("e.d") - F.col("least"), F.lit(0.0)) / F.col("rate"))
    edges = edges.select(F.least("query", "e.n").alias("a"), F.greatest("query", "e.n").alias("b"), weight.alias("w"))
    return edges.groupBy("a", "b").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.product("w")).otherwise(0.0)).alias("weight"))


def curve(least: float = 0.05) -> tuple[float, float]:
    """a and b for which 1 / (1 + a d^(2b)) comes closest to 1 up to the least distance and exp(least - d) beyond it."""
    d = np.linspace(0.01, 3, 300)
    wanted = np.where(d < least, 1.0, np.exp(least - d))
    lows, highs = np.array([0.2, 0.4]), np.array([6.0, 1.6])
    for _ in range(12):
        a, b = (np.linspace(x, y, 15) for x, y in zip(lows, highs, strict=True))
        off = ((1 / (1 + a[:, None, None] * d ** (2 * b[None, :, None])) - wanted) ** 2).sum(axis=2)
        i, j = np.unravel_index(off.argmin(), off.shape)
        best, width = np.array([a[i], b[j]]), (highs - lows) / 4
        lows, highs = np.maximum(best - width, 0.05), best + width
    return float(best[0]), float(best[1])


def neighbour_map(vectors: DataFrame, key: str, neighbours: int = 30, rounds: int = 40, least: float = 0.05, others: int = 10) -> DataFrame:
    """key, embed_x and embed_y: a layout of the graph of nearest neighbours, from the plane of two components.

    Equal vectors are one point, that of their smallest key: a row's neighbours are other vectors, not its own copies,
    and each row gets its point's place. In each round edges pull their ends together and each point is pushed away by
    some points drawn by a hash, so the map is the same each time; steps get shorter. Places are written after each
    round: a lost executor costs tasks. Edges lie by their first point and are not shuffled while places are few.
    """
    spark = vectors.sparkSession
    a, b = curve(least)

    def kept(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    points = vectors.groupBy(vector_to_array("features").alias("v")).agg(F.min(key).alias(key))
    points = kept(points, scratch(spark, "points"))
    own_rows = points.select(key, array_to_vector("v").alias("features"))
    edges = kept(fuzzy_graph(own_rows, key, neighbours), scratch(spark, "edges"))
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = kept(both.repartition("a"), scratch(spark, "ends"))
    # of all others a point meets some each round; what they push stands for five pushes for each pull
    pulls = both.groupBy("a").agg(F.sum("weight").alias("pulls"))
    flat = plane(vectors, key, own_rows)
    widest = flat.agg(F.max(F.greatest(F.abs("embed_x"), F.abs("embed_y")))).first()[0] or 1.0
    first = numbered(flat, key, "n").join(pulls.withColumnRenamed("a", key), key, "left")
    places = kept(first.select(F.col(key).alias("k"), F.col("n").cast("long"), F.coalesce("pulls", F.lit(0.0)).alias("pulls"), *[(F.col(f"embed_{c}") * (10.0 / widest)).alias(c) for c in "xy"]), at := scratch(spark, "places"))
    n = places.count()
    hint = F.broadcast if n <= SMALL_DIMENSION else lambda df: df
    own = lambda df, p, on: hint(df.select(F.col(on).alias(f"{p}k"), *[F.col(c).alias(f"{p}{c}") for c in "xy"]))
    for r in range(rounds):
        step = 1.0 - r / rounds
        met = both.join(own(places, "i", "k"), F.col("a") == F.col("ik")).join(own(places, "j", "k"), F.col("b") == F.col("jk")).select("ik", "ix", "iy", "jx", "jy", "weight")
        drawn = places.select(F.col("k").alias("ik"), F.col("x").alias("ix"), F.col("y").alias("iy"), (F.col("pulls") * (5.0 / others)).alias("weight"), F.explode(F.sequence(F.lit(1), F.lit(others))).alias("s"))
        drawn = drawn.withColumn("other", F.pmod(F.xxhash64("ik", F.lit(r), "s"), F.lit(n)) + 1)
        away = drawn.join(own(places, "j", "n"), F.col("other") == F.col("jk")).select("ik", "ix", "iy", "jx", "jy", "weight")
        moves = _moves(met, -2.0 * a * b, F.pow("d", b - 1) / (1 + a * F.pow("d", b))).unionAll(_moves(away, 2.0 * b, 1 / ((F.col("d") + 0.001) * (1 + a * F.pow("d", b)))))
        moved = moves.groupBy("ik").agg(*[F.sum(f"m{c}").alias(f"m{c}") for c in "xy"])
        ahead = places.join(hint(moved), F.col("k") == F.col("ik"), "left")
        shift = {c: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(F.col(f"m{c}"), F.lit(0.0)) / F.greatest(F.col("pulls"), F.lit(1.0)))) * step for c in "xy"}
        before, at = at, scratch(spark, "places")
        places = kept(ahead.select("k", "n", "pulls", *[(F.col(c) + shift[c]).alias(c) for c in "xy"]), at)
        remove(spark, before)
    placed = points.select("v", F.col(key).alias("_point")).join(places.select(F.col("k").alias("_point"), F.col("x").alias("embed_x"), F.col("y").alias("embed_y")), "_point").drop("_point")
    # a vector takes some hundred bytes, a dimension's row fewer
    return vectors.select(key, vector_to_array("features").alias("v")).join(if_small(placed, SMALL_DIMENSION // 20), "v").select(key, "embed_x", "embed_y")


def _moves(pairs: DataFrame, factor: float, share) -> DataFrame:
    """What each pair moves its first point along the line from the second, at most 4 a weight; d is the squared distance."""
    rows = pairs.withColumn("d", F.pow(F.col("ix") - F.col("jx"), 2) + F.pow(F.col("iy") - F.col("jy"), 2)).where("d > 0").withColumn("f", factor * share)
    return rows.select("ik", *[(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.col("f") * (F.col(f"i{c}") - F.col(f"j{c}")))) * F.col("weight")).alias(f"m{c}") for c in "xy"])


def _fits(vectors: DataFrame, asked: list[tuple[int, int]]) -> list:
    """A model for each k and seed; all go over the vectors together."""
    sweep = Sweep(vectors, asked)
    return [KMeans(k=k, seed=seed, featuresCol="features", predictionCol="Cluster").fit(sweep) for k, seed in asked]


def clusters(vectors: DataFrame, k: int = 7, seeds: tuple[int, ...] = RESTARTS) -> tuple[DataFrame, float]:
    """vectors with Cluster, by the seed with the least inertia, and that inertia."""
    best = min(_fits(vectors, [(k, seed) for seed in seeds]), key=lambda model: model.summary.trainingCost)
    return best.transform(vectors), float(best.summary.trainingCost)


def elbow(vectors: DataFrame, ks: range = range(2, 16), seeds: tuple[int, ...] = RESTARTS) -> DataFrame:
    """k and inertia; no larger k is worse than a smaller one (best of all before)."""
    asked = [(k, seed) for k in ks for seed in seeds]
    found = [float(model.summary.trainingCost) for model in _fits(vectors, asked)]
    costs, least = [], float("inf")
    for k in ks:
        least = min(least, *(cost for (of, _), cost in zip(asked, found, strict=True) if of == k))
        costs.append((k, least))
    return vectors.sparkSession.createDataFrame(costs, "k int, inertia double")


def knee(xs: list[float], ys: list[float], fallback: int = 7) -> int:
    """Kneedle for a falling, convex curve: the point furthest below the chord once both axes run from 0 to 1."""
    x, y = np.array(xs, float), np.array(ys, float)
    if len(x) < 3 or x.max() == x.min() or y.max() == y.min():
        return fallback
    x, y = (x - x.min()) / (x.max() - x.min()), (y - y.min()) / (y.max() - y.min())
    gap = (1 - y) - x
    peaks = [k for k in range(1, len(gap) - 1) if gap[k] >= gap[k - 1] and gap[k] >= gap[k + 1] and gap[k] > 0]
    return int(xs[max(peaks, key=lambda k: gap[k])]) if peaks else fallback


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column, as rows."""
    one = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(columns)])
    cells = ", ".join(f"'{c}', m{k}, s{k}" for k, c in enumerate(columns))
    return one.selectExpr(f"stack({len(columns)}, {cells}) AS (feature, mean, std)")
