"""Nearest neighbours: one query by a bounded heap, many by blocked matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on average.
QUERY_BLOCK = 2000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_neighbours(rows: DataFrame, key: str, vector: str, query: int, k: int = 10) -> DataFrame:
    """The k rows most like the query's by cosine, itself left out, with rank and similarity; ties by key."""
    one = F.broadcast(rows.where(F.col(key) == query).select(F.col(vector).alias("_q")).limit(1))
    v = F.col(vector)
    similarity = _dot(v, F.col("_q")) / (F.sqrt(_dot(v, v)) * F.sqrt(_dot(F.col("_q"), F.col("_q"))))
    top = rows.where(F.col(key) != query).crossJoin(one).select(key, similarity.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), key)))


def plane_neighbours(rows: DataFrame, key: str, query: int, k: int = 10, x: str = "x", y: str = "y") -> DataFrame:
    """The k rows nearest to the query's in the plane, over all rows, itself left out; ties by key."""
    one = F.broadcast(rows.where(F.col(key) == query).select(F.col(x).alias("_x"), F.col(y).alias("_y")).limit(1))
    distance = F.sqrt((F.col(x) - F.col("_x")) * (F.col(x) - F.col("_x")) + (F.col(y) - F.col("_y")) * (F.col(y) - F.col("_y")))
    return rows.where(F.col(key) != query).crossJoin(one).select(key, distance.alias("distance")).orderBy("distance", key).limit(k)


def pick(rows: DataFrame, key: str, px: float, py: float, radius: float = 8.0) -> DataFrame:
    """The active row nearest to a point of the map, strictly within the radius; the first of equals."""
    distance = F.sqrt((F.col("px") - px) * (F.col("px") - px) + (F.col("py") - py) * (F.col("py") - py))
    return rows.select(key, distance.alias("distance")).where(F.col("distance") < radius).orderBy("distance", key).limit(1)


def all_neighbours(rows: DataFrame, key: str, vector: str, k: int = 10, metric: str = "cosine") -> DataFrame:
    """query, rank, neighbour and similarity of the k nearest of every row; rows without a vector have none.

    Similarity is the cosine, or with metric euclidean the distance below 0.

    Rows are dealt to blocks of a bounded size and each two blocks meet in a task, which multiplies them once and keeps
    k for each row of both; of what the tasks kept the best k stay. One plan whatever the number of blocks.
    """
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // QUERY_BLOCK))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select("key", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = met.groupBy("i", "j").applyInArrow(_two_blocks(k, metric), "query long, neighbour long, similarity double")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _two_blocks(k: int, metric: str):
    def nearest(like: np.ndarray, ids: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        like = np.where(ids[:, None] == own[None, :], -np.inf, like)
        if like.shape[1] > k:  # what is less than the k-th needs no order
            least = np.partition(like, -k, axis=1)[:, -k]
            at, of = np.nonzero((like >= least[:, None]) & np.isfinite(like))
        else:
            at, of = np.nonzero(np.isfinite(like))
        order = np.lexsort((own[of], -like[at, of], at))
        at, of = at[order], of[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, of = at[place < k], of[place < k]
        return [ids[at], own[of], like[at, of]]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, own = table["key"].to_numpy(), table["own"].to_numpy()
        matrix = np.asarray(table["v"].combine_chunks().flatten(), dtype=np.float64).reshape(len(ids), -1)
        if metric == "cosine":
            matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        a, b = own == i, own == j
        like = matrix[a] @ matrix[b].T
        if metric == "euclidean":
            squares = (matrix * matrix).sum(axis=1)
            like = -np.sqrt(np.maximum(squares[a][:, None] + squares[b][None, :] - 2 * like, 0.0))
        like = np.round(like, 12)
        parts = [nearest(like, ids[a], ids[b])] + ([nearest(like.T, ids[b], ids[a])] if i != j else [])
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["query", "neighbour", "similarity"])

    return run
