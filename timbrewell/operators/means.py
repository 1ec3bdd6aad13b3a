"""K-means of many sizes and seeds side by side: each pass over the rows serves all fits that still move."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrewell.sources.files import scratch

#: Passes of a fit at most after its centres were drawn, and the move below which a centre rests.
PASSES, RESTS = 300, 1e-4
#: Values of a stored piece, rows that are multiplied at once, and tasks whose sums the driver adds up itself.
PIECE, AT_ONCE, FEW_TASKS = 500_000, 2048, 32
_PART = "fit int, score double, body binary"


class KMeans:
    """k centres drawn by k-means++ from a seed and moved to their rows' mean until they rest.

    fit takes vectors, or a Sweep, in which the passes over them are shared with the other fits asked of it.
    """

    def __init__(self, k: int, seed: int, featuresCol: str = "features", predictionCol: str = "prediction"):  # noqa: N803  names of pyspark.ml
        self.k, self.seed, self.features, self.prediction = k, seed, featuresCol, predictionCol

    def fit(self, vectors: DataFrame | Sweep) -> Model:
        sweep = vectors if isinstance(vectors, Sweep) else Sweep(vectors, [(self.k, self.seed)], self.features)
        centres, cost = sweep.found()[self.k, self.seed]
        return Model(centres, cost, self.features, self.prediction)


class Model:
    def __init__(self, centres: np.ndarray, cost: float, features: str, prediction: str):
        self.centres, self.features, self.prediction = centres, features, prediction
        self.summary = SimpleNamespace(trainingCost=cost)

    def transform(self, vectors: DataFrame) -> DataFrame:
        """vectors with the number of the nearest centre, the first of equals."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(rows: pd.Series) -> pd.Series:
            return pd.Series(_squares(np.stack(rows), centres).argmin(axis=1).astype(np.int32)) if len(rows) else pd.Series([], dtype=np.int32)

        return vectors.withColumn(self.prediction, nearest(vector_to_array(self.features)))


class Sweep:
    """Fits of (k, seed) on the same vectors.

    Equal vectors become one row with their count as its weight, which leaves all sums as they are. The rows are written
    once, in pieces of bounded size; what a pass brings to the driver is one sum a centre.
    """

    def __init__(self, vectors: DataFrame, asked: list[tuple[int, int]], features: str = "features"):
        self.vectors, self.asked, self.features, self._found = vectors, list(dict.fromkeys(asked)), features, None

    def found(self) -> dict[tuple[int, int], tuple[np.ndarray, float]]:
        """Centres and inertia of each fit."""
        if self._found is None:
            self._found = self._run()
        return self._found

    def _run(self) -> dict:
        spark, path = self.vectors.sparkSession, scratch(self.vectors.sparkSession, "vectors")
        rows = self.vectors.where(F.col(self.features).isNotNull()).groupBy(vector_to_array(self.features).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w"))
        rows.select("v", "w", F.xxhash64("v").alias("h")).mapInArrow(_pieces, "v binary, w binary, h binary").write.parquet(path)
        laid = spark.read.schema("v binary, w binary, h binary").parquet(path)
        few = laid.rdd.getNumPartitions() <= FEW_TASKS

        def over(function, together) -> dict:
            parts = laid.mapInArrow(function, _PART)
            if not few:
                parts = parts.groupBy("fit").applyInArrow(_joined(together), _PART)
            return together([(r["fit"], r["score"], bytes(r["body"])) for r in parts.collect()])

        centres: dict[int, np.ndarray] = {}
        drawing = set(range(len(self.asked)))
        for step in range(max(k for k, _ in self.asked)):
            drawing = {f for f in drawing if self.asked[f][0] > step}
            drawn = over(_draws({f: (self.asked[f][1], centres.get(f)) for f in drawing}, step), _least)
            drawing &= set(drawn)  # with fewer different rows than k each is a centre
            for f in drawing:
                one = np.frombuffer(drawn[f][1])[None]
                centres[f] = np.concatenate([centres[f], one]) if f in centres else one
        if not centres:
            raise ValueError("k-means needs at least one vector")
        costs, moving = {}, set(centres)
        for _ in range(PASSES):
            sums = over(_sums({f: centres[f] for f in sorted(moving)}), _added)
            for f in sorted(moving):
                costs[f], body = sums[f][0], np.frombuffer(sums[f][1]).reshape(len(centres[f]), -1)
                held = body[:, -1:] > 0
                moved = np.where(held, body[:, :-1] / np.where(held, body[:, -1:], 1.0), centres[f])
                if ((moved - centres[f]) ** 2).sum(axis=1).max() <= RESTS**2:
                    moving.discard(f)
                else:
                    centres[f] = moved
            if not moving:
                break
        else:  # the cost of the last centres
            costs |= {f: x[0] for f, x in over(_sums({f: centres[f] for f in sorted(moving)}), _added).items()}
        return {asked: (centres[f], float(costs[f])) for f, asked in enumerate(self.asked)}


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; what is lost to rounding counts as 0."""
    sizes = (rows * rows).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None]
    found = sizes - 2 * (rows @ centres.T)
    return np.where(found <= 1e-12 * sizes, 0.0, found)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        v = np.asarray(batch["v"].flatten(), dtype=np.float64).reshape(len(batch), -1)
        w, h = batch["w"].to_numpy(), batch["h"].to_numpy()
        step = max(1, PIECE // max(1, v.shape[1]))
        for k in range(0, len(w), step):
            yield pa.record_batch([pa.array([x[k : k + step].tobytes()], pa.binary()) for x in (v, w, h)], ["v", "w", "h"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, weights and hashes, some at once."""
    for batch in batches:
        for v, w, h in zip(*(batch[c] for c in "vwh"), strict=True):
            w, h = np.frombuffer(w.as_buffer()), np.frombuffer(h.as_buffer(), np.uint64)
            v = np.frombuffer(v.as_buffer()).reshape(len(w), -1)
            for k in range(0, len(w), AT_ONCE):
                yield v[k : k + AT_ONCE], w[k : k + AT_ONCE], h[k : k + AT_ONCE]


def _parts(found: dict[int, tuple[float, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(found), pa.int32()), pa.array([x[0] for x in found.values()], pa.float64()), pa.array([x[1] for x in found.values()], pa.binary())], ["fit", "score", "body"])


def _mixed(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers over 0 up to 1, the same for a row, seed and step wherever the row lies."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2**53


def _draws(fits: dict[int, tuple[int, np.ndarray | None]], step: int):
    """For each fit the row whose exponential waiting time, at a rate of weight times squared distance, is the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, bytes]] = {}
        for v, w, h in _chunks(batches):
            for f, (seed, centres) in fits.items():
                rate = w if centres is None else w * _squares(v, centres).min(axis=1)
                with np.errstate(divide="ignore"):
                    waits = np.where(rate > 0, -np.log(_mixed(h, seed, step)) / rate, np.inf)
                at = int(waits.argmin())
                if waits[at] < best.get(f, (np.inf,))[0]:
                    best[f] = float(waits[at]), v[at].tobytes()
        yield _parts(best)

    return run


def _sums(fits: dict[int, np.ndarray]):
    """For each fit its inertia, and each centre's sum of rows and of weights."""
    cuts = np.cumsum([0, *map(len, fits.values())])
    every = np.concatenate(list(fits.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, sums = np.zeros(len(fits)), np.zeros((len(every), every.shape[1] + 1))
        for v, w, _ in _chunks(batches):
            far, own = _squares(v, every), np.zeros((len(v), len(every)))
            line = np.arange(len(v))
            for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                at = far[:, a:b].argmin(axis=1) + a
                costs[n] += (far[line, at] * w).sum()
                own[line, at] = w
            sums[:, :-1] += own.T @ v
            sums[:, -1] += own.sum(axis=0)
        yield _parts({f: (float(costs[n]), sums[cuts[n] : cuts[n + 1]].tobytes()) for n, f in enumerate(fits)})

    return run


def _least(parts: list[tuple[int, float, bytes]]) -> dict[int, tuple[float, bytes]]:
    best: dict[int, tuple[float, bytes]] = {}
    for f, score, body in parts:
        best[f] = min(best.get(f, (np.inf, b"")), (score, body))
    return best


def _added(parts: list[tuple[int, float, bytes]]) -> dict[int, tuple[float, bytes]]:
    costs: dict[int, float] = {}
    sums: dict[int, np.ndarray] = {}
    for f, score, body in parts:
        costs[f] = costs.get(f, 0.0) + score
        sums[f] = sums.get(f, 0.0) + np.frombuffer(body)
    return {f: (costs[f], sums[f].tobytes()) for f in costs}


def _joined(together):
    def run(table: pa.Table) -> pa.Table:
        found = together(list(zip(*(table[c].to_pylist() for c in ("fit", "score", "body")), strict=True)))
        return pa.Table.from_batches([_parts(found)])

    return run
