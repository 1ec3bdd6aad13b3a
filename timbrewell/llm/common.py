"""Shared helpers: durable intermediate tables, range groups, bounded Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. In one process (master local) a folder is made where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="timbrewell-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    if not _written:
        atexit.register(_remove_all)
    path = f"{shared_dir(spark)}/timbrewell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    remove(spark, path)
    _written[:] = [x for x in _written if x[1] != path]


@contextlib.contextmanager
def bounded(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Settings for what is run inside, and the caller's own again afterwards: Arrow batches of 16 MB at most."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": "16m"} | (more or {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. Also its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with bounded(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    return durable_at(df, name)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that nothing reads any more, and let Spark drop the shuffles that made them.

    Spark removes a shuffle's files once the driver has collected its last reference.
    """
    for path in paths:
        forget(spark, path)
    gc.collect()
    spark._jvm.System.gc()


def slices(texts: pa.Array, size: int = 8 << 20) -> Iterator[pa.Array]:
    """Runs of texts of about so many bytes together, so that a worker's arrays don't follow the batch."""
    if len(texts):
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        number = (upto - 1).clip(0) // size
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield texts.slice(a, b - a)


def joined(parts: list[tuple[np.ndarray, np.ndarray]], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of runs, put together."""
    if not parts:
        return np.zeros(0, kind), np.zeros(1, np.int64)
    shifts = np.cumsum([0, *(len(v) for v, _ in parts)])
    bounds = [b[:-1] + s for (_, b), s in zip(parts, shifts, strict=False)]
    return np.concatenate([v for v, _ in parts]), np.append(np.concatenate(bounds), shifts[-1])


#: What workers forget when a task ends: caches that are worth their memory within a task only.
forget_at_end: list[Callable[[], None]] = []


def tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, whose worker gives its memory back when a task ends: workers outlive tasks, and idle ones add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            for forget in forget_at_end:
                forget()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def fresh(name: str, columns: list[str]) -> str:
    """The name, with more underscores before it while a column has it."""
    while name in columns:
        name = f"_{name}"
    return name


def portions(batches: Iterator[pa.RecordBatch], rows: int = 2000, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, and with text of 8 MB of that column or one row."""
    for batch in batches:
        at = 0
        for part in slices(batch[text]) if text else [batch] if batch.num_rows else []:
            for k in range(0, len(part), rows):
                yield batch.slice(at + k, min(rows, len(part) - k))
            at += len(part)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, rows: int = 2000, text: str | None = None) -> DataFrame:
    """mapInArrow for functions of one batch, in portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, rows, text):
            yield from fn(batch)

    return df.mapInArrow(tidy(run), schema)


def _between(col: Column, bounds: list[int], lo: int, hi: int) -> Column:
    """Index of the range that holds col, as a balanced tree of comparisons."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(col <= F.lit(bounds[mid]), _between(col, bounds, lo, mid)).otherwise(_between(col, bounds, mid + 1, hi))


class RangeGroups:
    """Splits the values of a long column into groups of about rows_each rows that follow one another.

    The coarse ranges are quantiles of the column (at most max_ranges, so the expression is bounded); a range is
    cut into equal widths beyond that. Nulls come first. Only the column itself is read.

    With hot, a value that takes up more than one range (two of 256 on large tables), and nulls, are ranges of their
    own, which are cut by the second key of the order.
    """

    def __init__(self, df: DataFrame, column: str, rows_each: int, max_ranges: int = 256, hot: bool = False):
        stats = df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("there"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        self.rows = stats["n"]
        wanted = max(1, -(-self.rows // rows_each))
        ranges = min(wanted, max_ranges)
        self.bounds: list[int] = []
        #: Groups of each value that is a range of its own, None for nulls.
        self.hot: dict[int | None, int] = {None: max(1, -(-(stats["n"] - stats["there"]) // rows_each))} if hot else {}
        if ranges > 1 and stats["lo"] is not None:
            at = [i / ranges for i in range(1, ranges)]
            got = [int(x) for x in df.agg(F.percentile_approx(column, at, 20 * ranges).alias("q")).first()["q"]]
            several = [x for x, n in Counter(got).items() if n > 1] if hot else []
            if several:
                sizes = df.where(F.col(column).isin(several)).groupBy(F.col(column).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
                self.hot |= {r["v"]: -(-r["n"] // rows_each) for r in sizes}
            self.bounds = sorted({*got, *(x - 1 for x in several)})
        self.width = -(-wanted // max(1, ranges))
        self.parts = max(self.width, *self.hot.values()) if self.hot else self.width
        self.column = column
        self.edges = [stats["lo"] or 0, *self.bounds, stats["hi"] or 0]
        self.count = (len(self.bounds) + 1 + hot) * self.parts

    def key(self, second: Column | None = None) -> Column:
        """Number of the group, in the order of the column and, for hot values, of second: longs from 0 to 2**32 - 1."""
        col = F.col(self.column).cast("long")
        if not self.bounds:
            part = F.lit(0)
        else:
            part = _between(col, self.bounds, 0, len(self.bounds))
        sub = F.lit(0)
        if self.width > 1:
            lows = F.array(*[F.lit(int(x)) for x in self.edges[:-1]])
            widths = F.array(*[F.lit(max(1, -(-(int(b) - int(a) + 1) // self.width))) for a, b in zip(self.edges, self.edges[1:], strict=False)])
            sub = F.floor((col - F.element_at(lows, (part + 1).cast("int"))) / F.element_at(widths, (part + 1).cast("int")))
            sub = F.greatest(F.lit(0), F.least(F.lit(self.width - 1), sub))
        if second is not None and self.hot:
            cut = {value: F.shiftright(second * F.lit(n).cast("long"), 32) for value, n in self.hot.items()}
            for value in sorted(x for x in cut if x is not None):
                sub = F.when(col == value, cut[value]).otherwise(sub)
            return F.when(col.isNull(), cut[None]).otherwise((part.cast("long") + 1) * self.parts + sub).cast("long")
        return F.when(col.isNull(), F.lit(0)).otherwise(part.cast("long") * self.parts + sub).cast("long")
