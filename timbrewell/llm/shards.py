"""Sharding by size-tiered compaction (native: DataFrame operations and the file system's own rename).

Arrivals are appended as small immutable Parquet files, as many as the tasks that hold them. Shards of one tier (sizes
within a factor of FAN_IN) are merged FAN_IN at a time, over and over, until a merge would pass the target size; a
cascade of merges is planned from the files' sizes alone and carried out as one rewrite of the files concerned. Each
change writes a manifest and commits it by renaming a small file to the next version's name, which fails if that
version is there already, so readers see all of a change or none, and of two writers one must try again. Older
versions stay readable until vacuum() removes their files. A rewrite that loses executors leaves no version behind.

Rows are kept as they are, nulls, empty texts and repeated rows included, with all their columns. An empty arrival
makes no shard; a store without shards reads as an empty table of the store's schema.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from timbrewell.llm.blocks import spark_hash
from timbrewell.llm.common import shared_path

FAN_IN = 4
TARGET_BYTES = 128 << 20
LEAST_BYTES = 1 << 20
ROWS_A_SHARD = 2000
#: Arrivals that the query's documents come in, by a hash of their id.
ARRIVALS = 5
#: Files (some 200 bytes each) whose names are broadcast at most; more are joined by shuffle.
BROADCAST_FILES = 20_000


def tier(size: int, least: int = LEAST_BYTES) -> int:
    """0 for shards under FAN_IN times the least size, one more for each further factor."""
    return max(0, int(math.log(max(size, 1) / least, FAN_IN) + 1e-9)) if size >= least else 0


def plan_merges(shards: list[tuple[str, int]], target: int = TARGET_BYTES, least: int = LEAST_BYTES) -> list[list[str]]:
    """Groups of shards (path, bytes) to rewrite as one file each; the others stay.

    Tiers are worked through upwards; what a merge makes joins the end of its own tier.
    """
    tiers: dict[int, list[tuple[int, list[str]]]] = {}
    for path, size in shards:
        if size < target // 2:
            tiers.setdefault(tier(size, least), []).append((size, [path]))
    merged: list[tuple[int, list[str]]] = []
    level = min(tiers, default=0)
    while level <= max(tiers, default=-1):
        waiting, again = tiers.get(level, []), True
        while again:
            again, passed, run, size = False, [], [], 0
            for x in waiting:
                if size + x[0] > target * 5 // 4:
                    passed.append(x)
                    continue
                run.append(x)
                size += x[0]
                if len(run) == FAN_IN:
                    made = (size, [p for _, paths in run for p in paths])
                    if tier(size, least) == level:
                        passed.append(made)
                    else:
                        tiers.setdefault(tier(size, least), []).append(made)
                    again, run, size = True, [], 0
            waiting = run + passed
        merged += [x for x in waiting if len(x[1]) > 1]
        level += 1
    return [paths for _, paths in merged]


def slots_of(n: int) -> list[int]:
    """n numbers that Spark deals to n partitions, one to each, when it deals by their hash."""
    slots: list[int | None] = [None] * n
    at, missing = 0, n
    while missing:
        numbers = np.arange(at, at + 4 * n + 64)
        for number, slot in zip(numbers.tolist(), (spark_hash(numbers).astype(np.int64) % n).tolist(), strict=True):
            if slots[slot] is None:
                slots[slot], missing = number, missing - 1
        at += len(numbers)
    return slots


class ShardStore:
    """Versioned shards under a path that the driver and the executors share."""

    MANIFEST = "path string, bytes long, rows long, tier int"

    def __init__(self, spark: SparkSession, path: str, schema: StructType, target: int = TARGET_BYTES, least: int = LEAST_BYTES):
        self.spark, self.path, self.schema, self.target, self.least = spark, path.rstrip("/"), schema, target, least

    def _fs(self):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(self.path if ":" in self.path else f"file://{self.path}"), self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The latest version; 0 before any."""
        jvm, _ = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return max([int(x) for x in names if x.isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.MANIFEST)
        line = self.spark.read.text(f"{self.path}/versions/{version:010d}").first()["value"]
        return self.spark.read.schema(self.MANIFEST).parquet(json.loads(line)["manifest"])

    def _commit(self, version: int, shards: DataFrame) -> int:
        """Make shards the given version, or fail if another writer did so first."""
        jvm, context = self._fs()
        at = f"{self.path}/manifests/{uuid.uuid4().hex}"
        shards.write.parquet(at)
        hadoop = jvm.org.apache.hadoop.fs
        made = hadoop.Path(f"{at}.json")
        fs = made.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(made, False)
        out.write(bytearray(json.dumps({"version": version, "manifest": at}).encode()))
        out.close()
        fs.mkdirs(hadoop.Path(f"{self.path}/versions"))
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(fs.makeQualified(made), fs.makeQualified(hadoop.Path(f"{self.path}/versions/{version:010d}")), none)
        return version

    def _sizes(self, path: str) -> DataFrame:
        """The shards that were written to a folder."""
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(path)
        found = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
        # the tier as tier() has it: one more for each factor of FAN_IN
        steps = [F.when(F.col("bytes") >= self.least * FAN_IN**k, 1).otherwise(0) for k in range(1, 24) if self.least * FAN_IN**k < 1 << 62]
        return found.withColumn("tier", sum(steps, F.lit(0)))

    def append(self, rows: DataFrame, rows_a_shard: int = ROWS_A_SHARD) -> int:
        """Adds an arrival as small shards; the new version."""
        before = self.version()
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{c}`") for c in self.schema.names]).write.option("maxRecordsPerFile", str(rows_a_shard)).option("compression", "zstd").parquet(at)
        return self._commit(before + 1, self.manifest(before).unionByName(self._sizes(at)))

    def compact(self, planner: Callable[..., list[list[str]]] = plan_merges) -> int:
        """Merges similar shards; the new version, or the present one if there is nothing to merge.

        Only the names and sizes of shards that may be merged reach the driver.
        """
        before = self.version()
        shards = self.manifest(before)
        small = shards.where(F.col("bytes") < self.target // 2).orderBy("path").select("path", "bytes").collect()
        groups = planner([(r["path"], r["bytes"]) for r in small], self.target, self.least)
        if not groups:
            return before
        slots = slots_of(len(groups))
        of = [(path, slots[k]) for k, group in enumerate(groups) for path in group]
        rows = self.spark.read.schema(self.schema).parquet(*[path for path, _ in of])
        names = {c: f"c{i}" for i, c in enumerate(self.schema.names)}
        plain = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col("_metadata.file_path").alias("_path"))
        table = self.spark.createDataFrame(of, "_path string, _group long")
        dealt = plain.join(F.broadcast(table) if len(of) <= BROADCAST_FILES else table, "_path").drop("_path")
        at = f"{self.path}/data/{uuid.uuid4().hex}"
        # a task for each merged shard, which is at most a quarter over the target
        dealt = dealt.repartition(len(groups), "_group").select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_group").alias("__group"))
        dealt.write.option("compression", "zstd").partitionBy("__group").parquet(at)
        stay = shards.join(table.select(F.col("_path").alias("path")), "path", "left_anti")
        return self._commit(before + 1, stay.unionByName(self._sizes(at)))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def vacuum(self) -> int:
        """Removes files that the latest version doesn't use; how many."""
        jvm, _ = self._fs()
        now = self.version()
        if not now:
            return 0
        every = self.manifest(1).select("path")
        for v in range(2, now):
            every = every.unionByName(self.manifest(v).select("path"))
        gone = 0
        for row in every.distinct().join(self.manifest(now).select("path"), "path", "left_anti").toLocalIterator():
            at = jvm.org.apache.hadoop.fs.Path(row["path"])
            gone += bool(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, False))
        return gone


def shard_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text_md5, shard (number in the manifest), shard_rows, tier and version, from a compacted store.

    The store has all columns of docs. They come as several arrivals, with a compaction after each; files that it
    replaced go, as nothing reads older versions here.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, shared_path(spark, "shards"), docs.schema)
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        version = store.compact()
        store.vacuum()
    manifest = store.manifest(version)
    # numbered in the order of their paths: a window over files, of which there is one for some 100 MB of documents
    table = manifest.withColumn("shard", F.row_number().over(Window.orderBy("path")) - 1)
    table = table.select(F.col("path").alias("_path"), "shard", F.col("rows").alias("shard_rows"), "tier")
    rows = store.read(version)
    named = F.col("_metadata.file_path") if manifest.limit(1).count() else F.lit("")
    digest = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"), named.alias("_path"))
    return digest.join(table, "_path").drop("_path").withColumn("version", F.lit(version))
