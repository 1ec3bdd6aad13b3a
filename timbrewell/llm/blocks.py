"""Rows packed into blocks that are written once and never moved: later passes bring small answers to them.

A task packs the rows that it reads into blocks of some 2 MB of text. Their numbers are chosen so that Spark's own hash
puts them all into the bucket of the task's number, so writing the blocks as a bucketed table needs no shuffle, and a
join by block exchanges the other side alone. The number of buckets follows the number of tasks, so a bucket stays as
large as what a task reads.

A block's rows keep all their columns as they are, whatever their names; the text is held apart, as bytes one after
another. Null texts have no bytes and stay null in the rows. An empty table has no blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from timbrewell.llm.common import bounded, forget, shared_path, tidy

BLOCK_BYTES = 2 << 20
ROW_BITS = 16
BLOCK_ROWS = 1 << ROW_BITS
MOST_BUCKETS = 100_000
BLOCK = "block long, lines long, extra binary, sizes binary, body binary"


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash of a long, by which tables are bucketed."""

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    values = values.astype(np.int64).view(np.uint64)
    h = np.full(len(values), 42, np.uint32)
    for part in (values & np.uint64(0xFFFFFFFF), values >> np.uint64(32)):
        k = turn(part.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def block_numbers(task: int, buckets: int) -> Iterator[int]:
    """Numbers of the task's blocks: its own, and all in one bucket."""
    at, step = task << 27, 4 * buckets + 64
    while True:
        yield from (at + np.flatnonzero(spark_hash(np.arange(at, at + step)).astype(np.int64) % buckets == task % buckets)).tolist()
        at += step


# ---------------------------------------------------------------- a block


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def expand(raw: bytes) -> bytes:
    size = int.from_bytes(raw[:8], "little")
    return pa.decompress(raw[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


class Block:
    """A block, opened: its rows' other columns, and the texts one after another."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.extra = pa.ipc.open_stream(row["extra"]).read_next_batch()
        self.sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        self.body = np.frombuffer(expand(row["body"]), np.uint8)
        self.ids = np.array([-(1 << 63) if x is None else x for x in self.extra["doc_id"].to_pylist()], np.int64)

    def numbers(self) -> np.ndarray:
        """A number for each row, its own in the whole table."""
        return (self.number << ROW_BITS) + np.arange(len(self.sizes), dtype=np.int64)

    def table(self) -> pa.Table:
        """The rows with their texts, nulls as empty ones."""
        return pa.table([*self.extra.columns, self.strings()], [*self.extra.schema.names, "text"])

    def strings(self) -> pa.Array:
        offsets = np.append(0, np.cumsum(self.sizes)).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(self.sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.body.tobytes())])

    def texts(self) -> list[bytes]:
        ends = np.cumsum(self.sizes)
        raw = self.body.tobytes()
        return [raw[a:b] for a, b in zip((ends - self.sizes).tolist(), ends.tolist(), strict=True)]


def _row(number: int, rows: pa.Table, by_id: bool) -> pa.RecordBatch:
    texts = [(x or "").encode() for x in rows["text"].to_pylist()]
    extra = rows.drop_columns(["text"]).combine_chunks()
    if by_id:
        ids = rows["doc_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, texts[k]))
        texts, extra = [texts[k] for k in order], extra.take(pa.array(order, pa.int64()))
    sizes = np.array([len(x) for x in texts], "<u4")
    batch = extra.combine_chunks().to_batches()[0]
    held = [_ipc(batch), sizes.tobytes(), squeeze(b"".join(texts))]
    numbers = (number, sum(x.count(b"\n") for x in texts) + len(texts))
    columns = [*(pa.array([x], pa.int64()) for x in numbers), *(pa.array([x], pa.binary()) for x in held)]
    return pa.RecordBatch.from_arrays(columns, ["block", "lines", "extra", "sizes", "body"])


class Blocks:
    """The rows of docs (with doc_id and text) in blocks, written in buckets of their numbers.

    by_id: a block's rows follow one another by doc_id (nulls first) and text.
    """

    def __init__(self, docs: DataFrame, name: str, by_id: bool = False, size: int | None = None):
        size = size or BLOCK_BYTES
        self.spark: SparkSession = docs.sparkSession
        tasks = docs.rdd.getNumPartitions()
        self.buckets = buckets = max(1, min(MOST_BUCKETS, max(tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions")))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            numbers = block_numbers(task, buckets)
            held: list[pa.RecordBatch] = []
            much = rows = 0
            for batch in batches:
                at = 0
                for k, n in enumerate(len(x) if x else 0 for x in batch["text"].to_pylist()):
                    much, rows = much + n, rows + 1
                    if much >= size or rows >= BLOCK_ROWS:
                        held.append(batch.slice(at, k + 1 - at))
                        yield _row(next(numbers), pa.Table.from_batches(held), by_id)
                        held, much, rows, at = [], 0, 0, k + 1
                if at < batch.num_rows:
                    held.append(batch.slice(at))
            if held:
                yield _row(next(numbers), pa.Table.from_batches(held), by_id)

        self._tables: list[tuple[str, str]] = []
        self.rows = self.beside(docs.mapInArrow(tidy(run), BLOCK), name)

    def beside(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows made from blocks (with their numbers as block), written in the same buckets."""
        path, table = shared_path(self.spark, name), f"timbrewell_{uuid.uuid4().hex}"
        # a task writes one bucket, so with some open files the writer needs no sort
        with bounded(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": "8"}):
            rows.write.option("compression", "zstd").bucketBy(self.buckets, "block").option("path", path).saveAsTable(table)
        self._tables.append((table, path))
        return self.spark.table(table)

    def joined(self, answers: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """The blocks (or rows beside them) with the answers (a row for each block at most) that there are for them."""
        return (self.rows if rows is None else rows).join(answers.hint("shuffle_hash"), "block", "left")

    def only(self, answers: DataFrame) -> DataFrame:
        """The blocks that have an answer, with it."""
        return self.rows.join(answers.hint("shuffle_hash"), "block")

    def remove(self, beside_only: bool = False) -> None:
        """Remove the tables (or those beside the blocks), once nothing reads them any more."""
        for table, path in self._tables[int(beside_only) :]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            forget(self.spark, path)
        self._tables = self._tables[: int(beside_only)]


def each_block(rows: DataFrame, fn: Callable[..., Iterator[pa.RecordBatch]], schema: str, *more: str) -> DataFrame:
    """mapInArrow by blocks: fn gets a Block and the values of further columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield from fn(Block(row), *(row[c] for c in more))

    return rows.mapInArrow(tidy(run), schema)
