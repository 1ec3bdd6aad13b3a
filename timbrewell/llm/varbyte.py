"""Token ids in files: frequency-ranked ids, byte-aligned lengths, control bytes apart from data bytes.

A first pass counts ids; the vocabulary's ranks by falling frequency are the dictionary (its size is the
vocabulary's). Ranks are stored in one to four bytes; two bits each, four to a control byte, say how many. A block is

    magic TWV1 | u32 documents | u64 values | one byte for each document: its id is there | i64 ids | u32 lengths
    | control bytes | data bytes

and the files are Parquet containers with a block in each row, so that Spark's committer makes them whole or absent.
Blocks follow doc_id: neighbouring ids form a group, a task writes the blocks of a group in order. Null ids, or an id
that many rows have, are groups of their own, cut by ranges of checksums. Reading decodes a block with one table lookup
by control byte and needs no Python loop over values.

Null text counts as empty: the end id alone. A null doc_id comes first. Rows with one id come in the order of their
ids' checksums; repeated rows are written as often as they occur. An empty table gives no blocks and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrewell.llm.common import RangeGroups, arrow_map, bounded, durable, shared_path, tidy
from timbrewell.llm.tokens import tokenizer_path, word_tokens

END_ID = 2
MAGIC = b"TWV1"
BLOCK_VALUES = 1 << 19
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    quads = np.append(code, np.zeros(-len(code) % 4, np.uint8)).reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Inverse of encode_values, by table lookup."""
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    data = np.append(data, np.zeros(3, np.uint8)).astype(np.uint32)
    values = data[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        values[more] |= data[at[more] + k] << np.uint32(8 * k)
    return values


def write_block(ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    control, data = encode_values(values)
    there = bytes(x is not None for x in ids)
    return b"".join([MAGIC, struct.pack("<IQ", len(ids), len(values)), there, np.array([x or 0 for x in ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), control, data])


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and values."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n = struct.unpack_from("<IQ", block, 4)
    at = 16
    there = block[at : at + docs]
    ids = np.frombuffer(block, "<i8", docs, at + docs).tolist()
    lengths = np.frombuffer(block, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    control = np.frombuffer(block, np.uint8, -(-n // 4), at)
    values = decode_values(control, np.frombuffer(block, np.uint8, offset=at + len(control)), n)
    return [i if t else None for i, t in zip(ids, there, strict=True)], lengths, values


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, rows_each: int = 4000) -> DataFrame:
    """grp, doc_id, crc and ids (16-bit) of each document, written once."""
    groups = RangeGroups(docs, "doc_id", rows_each, hot=True)

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u2").tobytes()
        every, bounds = word_tokens(tokenizer, True).encode(batch["text"])
        ids = [every[a:b].tobytes() + end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        crc = pa.array([zlib.crc32(x) for x in ids], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], crc, pa.array(ids, pa.binary())], ["doc_id", "crc", "ids"])

    rows = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "doc_id long, crc long, ids binary")
    return durable(rows.select(groups.key(F.col("crc")).alias("grp"), "doc_id", "crc", "ids"), "ids")


def frequencies(rows: DataFrame) -> np.ndarray:
    """Ids by falling frequency (equal ones by id); as long as the highest id needs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            column = batch["ids"]
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            body = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            total += np.bincount(body.view("<u2"), minlength=1 << 16)
        there = np.flatnonzero(total)
        if len(there):
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["id", "n"])

    found = rows.select("ids").mapInArrow(tidy(count), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    order = np.lexsort((found["id"].to_numpy(), -found["n"].to_numpy()))
    return found["id"].to_numpy()[order].astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, rows_each: int = 4000) -> None:
    """Files of blocks at path/blocks and the dictionary at path/dictionary."""
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, rows_each)
    order = frequencies(rows)
    rank = np.zeros(1 << 16, np.uint32)
    rank[order] = np.arange(len(order))
    table = spark.createDataFrame([(k, int(x)) for k, x in enumerate(order)], "rank int, id int")
    table.coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, base, number, n = None, 0, 0, 0
        ids: list[int | None] = []
        parts: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            values = rank[np.concatenate(parts)]
            row = [held, number, base, len(values), write_block(ids, [len(x) for x in parts], values)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["grp", "number", "base", "n", "block"])

        for batch in batches:
            for grp, doc, raw in zip(batch["grp"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if parts and (grp != held or n >= BLOCK_VALUES):
                    yield done()
                    base, number = (base + n, number + 1) if grp == held else (0, 0)
                    ids, parts, n = [], [], 0
                held = grp
                ids.append(doc)
                parts.append(np.frombuffer(raw, "<u2"))
                n += len(parts[-1])
        if parts:
            yield done()

    dealt = rows.repartition("grp").sortWithinPartitions("grp", F.col("doc_id").asc_nulls_first(), "crc")
    with bounded(spark):
        dealt.mapInArrow(tidy(blocks), "grp long, number long, base long, n long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")


def _bases(blocks: DataFrame) -> DataFrame:
    """Values before each group, in two levels, so that no window holds more than a share of the groups."""
    sums = blocks.groupBy("grp").agg(F.sum("n").alias("n")).withColumn("_c", F.floor(F.col("grp") / 4096))
    outer = sums.groupBy("_c").agg(F.sum("n").alias("_n")).withColumn("_outer", F.sum("_n").over(Window.orderBy("_c")) - F.col("_n"))
    inner = F.sum("n").over(Window.partitionBy("_c").orderBy("grp")) - F.col("n")
    return sums.withColumn("_inner", inner).join(outer.select("_c", "_outer"), "_c").select(F.col("grp").alias("_g"), (F.col("_inner") + F.col("_outer")).alias("_before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document in the files."""
    table = spark.read.parquet(f"{path}/dictionary").toPandas().sort_values("rank")
    order = table["id"].to_numpy().astype("<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    placed = blocks.join(_bases(blocks.select("grp", "n")), F.col("grp") == F.col("_g")).select(F.col("base") + F.col("_before"), "block").toDF("at", "block")

    def decode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, block in zip(batch["at"].to_pylist(), batch["block"].to_pylist(), strict=True):
            ids, lengths, values = read_block(block)
            raw = order[values]
            end = np.cumsum(lengths, dtype=np.int64)
            offsets = pa.py_buffer(np.append(0, end * 4).astype(np.int32).tobytes())
            body = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at + end - lengths), pa.array(lengths.astype(np.int64)), body], ["doc_id", "start", "n_tokens", "ids"])

    return arrow_map(placed, decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, rows_each: int = 4000) -> DataFrame:
    """Writes the files, reads them back and digests them."""
    spark = docs.sparkSession
    path = shared_path(spark, "varbyte")
    write(docs, path, tokenizer, end_id, rows_each)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
