"""Line dedup by two Bloom filters: one of keys seen once, one of keys seen again.

The documents are laid out in blocks (blocks.py), which are never moved. A block sends the hashes of its distinct keys
to the filters, cut by ranges of hashes. A range has two Bloom filters of its own: a key that a second block sends, or
that one block has in two documents, goes to the second filter. The block is answered one bit for each key: whether the
second filter holds it. Only keys that it holds are shuffled as text, for the exact count of documents and the choice
of the one that keeps the line; the verdicts return to the blocks. The number of ranges follows the number of lines, so
filters don't fill up and no task's memory grows with the input; a hot key costs one entry a block.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys under 20 code points
are never dropped. Null or empty text is one empty line. Repeated rows with one id are one document. All null ids are
one document together that never wins over another. An empty table gives no rows. Other columns pass unchanged,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrewell.llm.blocks import Block, Blocks, each_block
from timbrewell.llm.common import discard, durable, durable_at, fresh

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bits of a filter for each key of a range, and keys of a range.
BITS_A_KEY, KEYS_A_RANGE = 16, 500_000
_BLANK = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def key_of(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _long_enough(key: bytes) -> bool:
    n = len(key)
    return n >= LEAST_CHARS and (key.isascii() or n - sum((b & 0xC0) == 0x80 for b in key) >= LEAST_CHARS)


class BlockKeys:
    """The distinct keys of a block, numbered as they first occur, and the key number of each line (-1: too short)."""

    def __init__(self, block: Block):
        numbers: dict[bytes, int] = {}
        self.lines = [text.split(b"\n") for text in block.texts()]
        self.of: list[list[int]] = []
        for lines in self.lines:
            own = []
            for line in lines:
                key = key_of(line) if len(line) >= LEAST_CHARS else b""
                own.append(numbers.setdefault(key, len(numbers)) if _long_enough(key) else -1)
            self.of.append(own)
        self.keys = list(numbers)

    def twice(self, ids: np.ndarray) -> np.ndarray:
        """Whether two documents of the block hold the key."""
        first: list[int | None] = [None] * len(self.keys)
        out = np.zeros(len(self.keys), bool)
        for doc, own in zip(ids.tolist(), self.of, strict=True):
            for k in own:
                if k >= 0 and first[k] != doc:
                    if first[k] is None:
                        first[k] = doc
                    else:
                        out[k] = True
        return out

    def holders(self, ids: np.ndarray, chosen: list[int]) -> list[list[int | None]]:
        """Up to LEAST_DOCS ids that hold each chosen key, and the largest."""
        held: dict[int, set[int]] = {k: set() for k in chosen}
        for doc, own in zip(ids.tolist(), self.of, strict=True):
            for k in own:
                if k in held:
                    held[k].add(doc)
        return [[None if x == _NO_ID else x for x in sorted({*sorted(held[k])[:LEAST_DOCS], max(held[k])})] for k in chosen]


# ---------------------------------------------------------------- the filters


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Three places in a filter for each hash."""
    low = np.uint64(bits - 1)
    return np.stack([hashes & low, (hashes >> np.uint64(21)) & low, ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) & low])


class Bloom:
    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(bits // 8, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = _places(hashes, self.bits)
        return ((self.table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)

    def put(self, hashes: np.ndarray) -> None:
        at = _places(hashes, self.bits)
        np.bitwise_or.at(self.table, (at >> np.uint64(3)).ravel(), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8).ravel())


def _filter(table: pa.Table) -> pa.Table:
    """Both filters over the keys of one range, and for each block a bit for each of its keys."""
    rows = table.select(["block", "part", "hashes", "twice"]).to_pylist()
    hashes = [np.frombuffer(r["hashes"], "<u8") for r in rows]
    total, bits = sum(map(len, hashes)), 1 << 12
    while bits < total * BITS_A_KEY:
        bits *= 2
    once, again = Bloom(bits), Bloom(bits)
    for r, held in zip(rows, hashes, strict=True):
        twice = np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(held)).astype(bool)
        again.put(held[twice | once.has(held)])
        once.put(held)
    answers = [np.packbits(again.has(held)).tobytes() for held in hashes]
    columns = [pa.array([r[c] for r in rows], t) for c, t in (("block", pa.int64()), ("part", pa.int32()))]
    return pa.Table.from_arrays([*columns, pa.array([len(x) for x in hashes], pa.int32()), pa.array(answers, pa.binary())], ["block", "part", "n", "again"])


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _ranges(hashes: np.ndarray, log_parts: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The order of the hashes, their ranges in that order, and where each range begins and ends."""
    order = np.argsort(hashes, kind="stable")
    part = (hashes[order] >> np.uint64(64 - log_parts)).astype(np.int64) if log_parts else np.zeros(len(order), np.int64)
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
    return order, part, list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def suspects(blocks: Blocks, log_parts: int) -> DataFrame:
    """block and the bits of the second filter for the block's keys."""

    def ask(block: Block) -> Iterator[pa.RecordBatch]:
        keys = BlockKeys(block)
        if not keys.keys:
            return
        hashes = _hashes(keys.keys)
        twice = keys.twice(block.ids)
        order, part, cuts = _ranges(hashes, log_parts)
        rows = [(block.number, int(part[a]), hashes[order[a:b]].tobytes(), np.packbits(twice[order[a:b]]).tobytes()) for a, b in cuts]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "part", "hashes", "twice"])

    sent = each_block(blocks.rows, ask, "block long, part int, hashes binary, twice binary")
    found = sent.groupBy("part").applyInArrow(_filter, "block long, part int, n int, again binary")
    return found.groupBy("block").agg(F.collect_list(F.struct("part", "n", "again")).alias("found"))


# ---------------------------------------------------------------- the exact count


def _suspected(blocks: Blocks, found: DataFrame, log_parts: int) -> DataFrame:
    """key, block, number (of the key in its block) and ids: up to LEAST_DOCS holders and the largest."""

    def pick(block: Block, answers: list) -> Iterator[pa.RecordBatch]:
        keys = BlockKeys(block)
        order, _, cuts = _ranges(_hashes(keys.keys), log_parts)
        bits = [np.unpackbits(np.frombuffer(x["again"], np.uint8), count=x["n"]) for x in sorted(answers, key=lambda x: x["part"])]
        if [len(x) for x in bits] != [b - a for a, b in cuts]:
            raise ValueError("an answer is missing")
        there = np.sort(order[np.concatenate(bits).astype(bool)]).tolist()
        if there:
            ids = keys.holders(block.ids, there)
            columns = [pa.array([keys.keys[k] for k in there], pa.binary()), pa.array([block.number] * len(there), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(there, pa.int32()), pa.array(ids, pa.list_(pa.int64()))], ["key", "block", "number", "ids"])

    return each_block(blocks.only(found), pick, "key binary, block long, number int, ids array<long>", "found")


def dropped(blocks: Blocks) -> DataFrame:
    """block and lost: the numbers of the block's keys that repeat, each with the id that keeps its lines."""
    lines = blocks.rows.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n")).first()["n"]
    log_parts = max(0, (lines // KEYS_A_RANGE).bit_length())
    found = durable(suspects(blocks, log_parts), "found")
    suspected, path = durable_at(_suspected(blocks, found, log_parts), "suspects")
    counted = suspected.select("key", F.explode("ids").alias("id")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    # written, so that the join has plain shuffles on both sides and a hot key's partition can be split
    repeats = durable(counted.where(F.col("n") >= LEAST_DOCS).select("key", "last"), "repeats")
    lost = suspected.select("key", "block", "number").join(repeats, "key")
    out = durable(lost.groupBy("block").agg(F.collect_list(F.struct("number", "last")).alias("lost")), "lost")
    discard(blocks.spark, path)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut to the lines that stay, and __lines and __dropped: the counts before and of dropped ones.

    Where docs have columns of these names, the counts' names get another underscore.
    """
    count, drop = fresh("__lines", docs.columns), fresh("__dropped", docs.columns)
    blocks = Blocks(docs, "lines")
    lost = dropped(blocks)
    columns = [c for c in docs.columns if c != "text"]
    schema = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast("string").alias("text")).schema.add(count, "long").add(drop, "long")

    def cut(block: Block, verdicts: list | None) -> Iterator[pa.RecordBatch]:
        if verdicts:
            keys = BlockKeys(block)
            keeper = {x["number"]: x["last"] for x in verdicts}
            texts, counts, gone = [], [], []
            for doc, lines, own in zip(block.ids.tolist(), keys.lines, keys.of, strict=True):
                stay = [x for x, k in zip(lines, own, strict=True) if k < 0 or keeper.get(k, doc) == doc]
                texts.append(b"\n".join(stay))
                counts.append(len(lines))
                gone.append(len(lines) - len(stay))
        else:
            texts = block.texts()
            counts, gone = [x.count(b"\n") + 1 for x in texts], [0] * len(texts)
        held = [pa.array([x.decode() for x in texts], pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
        yield pa.RecordBatch.from_arrays([*block.extra.columns, *held], [*block.extra.schema.names, "text", count, drop])

    out = each_block(blocks.joined(lost), cut, schema, "lost")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], count, drop)


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each row."""
    rows = dedup_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
l AS (SELECT doc_id, rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
j AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid
"""
