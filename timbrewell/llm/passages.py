"""Exact removal of repeated passages by a prefix-free parse of the corpus and its suffix array.

Rolling-hash triggers cut every text into phrases: the trigger of a 100-byte window is the leftmost of its 69
32-byte strings with the least hash, so equal windows have equal triggers. A phrase holds the windows of one trigger,
with the 99 bytes that its last window reaches beyond it, so each window lies in one phrase and the parse of a text is
the list of its phrases.

  - A trigger's string is looked up first: a phrase whose trigger occurs once in the corpus holds no repeat.
  - The other phrases go to tasks by ranges of their triggers' hashes, once a block. A task makes its dictionary of
    distinct phrases, in the order in which the parse has them first, and sorts all suffixes of the dictionary's phrases
    (their windows) stably. So the dictionary's suffix array and the parse's order together give the windows in corpus
    order: among equal neighbours the first is the first in the corpus, and all others are repeats.
  - A phrase's block is answered one bit for each window; a phrase that occurred before is a repeat as a whole.

Phrases are compared byte by byte. Hashes only choose triggers and tasks, and say which triggers are lone and which
phrases of one block are the same; two unlike triggers of one hash cost a needless look. Two unlike phrases of a block
that share a 64-bit hash would be taken for one: among n phrases of a block one in 2**65 / n**2.

Texts are laid out once in blocks of some 2 MB (blocks.py) and never moved: phrases go out and bits come back. A block's
phrases are made distinct before they are sent, so a passage in a third of all rows costs one entry a block, and the
number of ranges follows the size of the corpus. Memory follows the block, or the longest single text.

Null text counts as empty; texts under 100 bytes stay whole. A null doc_id comes first. Rows with one id come in a
fixed order (block, then text), so of repeated rows all but the first lose what they share. An empty table gives no
rows. Other columns pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrewell.llm.blocks import Block, Blocks, each_block, expand, squeeze
from timbrewell.llm.common import discard, durable, fresh
from timbrewell.llm.keys import MESSAGE, Distinct, answers_of, log_parts_of, message_batch

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
BLOCK_BYTES = 2 << 20
#: Bytes of the corpus for each task that sorts phrases; a share of them reaches it.
RANGE_BYTES = 4 << 20
_MASK = (1 << 64) - 1
PHRASES = "part int, block long, body binary, lengths binary, first binary, low long, width int, places binary"
FOUND = "block long, part int, n int, bits binary"
_BASE = 0x9E3779B97F4A7C15 | 1


class _Powers:
    """Powers of the base and of its inverse, as long as the longest block so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)
    random = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = max(n + 1, BLOCK_BYTES + (1 << 17))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Text:
    """The texts of a block, one after another, with their hashes and triggers."""

    def __init__(self, body: np.ndarray, sizes: np.ndarray):
        self.body, self.n = body, len(body)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        _Powers.reach(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_Powers.random[body] * _Powers.up[: self.n], out=self.sums[1:])

    def hashes(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Hashes of body[at:to], with the lengths."""
        h = (self.sums[to] - self.sums[at]) * _Powers.down[at]
        return _mix(h + (to - at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def window_starts(self) -> np.ndarray:
        """Where a whole window of one text starts."""
        change = np.zeros(self.n + 1, np.int32)
        long_ = self.ends - self.starts >= WINDOW
        np.add.at(change, self.starts[long_], 1)
        np.add.at(change, self.ends[long_] - WINDOW + 1, -1)
        return np.cumsum(change[:-1]) > 0

    def triggers(self, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending places of the triggers, and for each place the number of its window's trigger (-1: no window)."""
        index = np.full(self.n, -1, np.int64)
        if self.n < WINDOW:
            return np.zeros(0, np.int64), index
        grams = (self.sums[GRAM:] - self.sums[:-GRAM]) * _Powers.down[: self.n - GRAM + 1]
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        # the upper half is the hash, the lower one the place: the least value is the leftmost least hash
        ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = (_sliding(ranked, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        there = np.flatnonzero(valid)
        used = np.zeros(self.n, bool)
        used[least[there]] = True
        index[there] = np.cumsum(used)[least[there]] - 1
        return np.flatnonzero(used), index


def _sliding(values: np.ndarray, keep: np.ufunc) -> np.ndarray:
    """keep over each SPAN neighbours."""
    width = 1
    while width * 2 <= SPAN:
        values = keep(values[:-width], values[width:])
        width *= 2
    rest = SPAN - width
    return keep(values[: len(values) - rest], values[rest:]) if rest else values


# ---------------------------------------------------------------- the passes


def _triggers(block: Block) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray, Distinct]:
    text = Text(block.body, block.sizes)
    valid = text.window_starts()
    triggers, index = text.triggers(valid)
    return text, valid, triggers, index, Distinct(text.hashes(triggers, triggers + GRAM), np.searchsorted(text.ends, triggers, "right"))


def _flat(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of runs of n from each of at."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Phrases:
    """The phrases of a block whose triggers occur elsewhere too, distinct ones by ranges of their triggers' hashes."""

    def __init__(self, block: Block, answers: list[dict], log_parts: int):
        text, valid, triggers, index, strings = _triggers(block)
        self.block, self.body = block, text.body
        chosen = np.flatnonzero(strings.shared(answers, 0))
        starts = np.flatnonzero(valid)
        of = index[starts]
        self.at = starts[np.searchsorted(of, chosen)]
        self.windows = starts[np.searchsorted(of, chosen, "right") - 1] + 1 - self.at
        texts = np.searchsorted(text.ends, self.at, "right")
        self.distinct = Distinct(text.hashes(self.at, self.at + self.windows + WINDOW - 1), texts)
        keys = strings.keys[strings.of[chosen[self.distinct.at]]]
        order = np.argsort(keys, kind="stable")
        #: The first occurrence of each distinct phrase, as they are sent, and where the ranges begin and end.
        self.firsts = self.distinct.at[order]
        self.part = (keys[order] >> np.uint64(64 - log_parts)).astype(np.int64) if log_parts else np.zeros(len(order), np.int64)
        self.cuts = np.append(np.flatnonzero(np.append(True, self.part[1:] != self.part[:-1])), len(order)) if len(order) else np.zeros(1, np.int64)

    def messages(self) -> list[tuple]:
        if not len(self.firsts):
            return []
        at, lengths = self.at[self.firsts], self.windows[self.firsts] + WINDOW - 1
        body, upto = self.body[_flat(at, lengths)], np.append(0, np.cumsum(lengths))
        ids = self.block.ids[self.distinct.texts[self.firsts]]
        low = int(ids.min())
        far = int(ids.max()) - low
        width = 2 if far < 1 << 16 else 4 if far < 1 << 32 else 8
        past = (ids.astype(np.uint64) - np.uint64(low & _MASK)).astype(f"<u{width}")
        rows = []
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            rows.append((int(self.part[a]), self.block.number, squeeze(body[upto[a] : upto[b]].tobytes()), lengths[a:b].astype("<u2").tobytes(), past[a:b].tobytes(), low, width, at[a:b].astype("<u4").tobytes()))
        return rows

    def repeats(self, found: list[dict]) -> np.ndarray:
        """Which windows, by where they start, are repeats."""
        out = np.zeros(len(self.body), bool)
        if not len(self.firsts):
            return out
        bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in sorted(found, key=lambda x: x["part"])]
        n = self.windows[self.firsts]
        if sum(map(len, bits)) != n.sum():
            raise ValueError("an answer is missing")
        again = np.ones(len(self.at), bool)
        again[self.firsts] = False
        out[_flat(self.at[again], self.windows[again])] = True
        out[_flat(self.at[self.firsts], n)] = np.concatenate(bits).astype(bool)
        return out


def suffix_array(body: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows of phrases, which are one after another in body, and which repeat an earlier window.

    Windows are numbered as they come; equal ones keep that order.
    """
    n = lengths - (WINDOW - 1)
    starts = _flat(np.cumsum(lengths) - lengths, n)
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(body, WINDOW)[starts]).view(f"S{WINDOW}").ravel()
    order = np.argsort(windows, kind="stable")
    there = windows[order]
    again = np.zeros(len(order), bool)
    again[order[1:]] = there[1:] == there[:-1]
    return order, again


def _sorted(table: pa.Table) -> pa.Table:
    """For each message of a range a bit for each window of its phrases: an equal one comes earlier in the corpus."""
    rows = table.select(["block", "part", "body", "lengths", "first", "low", "width", "places"]).to_pylist()
    body = np.frombuffer(b"".join(expand(r["body"]) for r in rows), np.uint8)
    lengths = [np.frombuffer(r["lengths"], "<u2").astype(np.int64) for r in rows]
    ids = np.concatenate([(np.frombuffer(r["first"], f"<u{r['width']}").astype(np.uint64) + np.uint64(r["low"] & _MASK)).astype(np.int64) for r in rows])
    places = np.concatenate([np.frombuffer(r["places"], "<u4") for r in rows])
    sizes = [len(x) for x in lengths]
    every = np.concatenate(lengths)
    block = np.repeat(np.array([r["block"] for r in rows]), sizes)
    # the dictionary: distinct phrases, in the order of their first places in the parse
    ends = np.append(0, np.cumsum(every))
    order = np.lexsort((places, block, ids))
    phrases = pa.Array.from_buffers(pa.large_binary(), len(every), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)]).take(pa.array(order)).dictionary_encode()
    entry = np.empty(len(every), np.int64)
    entry[order] = phrases.indices.to_numpy()
    held = order[np.unique(entry[order], return_index=True)[1]]
    _, again = suffix_array(body[_flat(ends[held], every[held])], every[held])
    # a phrase that is not its entry's first is a repeat as a whole
    n = every - (WINDOW - 1)
    bits = np.ones(int(n.sum()), bool)
    upto = np.append(0, np.cumsum(n))
    bits[_flat(upto[held], n[held])] = again
    cuts = upto[np.cumsum([0, *sizes])].tolist()
    columns = [pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int32()), pa.array(np.diff(cuts), pa.int32())]
    return pa.Table.from_arrays([*columns, pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["block", "part", "n", "bits"])


def _finish(block: Block, repeats: np.ndarray, whole_characters: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Removed bytes and runs of each text, and the bytes that stay."""
    n = len(block.body)
    ends = np.cumsum(block.sizes)
    starts = ends - block.sizes
    upto = np.cumsum(repeats, dtype=np.int64)
    covered = upto > 0 if n < WINDOW else np.concatenate([upto[:WINDOW] > 0, upto[WINDOW:] > upto[:-WINDOW]])
    if whole_characters and n:
        heads = np.flatnonzero((block.body & 0xC0) != 0x80)
        covered = np.repeat(np.logical_and.reduceat(covered, heads), np.diff(np.append(heads, n)))
    gone = np.append(0, np.cumsum(covered, dtype=np.int64))
    first = covered & np.append(True, ~covered[:-1])
    first[starts[starts < n]] |= covered[starts[starts < n]]
    runs = np.append(0, np.cumsum(first, dtype=np.int64))
    stays = block.body[~covered].tobytes()
    removed = gone[ends] - gone[starts]
    kept_ends = ends - gone[ends]
    kept_starts = starts - gone[starts]
    return removed, runs[ends] - runs[starts], [stays[a:b] for a, b in zip(kept_starts.tolist(), kept_ends.tolist(), strict=True)]


def dedup_passages(docs: DataFrame, whole_characters: bool = False, digest: bool = False) -> DataFrame:
    """docs with the bytes that stay in text, and __bytes, __removed and __spans: size before, bytes and runs removed.

    text is binary, or a string if only whole characters go, or with digest the SHA-256 in hex of what stays. Where docs
    have columns of these names, the counts' names get another underscore.
    """
    added = [fresh(c, docs.columns) for c in ("__bytes", "__removed", "__spans")]
    spark = docs.sparkSession
    blocks = Blocks(docs, "passages", by_id=True, size=BLOCK_BYTES)
    total = blocks.rows.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n")).first()["n"] * 3
    log_parts = log_parts_of(total // 35)

    log_ranges = log_parts_of(total, RANGE_BYTES)

    def ask(block: Block) -> Iterator[pa.RecordBatch]:
        if rows := _triggers(block)[4].messages(block, 0, log_parts):
            yield message_batch(rows)

    def send(block: Block, answers: list | None) -> Iterator[pa.RecordBatch]:
        if rows := Phrases(block, answers or [], log_ranges).messages():
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PHRASES.split(", ")])

    # what is written here is small, bits of the blocks; the messages' shuffles go as soon as it is
    answers = durable(answers_of(each_block(blocks.rows, ask, MESSAGE)), "answers")
    discard(spark)
    told = each_block(blocks.joined(answers), send, PHRASES, "answers").groupBy("part").applyInArrow(_sorted, FOUND)
    found = durable(told.groupBy("block").agg(F.collect_list(F.struct("part", "n", "bits")).alias("found")), "found")
    discard(spark)

    columns = [c for c in docs.columns if c != "text"]
    kind = "binary" if not (whole_characters or digest) else "string"
    schema = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").cast(kind).alias("text")).schema
    for c in added:
        schema = schema.add(c, "long")

    def finish(block: Block, shared: list | None, got: list | None) -> Iterator[pa.RecordBatch]:
        gone = Phrases(block, shared or [], log_ranges).repeats(got or [])
        removed, runs, kept = _finish(block, gone, whole_characters)
        if digest:
            texts = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
        elif whole_characters:
            texts = pa.array([x.decode() for x in kept], pa.string())
        else:
            texts = pa.array(kept, pa.binary())
        values = [pa.array(x.astype(np.int64)) for x in (block.sizes, removed, runs)]
        yield pa.RecordBatch.from_arrays([*block.extra.columns, texts, *values], [*block.extra.schema.names, "text", *added])

    out = each_block(blocks.joined(answers.join(found, "block", "left")), finish, schema, "answers", "found")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *added)


def passage_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    rows = dedup_passages(docs.select("doc_id", "text"), digest=True)
    return rows.select("doc_id", F.col("__bytes").alias("n_bytes"), F.col("__removed").alias("n_removed"), F.col("__spans").alias("n_spans"), F.col("text").alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS rid FROM documents),
w AS (SELECT rid, i, md5(substring(h, 2 * i + 1, {2 * WINDOW})) AS s FROM (SELECT rid, h, unnest(range(0, greatest(length(h) // 2 - {WINDOW - 1}, 0))) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY s ORDER BY rid, i) AS n FROM w) WHERE n > 1),
g AS (SELECT rid, i, sum(CASE WHEN i - p <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS k FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM r)),
s AS (SELECT rid, min(i) AS a, max(i) + {WINDOW} AS b FROM g GROUP BY rid, k),
t AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS p FROM s),
u AS (SELECT d.rid, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM t JOIN d ON t.rid = d.rid GROUP BY d.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN last IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN u ON d.rid = u.rid
"""
