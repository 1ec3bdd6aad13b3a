"""Exact look-up of 64-bit keys across blocks of rows, by packed messages.

A block sends its distinct keys once, cut by ranges of hashes; the task of a range sorts what it gets and answers bits
for each key. A key in many rows costs one entry a block, so no task's load grows with a hot key, and the number of
ranges follows the number of keys, so no task's memory does with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "part int, kind int, block long, keys binary, first binary, low long, width int, flags binary"
ANSWER = "block long, kind int, part int, n int, again binary, shared binary, flagged binary"
KEYS_A_TASK = 500_000
_MASK = (1 << 64) - 1


class Distinct:
    """The distinct keys of a block, in the order of their hashes, and where each occurs first."""

    def __init__(self, keys: np.ndarray, texts: np.ndarray):
        self.keys, self.at, self.of = np.unique(keys, return_index=True, return_inverse=True)
        self.texts, self.n = texts, len(keys)

    def messages(self, block, kind: int, log_parts: int, flags: np.ndarray | None = None) -> list[tuple]:
        """The keys by ranges of hashes, each with the id of its first text; flags: a bit for each distinct key."""
        if not self.n:
            return []
        part = (self.keys >> np.uint64(64 - log_parts)).astype(np.int64) if log_parts else np.zeros(len(self.keys), np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        ids, low = block.ids[self.texts[self.at]], int(block.ids[self.texts].min())
        far = int(ids.max()) - low
        width = 2 if far < 1 << 16 else 4 if far < 1 << 32 else 8
        past = (ids.astype(np.uint64) - np.uint64(low & _MASK)).astype(f"<u{width}")
        return [
            (int(part[a]), kind, block.number, self.keys[a:b].tobytes(), past[a:b].tobytes(), low, width, b"" if flags is None else np.packbits(flags[a:b]).tobytes())
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]

    def answer(self, answers: list[dict], kind: int, of: str) -> np.ndarray:
        """The bits of each distinct key."""
        held = sorted((x for x in answers if x["kind"] == kind), key=lambda x: x["part"])
        bits = [np.unpackbits(np.frombuffer(x[of], np.uint8), count=x["n"]) for x in held]
        out = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
        if len(out) != len(self.keys):
            raise ValueError("an answer is missing")
        return out

    def later(self, answers: list[dict], kind: int) -> np.ndarray:
        """For each key of the block, in its own order: it has occurred earlier, in the block or before."""
        own = np.ones(self.n, bool)
        own[self.at] = False
        return self.answer(answers, kind, "again")[self.of] | own

    def shared(self, answers: list[dict], kind: int) -> np.ndarray:
        """For each key of the block: it occurs elsewhere too."""
        return (self.answer(answers, kind, "shared") | (np.bincount(self.of, minlength=len(self.keys)) > 1))[self.of]


def message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["part", "kind", "block", "keys", "first", "low", "width", "flags"])


def _look_up(table: pa.Table) -> pa.Table:
    """Bits for each key of each message: another block has it in an earlier text; another has it; one flags it."""
    rows = table.select(["part", "kind", "block", "keys", "first", "low", "width", "flags"]).to_pylist()
    keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
    ids = [(np.frombuffer(r["first"], f"<u{r['width']}").astype(np.uint64) + np.uint64(r["low"] & _MASK)).astype(np.int64) for r in rows]
    sizes = [len(k) for k in keys]
    flags = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=n) if r["flags"] else np.zeros(n, np.uint8) for r, n in zip(rows, sizes, strict=True)])
    block = np.repeat(np.array([r["block"] for r in rows]), sizes)
    every = np.concatenate(keys)
    order = np.lexsort((block, np.concatenate(ids), every))
    same = every[order[1:]] == every[order[:-1]]
    heads = np.flatnonzero(np.append(True, ~same))
    again, shared, flagged = np.zeros(len(every), bool), np.zeros(len(every), bool), np.zeros(len(every), bool)
    again[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    flagged[order] = np.repeat(np.logical_or.reduceat(flags[order].astype(bool), heads), np.diff(np.append(heads, len(every))))
    cuts = np.cumsum([0, *sizes])
    bits = [[np.packbits(x[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (again, shared, flagged)]
    columns = [pa.array([r[c] for r in rows], t) for c, t in (("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()))]
    columns += [pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in bits)]
    return pa.Table.from_arrays(columns, ["block", "kind", "part", "n", "again", "shared", "flagged"])


def answers_of(messages: DataFrame) -> DataFrame:
    """block and its answers."""
    found = messages.groupBy("part", "kind").applyInArrow(_look_up, ANSWER)
    return found.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "n", "again", "shared", "flagged")).alias("answers"))


def log_parts_of(total: int, each: int = KEYS_A_TASK) -> int:
    """Binary logarithm of the number of ranges for so many keys."""
    return max(0, (total // each).bit_length())
