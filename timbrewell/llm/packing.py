"""Best-fit packing of token sequences by a configuration linear program.

The lengths of all pieces form a histogram of at most `capacity` counts; only that reaches the driver. A
configuration is a multiset of lengths that fits a sequence. The covering program (as few configurations as serve
every length's count) is solved by multiplicative weights: each round prices lengths by their weight, one knapsack
dynamic program gives for every length the configuration of the highest price that holds it, each is added until one of
its lengths is served, and weights shrink by how far a length is served. A round serves at least one length whole, so
there are at most as many rounds as lengths. The weights are also a solution of the dual program, whose value bounds
what any packing needs; learning rates are tried until the program's value is within GAP of that bound, or the best is
kept.

The solution is rounded down, then up where counts allow it and the configuration is full; what remains is a smaller
histogram, whose program is solved in turn, until rounding places nothing more. Best-fit decreasing places the rest.
The plan, whose size depends on the capacity alone, deals each piece its sequence and place by the piece's rank among
those of its length.

Null text counts as empty: one piece that holds the end id alone. Repeated rows are packed once each; rows with one
id but other texts too. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbrewell.llm.common import arrow_map, durable
from timbrewell.llm.tokens import tokenizer_path, word_tokens

CAPACITY = 2048
END_ID = 0
#: Learning rates, and the gap between the program and its dual (a share of it) that ends the search.
RATES, GAP = (0.02, 0.1, 0.5, 2.0), 0.001
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document; only documents over the capacity are cut, the first piece is the rest."""

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer)
        every, bounds = encoder.encode(batch["text"])
        every, closing = every.astype("<u4"), np.array([end_id], "<u4")
        rows: list[tuple] = []
        for doc, a, b in zip(batch["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids = np.concatenate([every[a:b], closing])
            at, piece, first = 0, 0, len(ids) % capacity or min(capacity, len(ids))
            while at < len(ids):
                end = at + (first if piece == 0 else capacity)
                rows.append((doc, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                at, piece = end, piece + 1
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    return arrow_map(docs.select("doc_id", "text"), cut, PIECES)


class Knapsack:
    """The multisets of lengths with the highest price for every room up to the capacity."""

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for room in range(int(lengths[0]) if len(lengths) else capacity + 1, capacity + 1):
            values = prices[: upto[room]] + best[room - lengths[: upto[room]]]
            top = int(values.argmax())
            best[room], last[room] = (values[top], top) if values[top] > best[room - 1] else (best[room - 1], -1)
        self.best, self.last = best, last.tolist()

    def fill(self, room: int) -> dict[int, int]:
        """Indexes of lengths, and how often each occurs."""
        found: dict[int, int] = defaultdict(int)
        while room > 0:
            if (top := self.last[room]) < 0:
                room -= 1
                continue
            found[top] += 1
            room -= int(self.lengths[top])
        return found


def best_configuration(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack by dynamic programming: the multiset of lengths with the highest price that fits."""
    return dict(Knapsack(prices, lengths, capacity).fill(capacity))


def _solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rate: float) -> tuple[dict[tuple, float], float]:
    """Configurations with amounts that serve every length, and the dual's value."""
    left, random = counts.astype(float), np.random.default_rng(len(lengths))
    amounts: dict[tuple, float] = defaultdict(float)
    bound = float((lengths * counts).sum()) / capacity
    while left.max() > 0:
        there = np.flatnonzero(left > 0)
        sizes = lengths[there]
        # ties among full configurations are broken at random, so that one round's fill differs from room to room
        prices = sizes * np.exp(rate * (left[there] / counts[there] - 1)) * (1 + 1e-3 * random.random(len(there)))
        sack = Knapsack(prices, sizes, capacity)
        bound = max(bound, float((prices * counts[there]).sum() / sack.best[capacity]))
        for i in range(len(there) - 1, -1, -1):
            if left[there[i]] <= 0:
                continue
            held = sack.fill(capacity - int(sizes[i]))
            held[i] += 1
            index, times = there[np.array(list(held))], np.array(list(held.values()))
            step = float((left[index] / times).min())
            if step > 0:
                amounts[tuple(sorted(zip(index.tolist(), times.tolist(), strict=True)))] += step
                left[index] -= step * times
                left[index[(left[index] / times).argmin()]] = 0  # whatever the rounding of the difference
                left[left < 1e-9 * counts] = 0
    return amounts, bound


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with amounts that serve every length, and a lower bound of any solution's value.

    lengths ascend; a configuration maps an index of lengths to how often it occurs.
    """
    if not len(lengths):
        return [], 0.0
    best: dict[tuple, float] = {}
    bound = 0.0
    for rate in RATES:
        amounts, below = _solve(lengths, counts, capacity, rate)
        bound = max(bound, below)
        if not best or sum(amounts.values()) < sum(best.values()):
            best = amounts
        if sum(best.values()) <= bound * (1 + GAP):
            break
    return [(dict(k), v) for k, v in best.items()], bound


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Configurations and how many sequences follow each, by rounding the program and those of what remains; what is left over."""
    left, taken = counts.copy(), []
    while True:
        there = np.flatnonzero(left)
        solved, _ = fractional(lengths[there], left[there], capacity)
        before = len(taken)
        for up in (False, True):
            for held, amount in sorted(solved, key=lambda x: (-x[1], sorted(x[0].items()))):
                config = {int(there[i]): t for i, t in held.items()}
                whole = int(amount + 1e-9)
                if up:  # one more of a full configuration whose amount was cut
                    full = sum(int(lengths[i]) * t for i, t in config.items()) == capacity
                    whole = int(full and amount - whole > 1e-9)
                n = min(whole, *(int(left[i]) // t for i, t in config.items()))
                if n > 0:
                    taken.append((config, n))
                    for i, t in config.items():
                        left[i] -= n * t
        if len(taken) == before:
            return taken, left


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: equal sequences are handled together."""
    open_: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, bool)
    for i in range(len(lengths) - 1, -1, -1):
        left, size = int(counts[i]), int(lengths[i])
        moved: list[tuple[int, dict[int, int], int]] = []
        while left:
            at = size + int(free[size:].argmax())
            if not free[at]:
                each = capacity // size
                if full := left // each:
                    moved.append((capacity - each * size, {i: each}, full))
                if rest := left % each:
                    moved.append((capacity - rest * size, {i: rest}, 1))
                break
            held, n = open_[at].pop()
            free[at] = bool(open_[at])
            each = min(at // size, left)
            take = min(n, left // each)
            if n > take:
                open_[at].append((held, n - take))
                free[at] = True
            moved.append((at - each * size, held | {i: each}, take))
            left -= take * each
        for at, held, n in moved:
            open_[at].append((held, n))
            free[at] = True
    return [x for group in open_ for x in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length to times) and how many sequences follow each; every piece is placed once."""
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(x for x, n in histogram.items() if x < capacity and n), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    taken, left = rounded(lengths, counts, capacity)
    out = [({int(lengths[i]): t for i, t in held.items()}, n) for held, n in [*taken, *best_fit(lengths, left, capacity)] if n]
    return out + ([({capacity: 1}, full)] if full else [])


def _slots(chosen: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, times, offset, first sequence), sorted by length and rank."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for held, n in chosen:
        offset = 0
        for size, times in sorted(held.items(), reverse=True):
            rows.append((size, rank[size], times, offset, sequence))
            rank[size] += times * n
            offset += size * times
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """Pieces with rank, from 0, among those of their length; a length is dealt over many buckets."""
    keyed = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")
    base = sums.select(F.col("length").alias("_l"), F.col("_b").alias("_c"), upto.alias("_base"))
    by = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    rows = keyed.withColumn("_r", F.row_number().over(by) - 1)
    joined = rows.join(base, (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_c")))
    return joined.select(*cut.columns, (F.col("_r") + F.col("_base")).alias("rank"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each piece with sequence_id and offset."""
    cut = durable(pieces(docs, tokenizer or tokenizer_path("byte_bpe_50k.json"), capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan(histogram, capacity))
    buckets = max(16, sum(histogram.values()) // 200_000)
    span = 1 << 42  # over any rank
    starts = slots[:, 0] * span + slots[:, 1]

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        at = slots[np.searchsorted(starts, size * span + rank, "right") - 1]
        past = rank - at[:, 1]
        held = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        new = [pa.array(at[:, 4] + past // at[:, 2]), pa.array(at[:, 3] + past % at[:, 2] * size)]
        yield pa.RecordBatch.from_arrays([*held, *new], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_map(ranked(cut, buckets), place, PIECES + ", sequence_id long, offset long")
