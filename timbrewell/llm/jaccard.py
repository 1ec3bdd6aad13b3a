"""Exact Jaccard join of documents by their 5-word shingles, as a metric-space join.

One minus the Jaccard coefficient is a metric; documents link within radius 0.2. The first pivots are the single
shingles: a document's distance to {s} is below 1 exactly if it holds s, so its nearest pivots are its own shingles,
taken in one global order (rare before frequent, then by hash). Two documents within the radius share one of the
first n - ceil(0.8 n) + 1 shingles of each, so that window says to which regions a document is replicated; regions of
one member are settled. Small regions give candidate pairs, thinned by what the windows bound the intersection with,
and checked on whole texts. Large regions (hot shingles) are put together in groups and joined by pivots among their
members:

  - Pivots are drawn from the members that no pivot has within the radius yet, and all members are measured against
    them. Members within the radius link; each belongs to the Voronoi cell of its nearest pivot.
  - By the triangle inequality a partner of a member of that cell is within twice the radius of its pivot. So a member
    of another component within that window of a pivot is replicated to the pivot's cell; nobody else is.
  - Cells with such boundary members are joined by the same method in a task: pivots of their own, down to full counts
    of boundary members. Members that no pivot covers after some rounds are joined in cuts that meet two at a time.

Groups give a spanning forest of links, not their pairs. Texts stay in blocks (blocks.py); only those of candidates and
of group members travel.

Equal sets are one class first, by a 128-bit digest; a class is named by the number of one of its rows, so rows with
one id and other texts are judged one by one, and repeated rows are one class whose copies go no further. Shingles are
62-bit hashes: among n distinct ones, n * n / 2**63 meet by chance. Frequent shingles (in more than COMMON documents)
are counted over all texts; at most MOST_COMMON of the most frequent ones are put last in the order, which is a matter
of speed alone.

Null or empty text has the empty set, linked with nothing. A null id has no number to report, so its component is the
smallest id it reaches, or null. Repeated rows come as often as they occur. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrewell.llm.blocks import ROW_BITS, Block, Blocks, each_block
from timbrewell.llm.common import arrow_map, discard, durable, durable_at, forget, tidy
from timbrewell.llm.keys import MESSAGE, Distinct, answers_of, log_parts_of, message_batch

WORDS = 5
COMMON, MOST_COMMON = 32, 500_000
SMALL_REGION = 32
#: Members of a group that meet in one task; pivots of a larger group in a round, and rounds.
CELL, PIVOTS, ROUNDS = 1500, 32, 2
_LAST = 1 << 62


# ---------------------------------------------------------------- sets of shingles


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Ascending 62-bit hashes of each text's shingles."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    for c in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, c, " ")
    split = pc.split_pattern(texts, " ")
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    real = np.array([w != "" for w in words], bool)[codes] if len(words) else np.zeros(0, bool)
    h, of = hashed[codes[real]], of[real]
    sizes = np.bincount(of, minlength=len(texts))
    ends = np.cumsum(sizes)
    step = np.uint64(0x9E3779B97F4A7C15)
    rolled = h[: max(0, len(h) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        rolled = rolled * step + h[k : k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        if size >= WORDS:
            out.append(np.unique(rolled[end - size : end - WORDS + 1]))
        elif size:
            value = np.uint64(size)
            with np.errstate(over="ignore"):
                for x in h[end - size : end]:
                    value = value * step + x
                out.append(_mix(np.array([value ^ np.uint64(0x5DEECE66D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(2)


def linked(a: int, b: int, both: int) -> bool:
    return 100 * both >= 80 * (a + b - both)


# ---------------------------------------------------------------- joining a region


class Forest:
    """Union-find over the members of a region."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class Region:
    """Exact links among sets: pivots cover the members, and only members of a cell's window are counted in full."""

    def __init__(self, sets: list[np.ndarray], join: bool = True):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        self.forest = Forest(len(sets))
        self.pivots = self.counted = 0
        if sets:
            self._postings()
        if join:
            self._join()

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Region:
        """The sets, not joined yet."""
        return cls(sets, False)

    def _postings(self) -> None:
        _, self.code, self.count = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        self.owner = np.repeat(np.arange(len(self.sets)), self.sizes)[np.argsort(self.code, kind="stable")]
        self.start, self.ends = np.cumsum(self.count) - self.count, np.cumsum(self.sizes)

    def common(self, k: int) -> np.ndarray:
        """Size of the intersection of member k with each member."""
        own = self.code[self.ends[k] - self.sizes[k] : self.ends[k]]
        n = self.count[own]
        at = np.repeat(self.start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))

    def measure(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which members are within the radius of member k, and which within twice the radius."""
        both = self.common(k)
        whole = self.sizes[k] + self.sizes - both
        return (both > 0) & (100 * both >= 80 * whole), (both > 0) & (100 * both >= 60 * whole)

    def _join(self) -> None:
        covered = self.sizes == 0
        windows = []
        for k in range(len(self.sets)):
            if covered[k]:
                continue
            links, near = self.measure(k)
            self.pivots += 1
            covered |= links
            for x in np.flatnonzero(links):
                self.forest.join(k, int(x))
            windows.append((k, np.flatnonzero(near & ~links)))
        done: set[int] = {k for k, _ in windows}
        for k, near in windows:
            for x in near.tolist():
                # a pivot's own links are known; so are those of a member counted in full
                if x not in done and self.forest.find(x) != self.forest.find(k):
                    done.add(x)
                    self.counted += 1
                    for y in np.flatnonzero(self.measure(x)[0]):
                        self.forest.join(x, int(y))

    def edges(self) -> list[tuple[int, int]]:
        return [(self.forest.find(k), k) for k in range(len(self.sets)) if self.forest.find(k) != k]


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """node and comp, the least node it reaches: least labels of neighbours, with jumps, until nothing changes."""
    spark = edges.sparkSession
    both, both_path = durable_at(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a")).where("node <> other").distinct(), "links")
    labels, path = durable_at(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "comp"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("then"))
        moved, moved_path = durable_at(lower.join(jump, "low").select("node", F.least("low", "then").alias("comp"), "old"), "labels")
        changed = moved.where("comp < old").limit(1).count()
        forget(spark, path)
        labels, path = moved.select("node", "comp"), moved_path
        if not changed:
            forget(spark, both_path)
            return labels


# ---------------------------------------------------------------- the passes


def common_shingles(blocks: Blocks, log_parts: int) -> np.ndarray:
    """Ascending hashes of the shingles in more than COMMON rows, of the lowest quarter of all hashes.

    Windows hold the lowest fifth of a document's hashes and a little more, so higher ones need no count.
    """
    zone = np.uint64(1 << 60)

    def count(block: Block) -> Iterator[pa.RecordBatch]:
        sets = [s[: np.searchsorted(s, zone)] for s in shingle_sets(block.strings())]
        keys, n = np.unique(np.concatenate(sets), return_counts=True)
        part = (keys >> np.uint64(60 - log_parts)).astype(np.int64) if log_parts else np.zeros(len(keys), np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        rows = [(int(part[a]), keys[a:b].tobytes(), n[a:b].astype("<u2").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], ["part", "keys", "n"])

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()])
        n = np.concatenate([np.frombuffer(x, "<u2") for x in table["n"].to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(n, heads)
        hot = total > COMMON
        return pa.table({"key": pa.array(keys[heads][hot].astype(np.int64)), "n": pa.array(total[hot])})

    found, path = durable_at(each_block(blocks.rows, count, "part int, keys binary, n binary").groupBy("part").applyInArrow(add, "key long, n long"), "common")
    if found.count() > MOST_COMMON:
        share = 1 - MOST_COMMON / found.count()
        found = found.where(F.col("n") > found.approxQuantile("n", [share], 0.001)[0])
    hot = np.sort(found.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()["key"].to_numpy().astype(np.uint64))
    discard(blocks.spark, path)
    return hot


_PACK = "block long, vids binary, nulls binary, ns binary, digests binary, sizes binary, windows binary"


def windows(blocks: Blocks, common: np.ndarray) -> DataFrame:
    """For each block its rows' ids, sizes of sets and digests, and the first shingles of each set in the global order."""
    held = blocks.spark.sparkContext.broadcast(common)

    def cut(block: Block) -> Iterator[pa.RecordBatch]:
        hot = held.value
        sets = shingle_sets(block.strings())
        out, digests = [], []
        for s in sets:
            n = len(s)
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            if n and len(hot):
                late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                if late.any():
                    s = np.concatenate([s[~late], s[late] | np.uint64(_LAST)])
            out.append(s[: n - -(-8 * n // 10) + 1] if n else s)
        ids = block.extra["doc_id"].cast(pa.int64())
        arrays = [pc.fill_null(ids, 0).to_numpy(), np.packbits(pc.is_null(ids).to_numpy(zero_copy_only=False)), np.array([len(s) for s in sets], np.int64), b"".join(digests), np.array([len(s) for s in out], np.int64), np.concatenate(out)]
        row = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
        yield pa.RecordBatch.from_arrays([pa.array([block.number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["block", "vids", "nulls", "ns", "digests", "sizes", "windows"])

    return blocks.beside(each_block(blocks.rows, cut, _PACK), "windows")


def _rows_of(packs: DataFrame) -> DataFrame:
    """row, vid, n and digest of each row that has shingles or none."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for r in batch.to_pylist():
            ids, ns = np.frombuffer(r["vids"], np.int64), np.frombuffer(r["ns"], np.int64)
            null = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=len(ids)).astype(bool)
            numbers = (r["block"] << ROW_BITS) + np.arange(len(ids), dtype=np.int64)
            digests = pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(r["digests"])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(ids, mask=null), pa.array(ns), digests], ["row", "vid", "n", "digest"])

    return arrow_map(packs.select("block", "vids", "nulls", "ns", "digests"), run, "row long, vid long, n long, digest binary", 16)


def by_block(rows: DataFrame, name: str) -> DataFrame:
    """block and places: where the numbered rows are."""
    places = F.collect_list((F.col("row") % (1 << ROW_BITS)).cast("int"))
    return durable(rows.groupBy(F.shiftright("row", ROW_BITS).alias("block")).agg(places.alias("places")), name)


def shared_windows(blocks: Blocks, packs: DataFrame, copies: DataFrame, log_parts: int) -> tuple[DataFrame, str]:
    """A written table (and its path) of key, rep, n and last (the end of the window) for the keys that more than one class has in its window."""
    packs = blocks.joined(copies, packs.select("block", "ns", "sizes", "windows"))

    def opened(batches: Iterator[pa.RecordBatch], more: str | None = None) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ns, sizes = (np.frombuffer(row[c], np.int64).copy() for c in ("ns", "sizes"))
                keys, stays = np.frombuffer(row["windows"], np.uint64), np.ones(len(ns), bool)
                stays[row["places"] or []] = False
                keys = keys[np.repeat(stays, sizes)]
                reps = ((row["block"] << ROW_BITS) + np.arange(len(ns), dtype=np.int64))[stays]
                sizes = sizes[stays]
                # the two highest bits of a key are the order's, the ranges go by the hash below them
                distinct = Distinct(keys << np.uint64(2) | keys >> np.uint64(62), np.repeat(np.arange(len(sizes)), sizes))
                yield SimpleNamespace(number=row["block"], ids=reps), ns[stays], sizes, keys, distinct, row[more] if more else None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, _, distinct, _ in opened(batches):
            if rows := distinct.messages(block, 0, log_parts):
                yield message_batch(rows)

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ns, sizes, keys, distinct, answers in opened(batches, "answers"):
            both = distinct.shared(answers or [], 0)
            of = np.repeat(np.arange(len(sizes)), sizes)
            last = np.zeros(len(sizes), np.uint64)
            last[sizes > 0] = keys[(np.cumsum(sizes) - 1)[sizes > 0]]
            columns = [keys[both].astype(np.int64), block.ids[of[both]], ns[of[both]], last[of[both]].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "rep", "n", "last"])

    answers = durable(answers_of(packs.mapInArrow(tidy(ask), MESSAGE)), "answers")
    discard(blocks.spark)
    return durable_at(blocks.joined(answers, packs).mapInArrow(tidy(give), "key long, rep long, n long, last long"), "shared")


def _candidates(small: DataFrame, large: DataFrame) -> DataFrame:
    """Pairs of classes that may link, by what their windows share."""
    a = small.select("key", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"))
    b = small.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"))
    met = a.join(b, "key").where("a < b AND 10 * na >= 8 * nb AND 10 * nb >= 8 * na")
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), *[F.min(x).alias(x) for x in ("na", "nb", "la", "lb")])
    more = large.groupBy("rep").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs.join(more.toDF("a", "ka"), "a", "left").join(more.toDF("b", "kb"), "b", "left")
    most = "c + least(coalesce(ka, 0), coalesce(kb, 0)) + CASE WHEN la <= lb THEN (8 * na + 9) div 10 - 1 ELSE (8 * nb + 9) div 10 - 1 END"
    return pairs.where(f"{most} >= (4 * (na + nb) + 8) div 9").select("a", "b")


def _groups(large: DataFrame) -> DataFrame:
    """grp and rep: large regions with members in common put together, twice over."""
    regions = large.select("key", "rep")
    # labels are written, so that the joins have plain shuffles on both sides and hot partitions can be split
    label = durable(regions.groupBy("key").agg(F.min("rep").alias("label")), "labels")
    own = durable(regions.join(label, "key").groupBy("rep").agg(F.min("label").alias("label")), "labels")
    label = durable(regions.join(own, "rep").groupBy("key").agg(F.min("label").alias("grp")), "labels")
    return regions.join(label, "key").select("grp", "rep").distinct()


# ---------------------------------------------------------------- large groups


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [s for k in range(0, len(table), 500) for s in shingle_sets(table["text"].slice(k, 500).combine_chunks())]


def _edge_table(reps: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({c: pa.array([int(reps[e[k]]) for e in edges], pa.int64()) for k, c in enumerate("ab")})


def _join_table(table: pa.Table) -> pa.Table:
    return _edge_table(table["rep"].to_numpy(), Region(_sets(table)).edges())


def _meet(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """Links of the members of each group; with more than one cut each two cuts meet in a task."""
    met = dealt.select("grp", "rep", "cut", F.explode(F.expr("sequence(0, cuts - 1)")).alias("other"))
    met = met.select("grp", "rep", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"))
    return met.join(texts, "rep").select("grp", "i", "j", "rep", "text").groupBy("grp", "i", "j").applyInArrow(_join_table, "a long, b long")


def _dealt(groups: DataFrame) -> DataFrame:
    """groups with cuts, how many cuts of CELL members a group makes, and the cut of each member."""
    sizes = durable(groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cuts")), "sizes")
    return groups.join(sizes, "grp").withColumn("cut", F.expr("CAST(pmod(xxhash64(rep), cuts) AS INT)"))


def _cross_table(table: pa.Table) -> pa.Table:
    """Links between the members of a cell and those in its window: the fewer ones are counted in full."""
    inner = table["inner"].to_numpy(zero_copy_only=False)
    fewer = inner if 2 * inner.sum() <= len(inner) else ~inner
    order = np.argsort(~fewer, kind="stable")
    reps, region = table["rep"].to_numpy()[order], Region.of(_sets(table.take(pa.array(order))))
    for k in range(int(fewer.sum())):
        links, _ = region.measure(k)
        for x in np.flatnonzero(links).tolist():
            region.forest.join(k, x)
    return _edge_table(reps, region.edges())


_MEASURED = "kind int, grp long, a long, b long"
_LINK, _HOME, _NEAR = 0, 1, 2


def _measure(table: pa.Table) -> pa.Table:
    """A cut's members against the pivots of their group.

    Links (a spanning forest of them), the cell of each member that a pivot covers, and the windows that hold members
    of another component than the pivot's, as far as this cut sees it.
    """
    reps, pivot, grp = table["rep"].to_numpy(), table["pivot"].to_numpy(zero_copy_only=False), table["grp"][0].as_py()
    order = np.argsort(~pivot, kind="stable")  # pivots first
    reps, k = reps[order], int(pivot.sum())
    sets = _sets(table.take(pa.array(order)))
    region = Region.of(sets)
    nearest, home = np.zeros(len(sets)), np.full(len(sets), -1)
    rows: list[tuple[int, int, int, int]] = []
    windows = []
    for p in range(k):
        both = region.common(p)
        whole = region.sizes[p] + region.sizes - both
        share = both / np.maximum(whole, 1)
        links, near = (both > 0) & (100 * both >= 80 * whole), (both > 0) & (100 * both >= 60 * whole)
        closer = links & (share > nearest)
        nearest[closer], home[closer] = share[closer], p
        for x in np.flatnonzero(links).tolist():
            if region.forest.find(x) != region.forest.find(p):
                region.forest.join(x, p)
                rows.append((_LINK, grp, int(reps[p]), int(reps[x])))
        windows.append(np.flatnonzero(near & ~links))
    for x in np.flatnonzero(home >= 0).tolist():
        if x >= k:
            rows.append((_HOME, grp, int(reps[home[x]]), int(reps[x])))
    for p, near in enumerate(windows):
        rows += [(_NEAR, grp, int(reps[p]), int(reps[x])) for x in near.tolist() if x >= k and region.forest.find(x) != region.forest.find(p)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], ["kind", "grp", "a", "b"])


def _rounds(dealt: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pivots tell of groups of more than one cut (as _MEASURED), and the members that none covers."""
    measured = dealt.sparkSession.createDataFrame([], _MEASURED)
    settled = dealt.limit(0).select("grp", "rep")
    rest = dealt
    for _ in range(ROUNDS):
        salted = rest.groupBy("grp", F.pmod(F.xxhash64("rep"), F.lit(PIVOTS)).alias("s")).agg(F.min_by("rep", F.xxhash64("rep", F.lit(1))).alias("rep"), F.max("cuts").alias("cuts"))
        pivots = durable(salted.select("grp", "rep", "cuts"), "pivots")
        if not pivots.limit(1).count():
            break
        spread = pivots.select("grp", F.explode(F.expr("sequence(0, cuts - 1)")).alias("cut"), "rep", F.lit(True).alias("pivot"))
        # only groups that have pivots left take part, and a pivot stands in each cut as a pivot alone
        open_ = durable(pivots.select("grp").distinct(), "open")
        members = dealt.join(open_, "grp", "left_semi").join(pivots.select("grp", "rep"), ["grp", "rep"], "left_anti")
        rows = members.select("grp", "cut", "rep", F.lit(False).alias("pivot")).unionAll(spread).join(texts, "rep")
        told = durable(rows.select("grp", "cut", "rep", "pivot", "text").groupBy("grp", "cut").applyInArrow(_measure, _MEASURED), "measured")
        measured = measured.unionAll(told)
        covered = told.where(F.col("kind") == _HOME).select("grp", F.col("b").alias("rep")).unionAll(pivots.select("grp", "rep"))
        left = durable(rest.join(covered, ["grp", "rep"], "left_anti").select("grp", "rep", "cuts"), "rest")
        # what is left of a group, if a task holds it, needs no more pivots
        many = durable(left.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CELL).select("grp"), "many")
        settled = settled.unionAll(left.join(many, "grp", "left_anti").select("grp", "rep"))
        rest = left.join(many, "grp", "left_semi")
    return measured, settled.unionAll(rest.select("grp", "rep"))


def _windows_edges(measured: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the members of a pivot's cell and the members of other components in its window."""
    labels = components(known)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    near = measured.where(F.col("kind") == _NEAR).select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    foreign = durable(near.where(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select(F.col("a").alias("pivot"), F.col("b").alias("rep")), "foreign")
    pivots = durable(foreign.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("outer")), "outer")
    homes = measured.where(F.col("kind") == _HOME).select(F.col("a").alias("pivot"), F.col("b").alias("rep")).distinct().join(pivots.select("pivot"), "pivot", "left_semi")
    homes = homes.unionAll(pivots.select("pivot", F.col("pivot").alias("rep")))
    sizes = durable(homes.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("inner")).join(pivots, "pivot"), "sizes")
    cut = lambda c: F.expr(f"CAST(pmod(xxhash64(rep), {c}) AS INT)")
    inside = homes.join(sizes, "pivot").select("pivot", "rep", F.lit(True).alias("inner"), cut("inner").alias("i"), F.explode(F.expr("sequence(0, outer - 1)")).alias("j"))
    outside = foreign.join(sizes, "pivot").select("pivot", "rep", F.lit(False).alias("inner"), F.explode(F.expr("sequence(0, inner - 1)")).alias("i"), cut("outer").alias("j"))
    rows = inside.unionAll(outside).join(texts, "rep").select("pivot", "i", "j", "inner", "rep", "text")
    return rows.groupBy("pivot", "i", "j").applyInArrow(_cross_table, "a long, b long")


def _group_edges(groups: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the members of each group, and what pivots tell of the large ones."""
    dealt = durable(_dealt(groups), "dealt")
    measured, rest = _rounds(dealt.where("cuts > 1"), texts)
    direct = dealt.where("cuts = 1").unionByName(_dealt(rest).select(dealt.columns))
    links = measured.where(F.col("kind") == _LINK).select("a", "b")
    return _meet(direct, texts).unionAll(links), measured


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets link."""
    rows = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one, two = (shingle_sets(batch[c]) for c in ("text_a", "text_b"))
        hits = [k for k, (x, y) in enumerate(zip(one, two, strict=True)) if len(x) and len(y) and linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))]
        yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))

    return arrow_map(rows.select("a", "b", "text_a", "text_b"), check, "a long, b long", 500, "text_a")


def labelled(blocks: Blocks) -> DataFrame:
    """row, vid, n, rep (the row that stands for its set), least (the smallest id of the set) and comp (a component's least row, or null)."""
    spark = blocks.spark
    size = blocks.rows.agg(F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("n")).first()["n"]
    log_parts = log_parts_of(size * 3 // 25)
    packs = windows(blocks, common_shingles(blocks, log_parts))
    # written, as are the counts below, so that joins have plain shuffles on both sides and hot partitions can be split
    rows, rows_path = durable_at(_rows_of(packs), "rows")
    equal = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("first"), F.min("vid").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    equal = durable(equal.drop("c"), "equal")
    known = F.col("first").isNotNull()
    members = durable(rows.join(equal, "digest", "left").select("row", "vid", "n", F.when(known, F.col("first")).otherwise(F.col("row")).alias("rep"), F.when(known, F.col("least")).otherwise(F.col("vid")).alias("least")), "members")
    discard(spark, rows_path)
    copies = by_block(members.where("row <> rep"), "copies")
    shared, shared_path = shared_windows(blocks, packs, copies, log_parts)
    blocks.remove(beside_only=True)
    counts = durable(shared.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "counts")
    regions, regions_path = durable_at(shared.join(counts, "key"), "regions")
    discard(spark, shared_path)
    small, large = regions.where(F.col("m") <= SMALL_REGION), regions.where(F.col("m") > SMALL_REGION)
    pairs, pairs_path = durable_at(_candidates(small, large), "pairs")
    groups, groups_path = durable_at(_groups(large), "groups")
    discard(spark, regions_path)
    wanted = by_block(pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).unionAll(groups.select("rep")).distinct(), "wanted")

    def give(block: Block, places: list) -> Iterator[pa.RecordBatch]:
        at = pa.array(sorted(places), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(block.numbers()).take(at), block.strings().take(at)], ["rep", "text"])

    texts, texts_path = durable_at(each_block(blocks.only(wanted), give, "rep long, text string", "places"), "texts")
    found, measured = _group_edges(groups, texts)
    edges = durable(_checked(pairs, texts).unionAll(found), "edges")
    if measured.where(F.col("kind") == _NEAR).limit(1).count():
        edges = edges.unionAll(durable(_windows_edges(measured, edges, texts), "edges"))
    labels = components(edges)
    discard(spark, pairs_path, groups_path, texts_path)
    return members.join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    blocks = Blocks(docs.select("doc_id", "text"), "documents")
    rows = durable(labelled(blocks), "labelled")
    blocks.remove()
    smallest = durable(rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("smallest")), "smallest")
    component = F.when(F.col("comp").isNotNull(), F.col("smallest")).when(F.col("n") > 0, F.col("least")).otherwise(F.col("vid"))
    return rows.join(smallest, "comp", "left").select(F.col("vid").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that link, over whatever steps, with a row that stays: of each component the
    row with the smallest id stays (of rows with one id the first; null ids come last). Null texts become empty ones.
    """
    blocks = Blocks(docs, "documents")
    rows = durable(labelled(blocks).where("n > 0").select("row", "vid", F.coalesce("comp", "rep").alias("comp")), "labelled")
    many = rows.groupBy("comp").agg(F.min(F.struct(F.col("vid").isNull().alias("none"), "vid", "row")).alias("stays"), F.count(F.lit(1)).alias("c"))
    many = durable(many.where("c > 1").select("comp", F.col("stays.row").alias("stays")), "stays")
    gone = by_block(rows.join(many, "comp").where("row <> stays").select("row"), "gone")

    def keep(block: Block, places: list | None) -> Iterator[pa.RecordBatch]:
        stays = np.ones(len(block.sizes), bool)
        stays[places or []] = False
        yield from block.table().filter(pa.array(stays)).to_batches()

    columns = [F.col(f"`{c}`") for c in docs.columns]
    schema = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], "text").schema
    return each_block(blocks.joined(gone), keep, schema, "places").select(*columns)


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""
