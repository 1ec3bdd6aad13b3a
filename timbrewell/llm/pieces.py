"""Sampled segmentation into sentence pieces, and lossless decoding.

A text is cut into units where no piece of the vocabulary crosses: each word with all spaces before it, plain words
apart from the punctuation after them. A unit is filtered whole, whatever its length; its lattice holds all vocabulary
pieces that match it, and single bytes for characters that have no piece. Pieces weigh 1 / (rank + 10) of their rank in the vocabulary. Forward filtering sums the weights of
all ways to each place; backward sampling then walks from the end, choosing each piece with its share. The lattice of
each distinct unit is filtered once per task; all units of a batch are sampled together in numpy. The numbers come
from a hash of the row key, the unit's place and the step, so a row's sample is the same in any batch, task or run.

A text has a space put before it, as the vocabulary expects; decoding joins the pieces' bytes and drops it. A mark
like the vocabulary's sign for a space stands for itself, by its bytes. Null text counts as empty and has no pieces.
A null doc_id is a key like any other; repeated rows get equal samples. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from timbrewell.llm.common import arrow_map, forget_at_end, joined, slices
from timbrewell.llm.passages import Text
from timbrewell.llm.tokens import tokenizer_path

_PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]{1,30})(?P<b>[!-/:-@\[-`{-~]{0,60})$"
#: From so few units on, Python takes them one by one, place by place, rather than numpy all at a place.
FEW = 8
MOST_UNITS = 400_000
_open: dict[str, Lattices] = {}


class _Growing:
    """A numpy array with room to append."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.append(self.held, np.zeros(max(len(self.held), len(values)), self.held.dtype))
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


def hash_numbers(key: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 0 to below 1 by row key, place of the unit and step."""
    x = key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattices:
    """Filtered lattices of units, and sampling from them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.zeros(256, np.int64)
        spelled, whole = [], []
        for k in range(model.get_piece_size()):
            text = b""
            if model.is_byte(k):
                value = int(model.id_to_piece(k)[3:5], 16)
                self.bytes[value], text = k, bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                text = model.id_to_piece(k).replace("▁", " ").encode()
                whole.append(k)
                if b" " in text.lstrip(b" "):
                    raise ValueError(f"piece {k} crosses from a word to a space, where texts are cut")
            spelled.append(text)
        self.weight = 1.0 / (np.arange(len(spelled)) + 10)
        self.weight[self.bytes] = 1.0 / (2 * len(spelled))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(x) for x in spelled])
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        # pieces that may match inside a unit, by the hash of their bytes; a table of bits sorts most others out
        own = np.frombuffer(b"".join(spelled[k] for k in whole), np.uint8)
        sizes = self.spelled_size[whole]
        ends = np.cumsum(sizes)
        hashes = Text(own, sizes).hashes(ends - sizes, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(whole)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.lengths = np.unique(sizes)
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.unit_at, self.unit_n, self.ends = (_Growing(np.int64) for _ in range(3))
        self.first_edge, self.piece, self.back, self.upto = (_Growing(t) for t in (np.int64, np.int32, np.int32, np.float64))
        self.first_edge.extend(np.zeros(1, np.int64))

    def matches(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of each piece that matches inside a unit, and of bytes of characters without one."""
        body = text.body
        heads = np.flatnonzero((body & 0xC0) != 0x80)
        left = np.repeat(text.ends, text.ends - text.starts)[heads] - heads
        own = np.where(body[heads] < 0x80, 1, np.where(body[heads] < 0xE0, 2, np.where(body[heads] < 0xF0, 3, 4)))
        found, single = [], np.zeros(len(body), bool)
        own_size = np.zeros(len(body), np.int64)
        own_size[heads] = own
        for size in self.lengths.tolist():
            fits = left >= size
            heads, left = heads[fits], left[fits]
            if not len(heads):
                break
            h = text.hashes(heads, heads + size)
            maybe = np.flatnonzero(self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            real = self.hashes[at] == h[maybe]
            start, ids = heads[maybe[real]], self.ids[at[real]]
            single[start[own_size[start] == size]] = True
            found.append((start, start + size, ids))
        bare = (own_size > 0) & ~single
        lone = np.flatnonzero(np.repeat(bare[own_size > 0], own_size[own_size > 0]))
        found.append((lone, lone + 1, self.bytes[body[lone]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _add_units(self, keys: list[str]) -> None:
        """Lattices of new units, filtered forwards all together."""
        whole = [key.encode() for key in keys]
        counts = np.array([len(x) > 0 for x in whole], np.int64)
        parts = [x for x in whole if x]
        sizes = np.array([len(x) for x in parts], np.int64)
        self.unit_at.extend(self.ends.n + np.cumsum(counts) - counts)
        self.unit_n.extend(counts)
        if not parts:
            return
        text = Text(np.frombuffer(b"".join(parts), np.uint8), sizes)
        part = np.repeat(np.arange(len(parts)), sizes)
        start, end, ids = self.matches(text)
        # a part of n bytes has n + 1 states, numbered from the first; the last of them ends the part
        base = self.first_edge.n - 1 + np.cumsum(sizes + 1) - (sizes + 1)
        shift = base[part[start]] - text.starts[part[start]]
        reach, back = end + shift, start + shift
        order = np.argsort(reach, kind="stable")
        reach, back, ids, local = reach[order], back[order], ids[order], (end - text.starts[part[start]])[order]
        weight = self.weight[ids]
        low, n_states = int(base[0]), int((sizes + 1).sum())
        first = np.searchsorted(reach, np.arange(low, low + n_states + 1))
        # sums are mantissas and powers of two, as those of a long unit are below any float
        ahead, power = np.zeros(n_states), np.zeros(n_states, np.int64)
        ahead[base - low] = 1.0
        upto = np.zeros(len(reach))
        back_at = back - low
        by_place = np.argsort(local, kind="stable")
        cuts = np.searchsorted(local[by_place], np.arange(1, int(sizes.max()) + 2))
        longest = np.sort(sizes)
        last = int(longest[-FEW - 1]) if len(longest) > FEW else 0  # beyond it at most FEW units go on
        for a, b in zip(cuts[:last], cuts[1 : last + 1], strict=True):
            rows = by_place[a:b]  # the edges that end at one distance from their part's start, by state
            if not len(rows):
                continue
            states = reach[rows]
            heads = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
            size = np.diff(np.append(heads, len(rows)))
            top = np.maximum.reduceat(power[back_at[rows]], heads)
            share = np.ldexp(ahead[back_at[rows]] * weight[rows], power[back_at[rows]] - np.repeat(top, size))
            # sums run edge by edge, so that a unit's numbers don't depend on the units beside it
            total, within = np.zeros(len(heads)), np.empty(len(rows))
            for k in range(int(size.max())):
                here = np.flatnonzero(size > k)
                total[here] += share[heads[here] + k]
                within[heads[here] + k] = total[here]
            ahead[states[heads] - low], shift_up = np.frexp(total)
            power[states[heads] - low] = top + shift_up
            within /= np.repeat(total, size)
            within[np.append(heads[1:], len(rows)) - 1] = 2.0
            upto[rows] = within
        for at, n in zip((base - low)[sizes > last].tolist(), sizes[sizes > last].tolist(), strict=True):
            self._filter_on(at, last, n, first, back_at, weight, ahead, power, upto)
        edges = self.piece.n
        self.first_edge.n -= 1  # its last entry closes the states before
        self.first_edge.extend(first + edges)
        self.piece.extend(ids)
        self.back.extend(back)
        self.upto.extend(upto)
        self.ends.extend(base + sizes)

    @staticmethod
    def _filter_on(at: int, last: int, n: int, first: np.ndarray, back: np.ndarray, weight: np.ndarray, ahead: np.ndarray, power: np.ndarray, upto: np.ndarray) -> None:
        """The forward filter of one unit from state at, beyond its first last bytes: the same sums in the same order."""
        low, high = int(first[at]), int(first[at + n + 1])
        cuts = (first[at : at + n + 2] - low).tolist()
        sources, weights = (back[low:high] - at).tolist(), weight[low:high].tolist()
        sums, powers, shares = ahead[at : at + n + 1].tolist(), power[at : at + n + 1].tolist(), upto[low:high].tolist()
        for state in range(last + 1, n + 1):
            a, b = cuts[state], cuts[state + 1]
            if a == b:
                continue
            top = max(powers[x] for x in sources[a:b])
            total = 0.0
            for k in range(a, b):
                total += math.ldexp(sums[sources[k]] * weights[k], powers[sources[k]] - top)
                shares[k] = total
            for k in range(a, b):
                shares[k] /= total
            shares[b - 1] = 2.0
            sums[state], up = math.frexp(total)
            powers[state] = top + up
        upto[low:high] = shares

    def _units(self, keys: list[str]) -> np.ndarray:
        get = self.units.get
        out = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(out < 0)
        for k in range(0, len(new), 50_000):
            part = [keys[i] for i in new[k : k + 50_000].tolist()]
            n = len(self.units)
            self.units.update(zip(part, range(n, n + len(part)), strict=True))
            out[new[k : k + 50_000]] = np.arange(n, n + len(part))
            self._add_units(part)
        return out

    def sample(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and where each starts and the last ends."""
        parts, at = [], 0
        for part in slices(texts):
            parts.append(self._sample(part, keys[at : at + len(part)]))
            at += len(part)
        return joined(parts, np.int32)

    def _sample(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.units) > MOST_UNITS:
            self._forget()
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy()
        split = pc.split_pattern(texts, " ")
        counts = np.where(sizes > 0, pc.list_value_length(split).to_numpy(), 0).astype(np.int64)
        flat = split.flatten()
        if (sizes == 0).any():
            of = np.repeat(sizes > 0, pc.list_value_length(split).to_numpy())
            flat = flat.filter(pa.array(of))
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        plain = pc.extract_regex(words, _PLAIN)
        usual = plain.is_valid().to_numpy(zero_copy_only=False)
        none = self._units([""])[0]
        pairs = np.full((len(words), 2), none)
        whole, there = np.flatnonzero(~usual), np.flatnonzero(usual)
        pairs[whole, 0] = self._units([f" {w}" for w in words.take(pa.array(whole)).to_pylist()])
        for field, before in ((0, " "), (1, "")):
            part = plain.field(field).take(pa.array(there)).dictionary_encode()
            pairs[there, field] = self._units([before + x for x in part.dictionary.to_pylist()])[part.indices.to_numpy()]
        # an empty word is one more space before the word that follows in its text
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)[codes]
        lasts = np.cumsum(counts) - 1
        empty[lasts[counts > 0]] = False
        held = np.flatnonzero(~empty)
        spaces = np.diff(held, prepend=-1) - 1
        counts = np.diff(np.append(0, np.cumsum(~empty))[np.append(0, np.cumsum(counts))])
        codes = codes[held]
        chosen = pairs[codes]
        run = np.flatnonzero(spaces)
        if len(run):
            kinds, of = np.unique(np.stack([codes[run], spaces[run]]), axis=1, return_inverse=True)
            spelled = words.take(pa.array(kinds[0])).to_pylist()
            fields = plain.field(0).take(pa.array(kinds[0])).to_pylist()
            starts = [a if u else w for a, w, u in zip(fields, spelled, usual[kinds[0]].tolist(), strict=True)]
            # the same unit may come with several kinds
            longer = pa.array([" " * (k + 1) + x for x, k in zip(starts, kinds[1].tolist(), strict=True)], pa.string()).dictionary_encode()
            chosen[run, 0] = self._units(longer.dictionary.to_pylist())[longer.indices.to_numpy()][of.ravel()]
        # the parts of all units in a row
        units = chosen.ravel()
        n = self.unit_n.held[units]
        ends = np.cumsum(n)
        state = self.ends.held[np.arange(ends[-1]) + np.repeat(self.unit_at.held[units] - (ends - n), n)]
        ends = ends[1::2]
        text_units = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        of = np.repeat(np.arange(len(texts)), np.diff(text_units))
        key, place = keys[of], np.arange(len(state)) - text_units[of]
        return self._walk(state, key, place, text_units)

    def _walk(self, state: np.ndarray, key: np.ndarray, place: np.ndarray, text_units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first_edge, piece, back, upto = (x.held for x in (self.first_edge, self.piece, self.back, self.upto))
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        steps = np.zeros(len(state), np.int64)
        active = np.arange(len(state))
        while len(active) > FEW:
            u = hash_numbers(key[active], place[active], len(taken))
            edge = first_edge[state[active]]
            more = np.flatnonzero(upto[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[upto[edge[more]] <= u[more]]
            taken.append((active, piece[edge]))
            steps[active] += 1
            at = back[edge].astype(np.int64)
            state[active] = at
            # the first state of a unit has the same first edge as the one after it
            active = active[first_edge[at] != first_edge[at + 1]]
        rest = [(who, self._walk_on(int(state[who]), key[who : who + 1], place[who : who + 1], len(taken))) for who in active.tolist()]
        for who, ids in rest:
            steps[who] += len(ids)
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (who, ids) in enumerate(taken):
            out[ends[who] - 1 - k] = ids
        for who, ids in rest:
            out[ends[who] - len(taken) - len(ids) : ends[who] - len(taken)] = ids[::-1]
        return out, np.append(0, ends)[text_units]

    def _walk_on(self, state: int, key: np.ndarray, place: np.ndarray, step: int) -> list[int]:
        """The pieces of one unit from state back to its start, with the numbers from step on."""
        first_edge, piece, back, upto = (x.held for x in (self.first_edge, self.piece, self.back, self.upto))
        ids: list[int] = []
        while first_edge[state] != first_edge[state + 1]:
            edge, u = int(first_edge[state]), hash_numbers(key, place, step + len(ids))[0]
            while upto[edge] <= u:
                edge += 1
            ids.append(int(piece[edge]))
            state = int(back[edge])
        return ids

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        sizes = self.spelled_size[ids]
        ends = np.cumsum(sizes)
        body = self.spelled[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.spelled_at[ids] - (ends - sizes), sizes)].tobytes()
        at = np.append(0, ends)[bounds]
        return [body[a + 1 : b] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def lattices(path: str) -> Lattices:
    if path not in _open:
        _open[path] = Lattices(path)
    return _open[path]


def _forget_units() -> None:
    for lattice in _open.values():
        lattice._forget()


forget_at_end.append(_forget_units)


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    """A number for each row key."""
    values = np.array([-1 if x is None else x for x in ids], np.int64).astype(np.uint64)
    mixed = (values + np.uint64(seed * 2 + 1)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32)) ^ np.array([x is None for x in ids], np.uint64)


def sampled_pieces(docs: DataFrame, model: str | None = None, seed: int = 1) -> DataFrame:
    """doc_id, pieces (ids) and text (decoded from them) of each row."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lattice = lattices(path)
        ids, bounds = lattice.sample(batch["text"], row_keys(batch["doc_id"].to_pylist(), seed))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        texts = pa.array([x.decode() for x in lattice.decode(ids, bounds)], pa.string())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, texts], ["doc_id", "pieces", "text"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, pieces array<int>, text string")


def piece_digest(docs: DataFrame, model: str | None = None, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (of little-endian 32-bit ids), n_chars and decoded_sha256 of each row."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lattice = lattices(path)
        ids, bounds = lattice.sample(batch["text"], row_keys(batch["doc_id"].to_pylist(), seed))
        ids = ids.astype("<u4")
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        texts = lattice.decode(ids, bounds)
        columns = [batch["doc_id"], pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([len(x.decode()) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "pieces_crc32", "n_chars", "decoded_sha256"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_pieces long, pieces_crc32 long, n_chars long, decoded_sha256 string")
