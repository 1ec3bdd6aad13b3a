"""Token ids of whole texts, with each distinct word encoded once per worker, while a cache of bounded size holds it.

A byte-level or word-level tokenizer never joins characters across a single space between two non-spaces, so a
text's ids are those of its words, each with the space before it. A word of plain Latin letters and the punctuation
after it are two more such parts. Arrow splits texts and finds the distinct words; only parts that are new to the
worker reach the tokenizer, many in one call; numpy gathers the ids. Texts with a space beside other white space,
and words of other kinds, go to the tokenizer whole. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from timbrewell.llm.common import joined, slices

#: White space of either kind next to a space; a superset of what the tokenizers' patterns call white space.
_WHITE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_RUN = rf" [{_WHITE}]|[{_WHITE}] "
#: Latin letters, then punctuation without apostrophes (which may start a contraction).
_PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!-&(-/:-@\[-`{-~]*)$"
_CACHE_PARTS = 600_000
_open: dict[tuple[str, bool], WordTokens] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Encodes texts to unsigned 16-bit ids (the vocabulary must be smaller than 65,536).

    drops_space: the tokenizer ignores white space and case and marks ends of words; otherwise it is byte-level and
    marks the space before a word.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("16-bit ids are too small for this vocabulary")
        self.drops_space = drops_space
        self.edge = np.zeros(1 << 16, bool)
        for token, k in vocabulary.items():
            self.edge[k] = token.endswith("</w>") if drops_space else token.startswith("Ġ")
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.values, self.used = np.zeros(1 << 16, np.uint16), 0
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _add(self, keys: list[str], ids: list[np.ndarray] | tuple[np.ndarray, np.ndarray]) -> None:
        """New parts with their ids: one array each, or all in a row and their sizes."""
        flat, sizes = ids if isinstance(ids, tuple) else (np.concatenate(ids), np.array([len(x) for x in ids]))
        n = len(self.index)
        while n + len(keys) > len(self.start):
            self.start, self.size = (np.append(x, np.zeros_like(x)) for x in (self.start, self.size))
        while self.used + len(flat) > len(self.values):
            self.values = np.append(self.values, np.zeros_like(self.values))
        self.values[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.used += len(flat)
        self.index.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint16) for x in found]

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | list[np.ndarray]:
        """Ids of words of letters, each after a space, from calls with many words."""
        found = self.tokenizer.encode_batch_fast([" " + " ".join(words[k : k + 64]) for k in range(0, len(words), 64)], add_special_tokens=False)
        flat = np.concatenate([np.array(x.ids, np.uint16) for x in found])
        edges = np.flatnonzero(self.edge[flat])
        if len(edges) != len(words):
            return self._each([f" {w}" for w in words])
        bounds = np.append(0, edges + 1) if self.drops_space else np.append(edges, len(flat))
        return flat, np.diff(bounds)

    def _find(self, keys: list[str], mark: str, letters: bool = False) -> np.ndarray:
        """Numbers of parts; mark tells letters and other words after a space, words at a text's start and punctuation apart."""
        named = [mark + k for k in keys] if mark else keys
        get = self.index.get
        out = np.array([get(k, -1) for k in named], np.int64)
        new = np.flatnonzero(out < 0)
        for k in range(0, len(new), 50_000):
            rows = new[k : k + 50_000].tolist()
            part = [keys[i] for i in rows]
            self._add([named[i] for i in rows], self._together(part) if letters else self._each([f" {x}" if mark == "\3" else x for x in part]))
        if len(new):
            out[new] = [self.index[named[i]] for i in new.tolist()]
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Two parts for each distinct word that follows a space; the second may be number 0, which is empty."""
        plain = pc.extract_regex(words, _PLAIN)
        whole = np.flatnonzero(plain.is_null().to_numpy(zero_copy_only=False))
        usual = np.flatnonzero(plain.is_valid().to_numpy(zero_copy_only=False))
        first, second = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(usual):
            letters, after = (plain.field(k).take(pa.array(usual)) for k in (0, 1))
            if self.drops_space:
                letters = pc.utf8_lower(letters)
            for column, of, into, mark in ((letters, True, first, ""), (after, False, second, "\2")):
                coded = column.dictionary_encode()
                keys = coded.dictionary.to_pylist()
                numbers = self._find(keys, mark, of)
                into[usual] = numbers[coded.indices.to_numpy()]
        if len(whole):
            first[whole] = self._find(words.take(pa.array(whole)).to_pylist(), "\3")
        return first, second

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's start and the last one's end."""
        return joined([self._encode(part) for part in slices(texts)], np.uint16)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        if not self.drops_space:
            odd = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
            if odd.any():
                return self._mixed(texts, odd)
        if len(self.index) > _CACHE_PARTS:
            self._forget()
        split = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        first, second = self._words(words.dictionary)
        pairs = np.stack([first[codes], second[codes]], axis=1)
        heads = np.cumsum(counts) - counts
        if not self.drops_space:  # no space before a text's first word
            opening = split.flatten().take(pa.array(heads)).dictionary_encode()
            pairs[heads, 0] = self._find(opening.dictionary.to_pylist(), "\1")[opening.indices.to_numpy()]
            pairs[heads, 1] = 0
        parts = pairs.ravel()
        sizes = self.size[parts]
        ends = np.cumsum(sizes, dtype=np.int32)
        at = np.repeat(self.start[parts] - (ends - sizes), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return self.values[at], np.append(0, ends[2 * np.cumsum(counts) - 1]).astype(np.int64)

    def _mixed(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = iter(self._each(texts.take(pa.array(np.flatnonzero(odd))).to_pylist()))
        ids, at = self._encode(texts.take(pa.array(np.flatnonzero(~odd))))
        rest = iter([ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        each = [next(whole if x else rest) for x in odd]
        return np.concatenate(each), np.append(0, np.cumsum([len(x) for x in each]))


def word_tokens(path: str, drops_space: bool = False) -> WordTokens:
    """One encoder for each file and worker."""
    if (path, drops_space) not in _open:
        _open[path, drops_space] = WordTokens(path, drops_space)
    return _open[path, drops_space]
