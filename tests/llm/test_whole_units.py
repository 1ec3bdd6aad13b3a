"""Sampled pieces on long units and runs of spaces, against exact shares of each piece at each place."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece

from timbrewell.llm import pieces
from timbrewell.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattices(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    return {model.id_to_piece(k).replace("▁", " "): k for k in plain}


def test_no_piece_crosses_a_cut(vocabulary):
    assert not [p for p in vocabulary if " " in p.lstrip(" ")]
    assert not [p for p in vocabulary if re.search(r"[A-Za-zÀ-ÖØ-öø-ÿ][!-/:-@\[-`{-~]", p)]


@pytest.mark.parametrize("text", ["constantinople" * 5, "日本人大学中国の東京" * 3, "a" + " " * 21 + "then", "     ", "x  the, ", "http://www.example.com/then/another/constant/place.html"])
@pytest.mark.parametrize("beside", [0, 20])
def test_shares(lattice, vocabulary, text, beside):
    whole, n = " " + text, 4000
    cut = {i for m in re.finditer(r"[A-Za-z](?=[!-/:-@])", whole) for i in [m.end()]}
    edges = [(i, j, vocabulary[whole[i:j]]) for i in range(len(whole)) for j in range(i + 1, min(len(whole), i + 40) + 1) if whole[i:j] in vocabulary]
    assert not any(i < c < j for i, j, _ in edges for c in cut)
    ahead, after = [1.0] + [0.0] * len(whole), [0.0] * len(whole) + [1.0]
    for i, j, k in sorted(edges, key=lambda e: e[1]):
        ahead[j] += ahead[i] / (k + 10)
    for i, j, k in sorted(edges, key=lambda e: -e[0]):
        after[i] += after[j] / (k + 10)
    others = ["constantinople" * 4 + str(k) for k in range(beside)]
    ids, bounds = lattice.sample(pa.array([text] * n + others), pieces.row_keys(list(range(n + beside)), 3))
    spelled = {k: p for p, k in vocabulary.items()}
    seen = Counter()
    for a, b in zip(bounds[:n].tolist(), bounds[1 : n + 1].tolist(), strict=True):
        at = 0
        for k in ids[a:b].tolist():
            seen[at, at + len(spelled[k]), k] += 1
            at += len(spelled[k])
        assert at == len(whole)
    assert set(seen) <= set(edges)
    for i, j, k in edges:
        p = min(1.0, ahead[i] * after[j] / (k + 10) / ahead[-1])
        assert abs(seen[i, j, k] / n - p) < 5.5 * math.sqrt(p * (1 - p) / n) + 5e-4


def test_very_long_units(vocabulary):
    texts = ["constantinople" * 1500, "é中" * 5000, " " * 9999, "constantinople " * 3, *(("then" * (k + 20)) for k in range(30))]
    keys = pieces.row_keys(list(range(len(texts))), 1)
    together = pieces.Lattices(PATH)
    ids, bounds = together.sample(pa.array(texts), keys)
    assert together.decode(ids, bounds) == [t.encode() for t in texts]
    for k in (0, 2, 3, 10, 33):  # the same by numpy or alone
        own, _ = pieces.Lattices(PATH).sample(pa.array([texts[k]]), keys[k : k + 1])
        assert (own == ids[bounds[k] : bounds[k + 1]]).all()
