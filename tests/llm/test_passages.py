"""Repeated passages against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from timbrewell.llm import passages


def plain(rows):
    """rows: (doc_id, text) with distinct ids."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - 99):
            w = body[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out.append((doc, len(body), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(12, 60))) for _ in range(8)]
    rows = []
    for k in range(120):
        parts = [rng.choice(pool) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(0, 6))]
        text = " ".join(parts)
        if rows and rng.random() < 0.3:
            text = list(rng.choice(rows)[1] or "")
            for _ in range(rng.randint(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice("xyz中")
            text = "".join(text)
        rows.append((k * 7 % 121, text))
    return rows + [(500, None), (501, ""), (502, "a" * 99), (503, "a" * 100), (504, "a" * 350), (505, "ab" * 300), (None, "a" * 120), (506, "中" * 90)]


def test_passages(spark, monkeypatch):
    rows = texts()
    for parts, size in ((1, 2 << 20), (5, 3000)):
        monkeypatch.setattr(passages, "BLOCK_BYTES", size)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert Counter(map(tuple, passages.passage_digest(df).collect())) == plain(rows)


def test_real(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, passages.passage_digest(docs).collect())) == plain([tuple(r) for r in docs.collect()])


def test_columns_pass_and_characters_stay_whole(spark):
    rows = [(1, "é" * 80 + "x", "l", 1), (2, "a" + "é" * 80, "m", None), (2, "a" + "é" * 80, "n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_spans int")
    got = passages.dedup_passages(df, whole_characters=True)
    assert got.columns == ["doc_id", "text", "kept", "n_spans", "__bytes", "__removed", "__spans"]
    assert sorted(r["kept"] for r in got.collect()) == ["l", "m", "n"]
    assert passages.dedup_passages(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"word{k}" for k in range(60))
    df = spark.createDataFrame([(1, text)] * 3, "doc_id long, text string")
    got = sorted(r["n_removed"] for r in passages.passage_digest(df).collect())
    assert got == [0, len(text), len(text)]


def test_suffix_array_is_the_plain_order():
    """Windows of phrases in the order of their bytes, equal ones in corpus order; all but the first of these repeat."""
    rng = random.Random(8)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(100, 168))) for _ in range(6)]
    phrases = [rng.choice(pool)[rng.randint(0, 3) :].ljust(100, "b").encode() for _ in range(40)] + [b"\0" * 120, b"\0" * 101]
    lengths = np.array([len(x) for x in phrases])
    order, again = passages.suffix_array(np.frombuffer(b"".join(phrases), np.uint8), lengths)
    windows = [x[k : k + 100] for x in phrases for k in range(len(x) - 99)]
    assert order.tolist() == sorted(range(len(windows)), key=lambda k: (windows[k], k))
    seen = set()
    for w, g in zip(windows, again.tolist(), strict=True):
        assert g == (w in seen)
        seen.add(w)


def test_ranges_are_many(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(passages, "RANGE_BYTES", 500)
    rows = texts(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, passages.passage_digest(df).collect())) == plain(rows)
