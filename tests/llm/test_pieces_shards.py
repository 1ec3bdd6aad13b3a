"""Sampled pieces against exact shares and round trips; shards against planned sizes and versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from timbrewell.llm import pieces, shards
from timbrewell.llm.tokens import tokenizer_path

TEXTS = ["", "a", " ", "  x", "▁ lit▁", "中文 text é", "x" * 500, "\n\ttab", "it's,!! é́", None, "é" * 100, "\x00 ▁", "ertion the, AND. " * 40]


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattices(tokenizer_path("piece_bpe_32k.model"))


def test_lossless_and_seeded(lattice):
    keys = pieces.row_keys(list(range(len(TEXTS))), 1)
    ids, bounds = lattice.sample(pa.array(TEXTS), keys)
    assert lattice.decode(ids, bounds) == [(t or "").encode() for t in TEXTS]
    for k, text in enumerate(TEXTS):  # alone, and by a worker that has seen other texts
        fresh = pieces.Lattices(tokenizer_path("piece_bpe_32k.model")) if k == 12 else lattice
        own, _ = fresh.sample(pa.array([text], pa.string()), keys[k : k + 1])
        assert (own == ids[bounds[k] : bounds[k + 1]]).all()
    other, _ = lattice.sample(pa.array(TEXTS), pieces.row_keys(list(range(len(TEXTS))), 2))
    assert len(other) != len(ids) or (other != ids).any()


def test_pieces_are_the_models(lattice):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    ids, _ = lattice.sample(pa.array(["Hello, the 中 world é"]), pieces.row_keys([5], 1))
    assert model.decode(ids.tolist()) == "Hello, the 中 world é"


def test_shares_follow_the_weights(lattice):
    text = "then"
    unit = " then"
    weights = {}

    def walk(at, path, w):
        if at == len(unit):
            weights[path] = w
            return
        for end in range(at + 1, len(unit) + 1):
            k = model.piece_to_id(unit[at:end].replace(" ", "▁"))
            if not model.is_unknown(k):
                walk(end, (*path, k), w / (k + 10))

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    walk(0, (), 1.0)
    total, n = sum(weights.values()), 40_000
    ids, bounds = lattice.sample(pa.array([text] * n), pieces.row_keys(list(range(n)), 3))
    seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    assert set(seen) <= set(weights)
    for path, w in weights.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_query(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, "x y"), (3, "  x")], "doc_id long, text string")
    rows = pieces.sampled_pieces(df).collect()
    assert Counter(r["text"] for r in rows) == Counter([*(t or "" for t in TEXTS), "x y", "  x"])
    assert sorted(r["n_pieces"] for r in pieces.piece_digest(df).collect()) == sorted(len(r["pieces"]) for r in rows)
    assert pieces.piece_digest(df.limit(0)).count() == 0


def test_merge_plan():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = [(f"s{k}", int(x)) for k, x in enumerate(rng.integers(1, 200, rng.integers(0, 120)))]
        groups = shards.plan_merges(sizes, 1000, 10)
        named = [p for g in groups for p in g]
        assert len(named) == len(set(named)) and set(named) <= {p for p, _ in sizes}
        merged = [sum(dict(sizes)[p] for p in g) for g in groups]
        assert all(x <= 1250 for x in merged)
        rest = [n for p, n in sizes if p not in named] + merged
        for level, n in Counter(shards.tier(x, 10) for x in rest if x < 500).items():
            small = sorted(x for x in rest if x < 500 and shards.tier(x, 10) == level)
            assert n < shards.FAN_IN or sum(small[: shards.FAN_IN]) > 1250 - 500


def test_store(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = shards.ShardStore(spark, str(tmp_path / "store"), docs.schema, target=200_000, least=1000)
    assert store.read().count() == 0 and store.compact() == 0
    for k in range(9):
        assert store.append(docs.where(docs.doc_id % 9 == k).coalesce(1), 100) == k + 1
    before = store.manifest().count()
    version = store.compact()
    assert version == 10 and store.manifest().count() < before
    assert sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert store.read(3).count() == docs.where("doc_id % 9 < 3").count()
    assert store.compact() == version  # nothing more to merge
    with pytest.raises(Exception, match="(?i)exist"):
        store._commit(version, store.manifest())
    assert store.version() == version
    assert store.vacuum() > 0 and store.read().count() == docs.count()


def test_large_plans_are_quick():
    groups = shards.plan_merges([(f"s{k:06d}", 1000 + k % 7) for k in range(60_000)])
    named = [p for g in groups for p in g]
    assert len(named) == len(set(named)) and len(named) > 59_000


def test_slots_part_evenly(spark):
    slots = shards.slots_of(37)
    df = spark.createDataFrame([(x,) for x in slots], "x long").repartition(37, "x").select(F.spark_partition_id().alias("p"))
    assert df.distinct().count() == 37


def test_shard_query_against_the_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in shards.shard_documents(docs).collect()]
    want = {r["doc_id"]: (len(r["text"]), hashlib.md5(r["text"].encode()).hexdigest()) for r in docs.collect()}
    assert len(rows) == len(want) and {r["doc_id"]: (r["n_chars"], r["text_md5"]) for r in rows} == want
    held = Counter(r["shard"] for r in rows)
    assert sorted(held) == list(range(len(held))) and len({r["version"] for r in rows}) == 1
    for r in rows:
        assert r["shard_rows"] == held[r["shard"]] and r["tier"] == 0


def test_shard_query(spark):
    df = spark.createDataFrame([(1, None, "s"), (1, None, "s"), (None, "", "t"), (2, "x" * 1000, None)], "doc_id long, text string, shard string")
    rows = shards.shard_documents(df).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in rows) == Counter([(1, None), (1, None), (None, 0), (2, 1000)])
    assert shards.shard_documents(df.limit(0)).count() == 0
