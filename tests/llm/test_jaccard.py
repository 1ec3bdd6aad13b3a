"""The Jaccard join against all pairs in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from timbrewell.llm import jaccard


def plain(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return Counter((doc, len(sets[k]), least.get(find(k))) for k, (doc, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randint(30, 120))] for _ in range(6)]
    rows = []
    for k in range(n):
        r = rng.random()
        if r < 0.5:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(0, 90))]
            if r < 0.8:
                w += passage
        if rng.random() < 0.2:
            w = [x.upper() for x in w]
        rows.append((k, rng.choice([" ", "\n", "  ", "\t "]).join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "SMALL_REGION", 6)
    monkeypatch.setattr(jaccard, "COMMON", 8)
    monkeypatch.setattr(jaccard, "CELL", 20)
    rows = [*corpus(seed, 220), (1001, None), (1002, ""), (1003, "one two"), (1004, "One two"), (1005, "one"), (None, "a b c d e f g"), (1006, "A b c d e f g"), (None, "alone here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n long, rep string".replace(", n long", ""))
    got = jaccard.jaccard_join(df).collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_empty_table(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_join(df).collect())) == [(1, 2, 1)] * 3 + [(2, 2, 1)]


def test_regions_part_and_agree():
    rng = random.Random(7)
    texts = [t for _, t in corpus(9, 400)]
    for _ in range(3):
        texts += [" ".join(f"v{rng.randrange(10**6)}" for _ in range(40)) for _ in range(100)]
    sets = jaccard.shingle_sets(pa.array(texts))
    region = jaccard.Region(sets)
    roots = [region.forest.find(k) for k in range(len(sets))]
    slow = jaccard.Forest(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a]) and len(sets[b]) and jaccard.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))):
                slow.join(a, b)
    assert roots == [slow.find(k) for k in range(len(sets))]


def test_one_id_and_other_texts(spark):
    x, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(5, x), (5, other), (2, x + " end"), (None, other + " end"), (None, "alone of all"), (7, None), (7, "")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, rep string")
    assert Counter(map(tuple, jaccard.jaccard_join(df).collect())) == plain(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, other), (2, x + " end"), (None, "alone of all"), (7, ""), (7, "")])


def test_many_repeated_rows_are_one_class(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 8)
    monkeypatch.setattr(jaccard, "SMALL_REGION", 4)
    monkeypatch.setattr(jaccard, "CELL", 10)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = [(3, texts[0])] * 10_000 + list(enumerate(texts[1:], 10))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, jaccard.jaccard_join(df).collect()))
    few = plain([(3, texts[0]), *enumerate(texts[1:], 10)])
    assert got == Counter({k: n * (10_000 if k[0] == 3 else 1) for k, n in few.items()})
    assert sum(r["doc_id"] == 3 for r in jaccard.keep_one(df).collect()) == 1


def test_pivots_part_a_region():
    """Members of dense clusters are settled by a few pivots, and only those in a foreign window are counted in full."""
    rng = random.Random(5)
    texts = []
    for c in range(4):
        base = [f"c{c}w{k}" for k in range(100)]
        for _ in range(100):
            w = list(base)
            w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    region = jaccard.Region(jaccard.shingle_sets(pa.array(texts)))
    assert region.pivots == 4 and region.counted == 0
    assert len({region.forest.find(k) for k in range(400)}) == 4
