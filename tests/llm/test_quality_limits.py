"""Limits come from the sketches: sources of unlike spread and length get unlike limits."""

import random

from timbrewell.llm import quality_rules


def limits(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality_rules.add_counts(df)
    return {r["_source"]: r.asDict() for r in quality_rules.thresholds(quality_rules.sketch(counted)).collect()}


def test_limits_follow_spread_and_length(spark):
    rng = random.Random(1)
    word = lambda lo, hi: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(lo, hi)))
    even = lambda n: " ".join(word(4, 6) for _ in range(n))
    uneven = lambda n: " ".join(word(1, rng.randint(2, 16)) for _ in range(n))
    code = lambda n: " ".join("#" + word(4, 6) if rng.random() < 0.3 else word(4, 6) for _ in range(n))
    made = {"even": lambda: even(80), "uneven": lambda: uneven(80), "long": lambda: even(400), "code": lambda: code(80)}
    rows = [(k, fn(), "en", name) for name, fn in made.items() for k in range(100)]
    got = limits(spark, rows)
    span = {s: r["_q_len_max"] - r["_q_len_min"] for s, r in got.items()}
    assert span["uneven"] > 1.5 * span["even"]
    assert got["long"]["_q_sym_max"] < got["even"]["_q_sym_max"] / 3 and got["long"]["_q_rep_max"] < got["even"]["_q_rep_max"] / 3
    assert got["code"]["_q_sym_max"] > 10 * got["even"]["_q_sym_max"]
    df = spark.createDataFrame([*rows, (900, code(80), "en", "even"), (901, "x" * 60 + " " + ("longword" * 4 + " ") * 60, "en", "even")], "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality_rules.quality_rules(df).collect() if not r["kept"]} == {900, 901}


def test_a_fifth_of_junk_moves_no_limit_far(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(100))
    clean = [(k, text(), "en", "s") for k in range(170)]
    junk = [(1000 + k, text().replace(" ", " | | "), "en", "s") for k in range(30)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(df).collect() if r["kept"]}
    assert kept == {k for k, *_ in clean}


def test_limits_differ_between_the_groups(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    got = quality_rules.thresholds(quality_rules.sketch(quality_rules.add_counts(docs))).collect()
    # the driver's sources are alike, and cells are 1/32 wide, so several groups may share a limit
    for column in ("_q_len_max", "_q_sym_max", "_q_rep_max"):
        limits_of = [r[column] for r in got]
        assert len(set(limits_of)) >= 8 and max(map(limits_of.count, limits_of)) < len(got) / 2, column
