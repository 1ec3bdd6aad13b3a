"""The pipeline, stage by stage, against plain versions."""

import hashlib
from collections import Counter, defaultdict

import test_jaccard
import test_passages

import corpus_pipeline
from timbrewell.llm import common, lines, quality_rules


def plain_lines(rows):
    """rows: (doc_id, text); the texts after line dedup."""
    holders = defaultdict(set)
    key = lambda x: lines.key_of(x.encode()).decode()
    for doc, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(doc)
    lost = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    return [(doc, "\n".join(x for x in (text or "").split("\n") if not (key(x) in lost and lost[key(x)] != doc))) for doc, text in rows]


def test_lines(spark):
    same = "  The same line, of twenty and more  "
    rows = [(1, f"a\n{same}\nb"), (2, same.upper()), (3, f"{same}\n{same}\nc"), (4, None), (5, ""), (6, "short\nshort"), (6, "x"), (None, same.strip()), (3, same)]
    rows += [(k, "été " * 5 + "\n" + "é" * 19) for k in (7, 8, 9)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, id string")
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "id", "__lines", "__dropped"]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(plain_lines(rows))
    assert lines.line_digest(df.limit(0)).count() == 0


def plain_windows(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    return len(w), len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_quality_counts(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "a b c a b c a b c d", "en", "a"), (4, "x " * 3000, "en", "a"), (4, "x " * 3000, "en", "a"), (5, "w1 w2\t\nw3 w1 w2 w3 w4\n\n w1", "de", "b")]
    rows += [(k, " ".join(f"w{k * i % 97}" for i in range(120)), "en", "a") for k in range(10, 90)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, kept int")
    got = quality_rules.quality_rules(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in got) == Counter((r[0], *plain_windows(r[1])) for r in rows)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


def test_thresholds_follow_the_source(spark):
    plain_text = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    marked = lambda k: " ".join(f"w{k}#{i}" for i in range(60))
    rows = [(k, marked(k) if k % 2 else plain_text(k), "en", f"s{k % 2}") for k in range(200)] + [(900, marked(900), "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    gone = [r["doc_id"] for r in quality_rules.quality_rules(df).collect() if not r["kept"]]
    assert gone == [900]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, names = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = common.durable(stage(spark, docs, sf_dir), name)
        rows = after.collect()
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in rows} == {d for d, _ in before}
            break
        assert after.columns == columns
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        got = Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "quality_rules":
            assert set(got) <= set(before) and len(rows) > 0.7 * len(before)
        elif name == "line_dedup":
            assert got == Counter(plain_lines(before))
        elif name == "ngram_jaccard_join":
            stay = {d for d, _, c in test_jaccard.plain(before) if d == c}
            assert got == Counter(x for x in before if x[0] in stay)
        else:
            want = {d: (n, gone) for d, n, gone, _, _ in test_passages.plain(before)}
            for r in rows:
                size = len(r["text"].encode())
                n, gone = want[r["doc_id"]]
                assert n - gone <= size <= n - gone + 4 * (gone > 0) * 40
        docs = after
    assert names == [n for n, _ in corpus_pipeline.STAGES]


def test_empty_and_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, __x string"
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "", "en", "", 0, True, "x"), (1, "", "en", "", 0, True, "x"), (2, "w " * 80, "en", "s", 1, False, None)], schema)
    for table in (empty, odd):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.durable(stage(spark, docs, sf_dir), "t")
            assert docs.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()
    assert hashlib.sha256(b"").hexdigest()
