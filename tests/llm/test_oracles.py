"""The queries with SQL against it, on the driver's smallest tables and on the hot features of odd ones."""

from collections import Counter

import duckdb
import pytest

from timbrewell.llm import catalog, jaccard, lines, passages, pieces, varbyte


def cell(x):
    return round(x, 9) if isinstance(x, float) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(catalog.ORACLES[name])
    df = catalog.QUERIES[name](spark, sf_dir)
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in found.description], found.fetchall())


def test_clashing_names(spark):
    names = ["__lines", "__dropped", "__hashes", "__id", "__bytes", "__removed", "__spans", "block", "extra", "sizes", "body", "pieces", "places", "row", "rep", "answers", "lost"]
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{long}\nthe same line in all documents", *[f"{k}{c}" for c in names]) for k in range(5)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} string" for c in names)]))
    for out, added in ((lines.dedup_lines(df), ["___lines", "___dropped"]), (passages.dedup_passages(df, whole_characters=True), ["___bytes", "___removed", "___spans"]), (jaccard.keep_one(df), [])):
        assert out.columns == [*df.columns, *added]
        got = {r["doc_id"]: tuple(r)[2 : 2 + len(names)] for r in out.collect()}
        assert all(got[k] == rows[k][2:] for k in got) and (len(got) == 5 or not added)
    assert pieces.piece_digest(df).count() == 5 and varbyte.round_trip(df).count() == 5


def test_texts_longer_than_a_block(spark):
    """9 MB in one text: over a block and over a slice."""
    text = "\n".join(f"line number {k} of a long text" for k in range(300_000))
    shared = "line number 7 of a long text"
    rows = [(1, text), (2, shared), (3, shared + "\n" + "x" * 30), (4, "line number 8 OF a long text\nown")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in lines.line_digest(df).collect()}
    assert got == {1: (300_000, 1), 2: (1, 1), 3: (2, 0), 4: (2, 0)}
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df.union(spark.createDataFrame([(5, text.replace("line number 9 ", "line number nine "))], "doc_id long, text string"))).collect()}
    assert found[5][1] == 1 and found[1][1] == 1 and found[2][1] == 2
    kept = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in passages.passage_digest(spark.createDataFrame([(1, text), (2, text[5_000_000:5_000_500] + "#")], "doc_id long, text string")).collect()}
    assert kept[2] == (501, 500) and kept[1][0] == len(text)
    tokens = {r["doc_id"]: r["n_tokens"] for r in varbyte.round_trip(df).collect()}
    assert tokens[1] > 1_000_000 and tokens[2] < 20
