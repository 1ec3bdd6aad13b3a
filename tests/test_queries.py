"""Every query against its SQL on the smallest tables; queries without SQL by what must hold."""

import duckdb
import pytest

from timbrewell.plans.artifacts import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or value != value:
        return "-"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else repr(round(value, 9))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    if name == "pca_variance":
        shares = [r["share"] for r in rows]
        assert shares == sorted(shares, reverse=True) and 0.95 < rows[-1]["upto"] <= 1.000001
    if name == "elbow_sweep":
        costs = [r["inertia"] for r in sorted(rows, key=lambda r: r["k"])]
        assert costs == sorted(costs, reverse=True)
    if name == "html_game_list":
        names = [r["Game"] for r in rows]
        assert names == sorted(set(names)) and all(len(n) >= 3 for n in names)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 60
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pattern_priority_reads_past_200(spark, tmp_path):
    filler = "the music of " + "x" * 250 + " "
    rows = [(3, filler + "composed by Late Name"), (7, "Soundtrack " + "y" * 2959 + " music by Edge Case"), (11, "Soundtrack " + "y" * 2980 + " music by Edge Case"), (15, None)]
    # pages that don't tell of music in their first 2,000 characters are passed over
    rows += [(19, "x" * 250 + " composed by Late Name"), (23, "z" * 2000 + " music by Late Name")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["composer"] for r in QUERIES["pattern_priority"](spark, str(tmp_path)).collect()}
    assert got == {3: "Late Name", 7: "Edge Case", 11: None, 15: None, 19: None, 23: None}


def test_sweep_and_clusters_are_whole(spark, sf_dir, monkeypatch):
    from timbrewell.operators import learning

    fits = []

    class Fit:
        def __init__(self, k, seed, **_):
            fits.append((k, seed))
            self.summary, self.trainingCost = self, 1000.0 / k + seed % 3

        def fit(self, vectors):
            return self

        def transform(self, vectors):
            return vectors.selectExpr("*", "0 AS Cluster")

    monkeypatch.setattr(learning, "KMeans", Fit)
    rows = QUERIES["elbow_sweep"](spark, sf_dir).collect()
    assert sorted(r["k"] for r in rows) == list(range(2, 16))
    assert len(set(fits)) == len(fits) == 140 and {k for k, _ in fits} == set(range(2, 16))
    fits.clear()
    QUERIES["kmeans_clusters"](spark, sf_dir)
    assert sorted(k for k, _ in fits) == [7] * 10 and len(set(fits)) == 10


def test_voice_stream_leaves_its_rows_in_files(spark, sf_dir):
    rows = QUERIES["voice_stream"](spark, sf_dir)
    assert rows.inputFiles() and rows.count() > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("voices_")]
