"""Rules that the driver's tables don't exercise, on hand-written inputs."""

import io
import json
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timbrewell.functions import display, naming, quality, synth
from timbrewell.operators import enrich, filters, learning, nearest, stats
from timbrewell.schema import FEATURES, HIGHEST
from timbrewell.sources import dmp, files, opm, web
from timbrewell.streaming import render, timers, voices


def values(df, column):
    return [r[column] for r in df.collect()]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, "Unknown"), ("Game_A_-_Track_1.opm", "Game A"), ("dir/Game_A_-_x_-_y.opm", "dir/Game A"), ("plain.opm", "plain"), ("x.opm.opm", "x")],
)
def test_game_of_file(spark, text, want):
    assert one(spark, text, naming.game_of_file) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None), ("  ab ", None), ("Game (1994)", "Game"), ("Game (1994) Two", "Game Two"), ("Game (UNRELEASED)", "Game"), ("Game (released) x", "Gamex"),
        ("Game (Test  Drive II)", "Game"), ("Game (page 12 of 3)", "Game"), ("External Links", None), ("A   B\tC", "A B C"), ("My 32X Game", None), ("(1994)", None),
    ],
)
def test_clean_game(spark, text, want):
    assert one(spark, text, naming.clean_game) == want


@pytest.mark.parametrize(("text", "want"), [(None, None), (" A (x) ", "A"), ("A (x) [b1]", "A (x)"), ("A [b1] (x)", "A"), ("(x)", None), ("A (x) (y)", "A (x)"), ("  ", None)])
def test_normal_game(spark, text, want):
    assert one(spark, text, naming.normal_game) == want


@pytest.mark.parametrize(("text", "want"), [("Dr. A  B", "A B"), ("mr. X", "X"), ("Mr.X", "Mr.X"), (None, None), (" ", None)])
def test_normal_composer(spark, text, want):
    assert one(spark, text, naming.normal_composer) == want


@pytest.mark.parametrize(("text", "want"), [("Thunder (W) / Other (U)", "Thunder"), ("AB", None), ("A (x) B", "A B"), ("/x", None)])
def test_pack_title(spark, text, want):
    assert one(spark, text, naming.pack_title) == want


HEAD = "//LFO: LFRQ AMD PMD WF NFRQ\n//CH: PAN FL CON AMS PMS SLOT NE\n"


def preset(num, name, base=1):
    ops = "\n".join(f"{s}: " + " ".join(str(base + k) for k in range(11)) for s in ("M1", "C1", "M2", "C2"))
    return f"@:{num} {name}\nLFO: 1 2 3 4 5\nCH: 6 7 8 9 10 11 12\n{ops}\n"


def parsed(spark, *texts):
    df = spark.createDataFrame([(k, f"f{k}.opm", t) for k, t in enumerate(texts)], "file_no int, path string, content string")
    return opm.parse(df).orderBy("preset_id").collect()


def test_opm(spark):
    rows = parsed(spark, HEAD + preset(0, "One") + preset(1, " Two x "), HEAD.replace("\n", "\r\n") + preset(2, "Three").replace("\n", "\r\n"))
    assert [(r["preset_id"], r["Num"], r["Name"], r["Filename"]) for r in rows] == [(0, 0, "One", "f0.opm"), (1, 1, "Two x", "f0.opm"), (opm.IDS_A_FILE, 2, "Three", "f1.opm")]
    assert [(r["LFRQ"], r["NFRQ"], r["NE"], r["M1_AR"], r["C2_AMS_EN"]) for r in rows] == [(1, 5, 12, 1, 11)] * 3


def test_opm_without_head_loses_the_first_lines(spark):
    rows = parsed(spark, preset(0, "One") + preset(1, "Two"))
    assert [(r["LFRQ"], r["M1_AR"]) for r in rows] == [(1, 1), (None, 1)]


def test_opm_too_many_presets(spark, monkeypatch):
    monkeypatch.setattr(opm, "IDS_A_FILE", 2)
    with pytest.raises(Exception, match="too many presets"):
        parsed(spark, HEAD + "".join(preset(k, f"N{k}") for k in range(3)))


def test_listing_walk(spark):
    pack = '<h2>Game {0}</h2><a href="/packs/composer/{0}">C{0}</a>'
    link = '<a href="?p=9">Next »</a>'
    page = lambda k, more, total="": pack.format(k) + total + (link if more else "")
    walk = lambda *html: values(web.walked(web.pages_of(iter(html), spark)).orderBy("page_id"), "page_id")
    assert walk(page(0, True), page(1, True), page(2, False), page(3, True)) == [0, 1, 2]
    assert walk(page(0, True), page(1, True, "<p>Packs 1 to 2 of 2 total</p>"), page(2, True)) == [0, 1]
    assert walk(page(0, True), page(1, True)) == [0, 1]
    some = web.pages_of(iter([page(k, True) for k in range(4)]), spark).where("page_id <> 2")
    assert values(web.walked(some).orderBy("page_id"), "page_id") == [0, 1]


def test_numbers_and_quartiles(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-1000, 10**9), 500)
    got = enrich.numbered(spark.createDataFrame([(k,) for k in ids], "k long"), "k", ranges=7)
    assert {r["k"]: r["n"] for r in got.collect()} == {k: n for n, k in enumerate(sorted(ids), 1)}
    assert enrich.numbered(spark.createDataFrame([], "k long"), "k").count() == 0
    for cells in ([1.0], [2.0] * 9, [rng.choice([0.1, 0.5, rng.random()]) for _ in range(301)], [3.0, None, 1.0, 2.0]):
        df = spark.createDataFrame([(x, None) for x in cells], "a double, b double")
        rows = {r["metric"]: r for r in stats.describe(df, ["a", "b"]).collect()}
        real = [x for x in cells if x is not None]
        want = np.quantile(real, [0.25, 0.5, 0.75])
        assert np.allclose([rows["a"]["q25"], rows["a"]["q50"], rows["a"]["q75"]], want) and rows["a"]["n"] == len(real)
        assert rows["b"]["n"] == 0 and rows["b"]["q50"] is None


def test_all_neighbours_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(130, 5)), 2)
    vectors[7] = vectors[8] = vectors[90]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(500, None)], "k long, v array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    like = np.round(unit @ unit.T, 12)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in nearest.all_neighbours(df, "k", "v", 4).collect()}
    for q in range(130):
        order = sorted((k for k in range(130) if k != q), key=lambda k: (-like[q, k], k))
        assert [got[q, n] for n in (1, 2, 3, 4)] == order[:4]
    assert len(got) == 130 * 4


def test_opm_skips_no_name(spark):
    for order in ((0, 1, 2), (1, 0, 2), (1, 2, 0)):
        parts = [preset(0, "No Name", 50), preset(1, "A", 1), preset(2, "B", 2)]
        rows = parsed(spark, HEAD + "".join(parts[k] for k in order))
        assert [(r["Name"], r["M1_AR"], r["LFRQ"]) for r in rows] == [("A", 1, 1), ("B", 2, 1)]


def test_opm_odd_tokens(spark):
    text = HEAD + preset(0, "A").replace("M1: 1 2", "M1: -1 x").replace("LFO: 1 2 3 4 5", "LFO: 1 2 3") + preset(1, "B").replace("CH: 6", "CH: 6 7 8 9 9 9")
    a, b = parsed(spark, text)
    assert (a["M1_AR"], a["M1_D1R"], a["LFRQ"], a["NFRQ"]) == (-1, None, 1, None)
    assert b["PAN"] == 6 and b["NE"] is not None
    df = spark.createDataFrame([(0, "f", text)], "file_no int, path string, content string")
    assert values(opm.malformed(df), "preset_id") == [0]
    with pytest.raises(Exception, match="malformed"):
        opm.strict(df).collect()


def test_zip_and_folder(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("dir/Game_A_-_T.opm", HEAD + preset(0, "One"))
        z.writestr("b.OPM", HEAD + preset(0, "No"))
        z.writestr("x.txt", "no")
        z.writestr("c.opm", HEAD + preset(1, "Two"))
    rows = opm.read_zip(spark, str(tmp_path / "x.zip")).orderBy("preset_id").collect()
    assert [(r["Filename"], r["Name"]) for r in rows] == [("dir/Game_A_-_T.opm", "One"), ("c.opm", "Two")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.opm").write_text(HEAD + preset(3, "Three"))
    assert values(opm.read_folder(spark, str(tmp_path / "in")), "Name") == ["Three"]


def test_clamp_keeps_nulls(spark):
    df = spark.createDataFrame([(None, -1, 300)], "CON int, FL int, LFRQ int").select("*", *[F.lit(None).cast("int").alias(f) for f in FEATURES if f not in ("CON", "FL", "LFRQ")])
    row = quality.clamp(df).first()
    assert (row["CON"], row["FL"], row["LFRQ"]) == (None, 0, 255)
    again = quality.clamp(quality.clamp(df)).first()
    assert again == row
    assert {r["parameter"]: r["changed"] for r in quality.clamp_report(df).collect()}["CON"] == 1
    assert {r["parameter"] for r in quality.range_violations(df).collect()} == {"FL", "LFRQ"}
    assert set(quality.number_columns(df)) == set(FEATURES) and max(HIGHEST.values()) == 255


def test_first_non_null_mixes_rows(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "c", None), (None, 3, "d", "y"), ("b", 4, None, None)], "g string, o long, p string, q string")
    assert sorted(map(tuple, enrich.first_non_null(df, "g", "o", ["p", "q"]).collect())) == [("a", "c", "x"), ("b", None, None)]


def test_modes_and_deviations_like_pandas(spark):
    pdf = pd.DataFrame({"Game": ["a"] * 4 + ["b"], "CON": [3, 1, 3, 1, 5], "FL": [1, 1, 2, 2, 0], "Brightness_Index": [0.1, 0.2, 0.3, 0.5, 0.9], "Complexity_Score": [1.0, 1.0, 1.0, 1.0, 0.0], "Filename": ["f", None, "f", "f", "f"]})
    got = {r["Game"]: r for r in stats.group_stats(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "Game string, CON int, FL int, Brightness_Index double, Complexity_Score double, Filename string"), "Game").collect()}
    assert (got["a"]["CON_mode"], got["a"]["FL_mode"], got["a"]["presets"]) == (1, 1, 3)
    assert np.isclose(got["a"]["brightness_std"], pdf[pdf.Game == "a"].Brightness_Index.std()) and got["b"]["brightness_std"] is None


def test_filters(spark):
    df = spark.createDataFrame([(1, "Lead", "G", None, "Japan", True, 0, 0.0, 1.0), (2, "Bass", "H", "Leader", None, False, 9, 0.5, None), (3, "Pad", "G", "X", "USA", None, 6, 1.0, 0.2)], "preset_id long, Name string, Game string, Composer string, Nationality string, Uses_GEMS boolean, Cluster int, Brightness_Index double, Complexity_Score double")
    ids = lambda p: values(df.where(p.predicate()).orderBy("preset_id"), "preset_id")
    f = filters.PresetFilter
    assert ids(f()) == [1, 2, 3] and ids(f(search="lead")) == [1, 2] and ids(f(clusters=(0,))) == [1, 2] and ids(f(clusters=(6,))) == [3]
    assert ids(f(gems=False)) == [2, 3] and ids(f(gems=True)) == [1] and ids(f(composer="X")) == [3] and ids(f(nationality="Japan")) == [1]
    assert ids(f(brightness=(0.5, 1.0))) == [2, 3] and ids(f(complexity=(0.1, 1.0))) == [1, 3] and ids(f(game="G", search="pad")) == [3]
    p = f().toggled(2).toggled(3)
    assert p.clusters == (2, 3) and p.toggled(2).clusters == (3,) and p.only(None).clusters == () and p.active and not f(search="x").active
    assert values(filters.point_lookup(df, 9, "Bass", "H"), "preset_id") == [2] and filters.point_lookup(df, None, "Bass").count() == 0
    assert values(df.where(filters.matches("L.ad", "Name")), "preset_id") == [1] and df.where(filters.matches("L.ad", "Name", literal=True)).count() == 0


@pytest.mark.parametrize(("v", "want"), [(None, False), ("", False), (" ", False), ("TRUE", True), ("0", False), ("2", True), ("n", False), ("maybe", True), (" Gems ", True)])
def test_yes(spark, v, want):
    assert one(spark, v, display.is_yes) is want


def test_display(spark):
    df = spark.createDataFrame([(None,), (-1,), (0,), (6,), (7,)], "c int")
    assert values(df.select(display.cluster_id(F.col("c")).alias("v")), "v") == [0, 0, 0, 6, 0]
    row = spark.range(1).select(display.percent(F.lit(1), F.lit(0)), display.percent(F.lit(1), F.lit(8)), display.greyed(F.lit("#ff0000"), 1.0), display.country_flag(F.lit("x")), display.or_unknown(F.lit("")), display.wave_height(F.lit(64), 100.0)).first()
    assert tuple(row) == (0, 13, "#555555", "??", "Unknown", 25.0)
    assert spark.range(1).select(display.is_yes(F.lit(0.0), number=True)).first()[0] is False


def test_notes(spark):
    def plain(n):
        m = 440 * 2 ** ((n - 69) / 12) * 1048576 * 144 / 7670448
        block = min(7, max(0, (n - 12) // 12))
        while round(m / 2 ** (block - 1)) > 2047 and block < 7:
            block += 1
        return block, min(2047, int(m / 2 ** (block - 1) + 0.5))

    df = spark.range(128).select("id", synth.frequency_number(F.col("id")).alias("f"))
    assert [(r["f"]["block"], r["f"]["fnum"]) for r in df.orderBy("id").collect()] == [plain(n) for n in range(128)]
    assert spark.range(1).select(synth.midi_note(F.lit(9), F.lit(12))).first()[0] == 108


def a_patch(spark, n=1):
    ops = F.array(*[F.struct(*[F.lit(v % 32).alias(f) for v, f in enumerate(("mul", "tl", "ar", "dr", "sl", "rr"))], F.lit(True).alias("am"), F.lit(2).alias("rs"), F.lit(k).alias("dt"), F.lit(9).alias("sr")) for k in range(4)])
    patch = F.struct(F.lit("x").alias("name"), F.lit("").alias("description"), F.lit(4).alias("algorithm"), F.lit(5).alias("feedback"), F.lit(0).alias("lfo"), F.lit(1).alias("ams"), F.lit(3).alias("fms"), ops.alias("operators"))
    return spark.range(n).select(F.col("id").alias("slot"), patch.alias("patch"))


def test_dmp(spark):
    rows = a_patch(spark).select("patch", dmp.encoded().alias("content"), F.lit("a/b/my.sound.dmp").alias("path"))
    back = dmp.decode(rows.select("path", "content")).first()
    first = rows.first()
    assert back["patch"]["name"] == "MY.SOUND" and back["fault"] is None and back["other_version"] is False
    assert back["patch"]["operators"] == first["patch"]["operators"] and back["patch"]["algorithm"] == 4
    body = bytes(first["content"])
    cases = [(body[:50], "too small"), (body[:1] + b"\3" + body[2:], "unknown system"), (body[:2] + b"\0" + body[3:], "not an FM instrument"), (b"\x0a\1" + body[2:], None)]
    df = spark.createDataFrame([("x.dmp", bytearray(b)) for b, _ in cases], "path string, content binary")
    got = dmp.decode(df).collect()
    assert [r["fault"] for r in got] == [f for _, f in cases] and got[3]["other_version"] and got[0]["patch"] is None
    names = zipfile.ZipFile(io.BytesIO(dmp.bank_archive(a_patch(spark, 3)))).namelist()
    assert names == ["BANK/PATCH01.dmp", "BANK/PATCH02.dmp", "BANK/PATCH03.dmp"]


def test_pages(spark):
    a = '<div class="x mobile-columns"><ul><li><a href="#">Game <b>One</b> (1994)</a><ul><li><a>Two Games</a></li></ul></li></ul></div><ul><li><a>Other</a></li></ul>'
    b = '<div id="mw-content-text"><ul><li><a>First</a> <a>Second</a></li><li>none</li></ul></div><ul><li><a>Outside</a></li></ul>'
    assert web.listed(a) == ["GameOne(1994)", "Two Games"] and web.listed(b) == ["First"] and web.listed("<ul><li><a>Only</a></li></ul>") == ["Only"] and web.listed(None) == []
    pages = web.pages_of(iter([a, b]), spark)
    assert values(web.games_of_pages(pages), "Game") == ["First", "GameOne", "Two Games"]
    listing = '<h2>Thunder (W) / T2</h2><a href="/packs/composer/a">Ann B</a><a href="/packs/composer/a">Ann B</a><a href="/x">no</a><h2>Bare</h2><h2 class="t">Next <i>One</i></h2><a class="c" href="https://v/packs/composer/c">Cy</a>'
    found = web.packs(web.pages_of(iter([listing]), spark)).orderBy("place").collect()
    assert [(r["Game"], r["Composers"]) for r in found] == [("Thunder", ["Ann B"]), ("Next One", ["Cy"])]
    assert web.pack_rows(web.packs(web.pages_of(iter([listing]), spark))).count() == 2
    payload = spark.createDataFrame([(json.dumps({"parse": {"text": "a"}}),), (json.dumps({"parse": {"text": {"*": "<b>"}}}),), ("{}",)], "p string")
    assert values(payload.select(web.envelope_html(F.col("p")).alias("v")), "v") == ["a", "<b>", None]
    first = web.first_with_rows(lambda: spark.read.parquet("/no/such"), lambda: spark.range(0), lambda: spark.range(2))
    assert first.count() == 2
    articles = spark.createDataFrame([("G", 1, "nothing", ""), ("G", 2, "It had music by Ann Byte, composed by Zed Ypsil.", "A Japanese composer"), ("H", 1, "x", "")], "Game string, rank int, text string, about string")
    assert [tuple(r) for r in web.look_up(articles.select("Game"), articles).collect()] == [("G", "Zed Ypsil", "Japan", "Wikipedia")]


def test_dataset(spark, tmp_path):
    body = {"presets": [{"id": "1", "name": "n", "game": "g", "x": 1.0, "y": 2.0, "cluster": 3, "gems": True, "params": {"lfrq": 1, "m1": {"ar": 31, "tl": 2}}}], "nationalities": ["Japan"]}
    (tmp_path / "d.json").write_text(json.dumps(body, indent=1))
    row = web.read_dataset(spark, str(tmp_path / "d.json")).first()
    assert row["params"]["m1"]["ar"] == 31 and row["composer"] is None


def test_files(spark, tmp_path):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    calls = []

    def step(x):
        calls.append(1)
        return x.where("id < 10")

    for table in (df, df, df.where("id <> 3")):
        assert files.cached(table, step, str(tmp_path / "c"), k=1).count() in (9, 10)
    assert len(calls) == 2
    files.write_csv(df, str(tmp_path / "csv"), one_file=True)
    assert files.read_csv(spark, str(tmp_path / "csv"), df.schema).count() == 50
    assert sorted(values(files.sample_rows(df, "id", 7), "id")) == sorted(values(files.sample_rows(df.repartition(3), "id", 7), "id"))
    files.write_features(spark, str(tmp_path / "f"), FEATURES, "pca")
    assert json.loads(spark.read.text(str(tmp_path / "f" / "feature_columns")).first()[0]) == FEATURES
    assert files.inventory(spark, str(tmp_path / "f")).count() >= 2


def test_neighbours_leave_twins_in(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])], "k long, v array<double>")
    assert [(r["k"], r["rank"]) for r in nearest.cosine_neighbours(df, "k", "v", 1, 3).orderBy("rank").collect()] == [(2, 1), (4, 2), (3, 3)]
    every = nearest.all_neighbours(df, "k", "v", 2).collect()
    assert {r["query"]: r["neighbour"] for r in every if r["rank"] == 1}[1] == 2 and all(r["query"] != r["neighbour"] for r in every)
    flat = df.select("k", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    assert [r["k"] for r in nearest.plane_neighbours(flat, "k", 4, 2).collect()] == [1, 2]


def test_learning(spark):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(c, 0.1, (40, 4)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(k, *map(float, row), 3.0) for k, row in enumerate(data)], "k long, a double, b double, c double, d double, e double")
    names = ["a", "b", "c", "d", "e"]
    rows = learning.scaled(df, names)
    got = np.array([[r[n] for n in names] for r in rows.orderBy("k").collect()])
    assert np.allclose(got[:, :4], (data - data.mean(0)) / data.std(0)) and (got[:, 4] == 0).all()
    vectors = learning.assembled(rows, names, "k").persist()
    _, shares = learning.principal(vectors, 3)
    eigen = np.sort(np.linalg.eigvalsh(np.cov(got.T)))[::-1]
    assert np.allclose(shares, (eigen / eigen.sum())[:3])
    labelled, cost = learning.clusters(vectors, 3, (1, 2))
    groups = {r["k"] // 40: r["Cluster"] for r in labelled.collect()}
    assert len(set(groups.values())) == 3 and cost > 0
    costs = learning.elbow(vectors, range(2, 6)).orderBy("k").collect()
    assert learning.knee([r["k"] for r in costs], [r["inertia"] for r in costs]) == 3
    assert learning.knee([1, 2], [1, 0]) == 7 and learning.components_for([0.5, 0.45, 0.05]) == 2 and learning.components_for([0.1, 0.1]) == 3
    spread = learning.neighbour_map(vectors, "k", 5, 2)
    assert spread.count() == 120


def test_streams(spark, tmp_path):
    events = [(1, k, 60 + k, True) for k in range(7)] + [(1, 7, 61, False), (1, 8, 60, False), (2, 0, 50, True), (2, 1, 50, True), (2, 2, 50, False)]
    schema = "session long, seq long, note int, is_on boolean"
    batch = spark.createDataFrame(events, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = voices.stream_voices(stream).writeStream.format("memory").queryName("voices").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("voices").collect()))
    ons = [(s, q, n, True, c) for s, q, n, c in map(tuple, voices.round_robin(batch.where("is_on").drop("is_on"), "session", "seq").select("session", "seq", "note", "channel").collect())]
    offs = {(r["session"], r["off_seq"], r["channel"]) for r in voices.releases(batch.where("is_on").drop("is_on"), batch.where("NOT is_on").drop("is_on")).collect()}
    assert [x for x in got if x[3]] == sorted(ons)
    assert {(x[0], x[1], x[4]) for x in got if not x[3]} == offs == {(1, 7, 1), (2, 2, 0), (2, 2, 1)}
    slots = spark.createDataFrame([(0, 1, "a"), (0, 2, None), (1, 1, "b"), (1, 3, "c")], "slot int, seq long, patch string")
    assert [tuple(r) for r in voices.last_slots(slots).collect()] == [(1, "c")]


def test_render(spark):
    jobs = a_patch(spark, 2).select(F.col("slot").alias("job"), F.lit(69).alias("note"), F.lit(300).alias("off"), "patch")
    rows = render.rendered(jobs, 400)
    assert rows.count() == 800
    top = rows.agg(F.max(F.abs("left"))).first()[0]
    assert 0 < top <= 1
    ops = [{"ar": 31, "dr": 0, "sr": 0, "sl": 0, "rr": 15, "tl": 127 if k != 3 else 0, "mul": 1} for k in range(4)]
    sound = render.render({"algorithm": 7, "feedback": 0, "operators": ops}, 69, 4410, 4410)
    spectrum = np.abs(np.fft.rfft(sound))
    assert abs(np.argmax(spectrum) * render.RATE / 4410 - 440) < 15


def test_timers_against_a_walk_over_samples():
    """Writes at random against counters that step sample by sample."""
    rng = random.Random(6)
    for _ in range(40):
        at = sorted(rng.sample(range(3000), rng.randint(1, 8)))
        writes = [(x, rng.choice([0, 900, 1000, 1023, 700]), rng.choice([255, 250, 200]), rng.randrange(64) | rng.choice([0, 64, 128, 192])) for x in at]
        left, status, mode, held, want = [0, 0], [False, False], 0, list(writes), []
        a = b = 0
        for t in range(4000):
            left = [x - 1 if mode & (1 << k) else x for k, x in enumerate(left)]
            if held and held[0][0] == t:
                _, a, b, now = held.pop(0)
                for k, period in enumerate((1024 - a, (256 - b) * 16)):
                    if now & (1 << k) and not mode & (1 << k):
                        left[k] = period
                    if now & (16 << k):
                        status[k] = False
                mode = now
            for k, period in enumerate((1024 - a, (256 - b) * 16)):
                if mode & (1 << k) and left[k] <= 0:
                    want.append((t, "AB"[k], bool(mode & (4 << k)) and not status[k], k == 0 and mode & 0xC0 == 0x80))
                    status[k] = status[k] or bool(mode & (4 << k))
                    left[k] = period
        assert timers.overflows(writes, 4000) == want


def test_blocks_and_matrices(spark, tmp_path):
    sound = spark.createDataFrame([("j", k, float(k), -float(k)) for k in range(10)], "job string, sample int, left double, right double")
    got = {r["block"]: (r["left"], r["right"]) for r in render.in_blocks(sound, 4, 0.5).collect()}
    assert got[0][0] == [0.0, 0.5, 1.0, 1.5] and got[2][0] == [4.0, 4.5, 0.0, 0.0] and got[1][1] == [-2.0, -2.5, -3.0, -3.5]
    df = spark.createDataFrame([(k, float(k), 1.0) for k in range(20)], "k long, a double, b double")
    files.save_matrix(learning.assembled(df, ["a", "b"], "k"), str(tmp_path / "m"), "k", "features")
    assert {r["key"]: r["values"] for r in files.read_matrix(spark, str(tmp_path / "m")).collect()} == {k: [float(k), 1.0] for k in range(20)}


def test_graph_map_keeps_groups_that_the_plane_mixes(spark):
    rng, groups, each = np.random.default_rng(3), 6, 30
    data = np.concatenate([np.eye(8)[g] * 6 + rng.normal(0, 0.5, (each, 8)) for g in range(groups)])
    names = [f"c{k}" for k in range(8)]
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(data)], "k long, " + ", ".join(f"{n} double" for n in names))
    vectors = learning.assembled(df, names, "k").persist()

    def together(rows):
        at = np.array([[r["embed_x"], r["embed_y"]] for r in sorted(rows.collect(), key=lambda r: r["k"])])
        apart = ((at[:, None] - at[None]) ** 2).sum(2)
        np.fill_diagonal(apart, np.inf)
        return (apart.argsort(1)[:, :10] // each == np.arange(len(at))[:, None] // each).mean()

    found = learning.neighbour_map(vectors, "k", 10, 25)
    assert together(found) > 0.95 > together(learning.plane(vectors, "k"))
    edges = learning.fuzzy_graph(vectors, "k", 10).collect()
    assert all(r["a"] < r["b"] and 0 < r["weight"] <= 1 for r in edges)
    gaps = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    near = {(min(i, j), max(i, j)) for i in range(len(data)) for j in np.argsort(gaps[i])[1:11].tolist()}
    assert {(r["a"], r["b"]) for r in edges} == near
    assert np.allclose(learning.curve(0.1), (1.577, 0.895), atol=0.01)


def test_a_long_session_leaves_in_parts(monkeypatch):
    import pandas as pd

    class State:
        exists = False

        def update(self, held):
            self.held = held

    monkeypatch.setattr(voices, "ROWS_AT_ONCE", 10, raising=False)
    events = pd.DataFrame({"seq": range(95), "note": [60 + k % 7 for k in range(95)], "is_on": [k % 4 > 0 for k in range(95)]})
    state = State()
    parts = list(voices._allot((1,), [events[50:], events[:50]], state))
    assert max(map(len, parts)) <= 10 + 5  # a note-off frees at most all channels
    rows = pd.concat(parts)
    assert rows["seq"].is_monotonic_increasing and rows["is_on"].sum() == events["is_on"].sum() and state.held[0] == events["is_on"].sum() % 6


def test_fits_share_their_passes_and_count_copies(spark):
    rng = np.random.default_rng(5)
    some = np.round(rng.normal(0, 1, (150, 3)) + 4 * np.eye(3)[rng.integers(0, 3, 150)], 2)
    data = np.concatenate([some, some[:40], some[:40], some[:1].repeat(70, axis=0)])
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(data)], "k long, a double, b double, c double")
    vectors = learning.assembled(df, ["a", "b", "c"], "k").repartition(3)
    group = "sweep-of-fits"
    spark.sparkContext.setJobGroup(group, group)
    costs = {r["k"]: r["inertia"] for r in learning.elbow(vectors, range(2, 7)).collect()}
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 250  # 50 fits, each of which had some 20 jobs of its own
    from timbrewell.operators import means

    asked = [(k, seed) for k in range(2, 7) for seed in learning.RESTARTS]
    found = means.Sweep(vectors, asked).found()
    for (k, _), (centres, cost) in found.items():
        gaps = ((data[:, None] - centres[None]) ** 2).sum(2)
        own = gaps.argmin(1)
        assert len(centres) == k and np.isclose(cost, gaps.min(1).sum()) and cost >= costs[k] - 1e-9
        assert np.allclose(centres, [data[own == c].mean(0) for c in range(k)], atol=2e-4)
    few = means.Sweep(vectors.where("k < 2"), [(5, 1)]).found()[5, 1]
    assert len(few[0]) == 2 and few[1] == 0
    shared = means._added, means._least
    for together, bodies in zip(shared, ([np.array([1.0, 2.0]).tobytes(), np.array([3.0, 5.0]).tobytes()],) * 2, strict=True):
        part = together([(0, 2.0, bodies[0]), (0, 1.0, bodies[1])])
        assert part[0] == ((3.0, np.array([4.0, 7.0]).tobytes()) if together is means._added else (1.0, bodies[1]))


def test_sums_of_many_tasks_are_joined_before_the_driver(spark, monkeypatch):
    from timbrewell.operators import means

    df = spark.createDataFrame([(k, float(k % 50), float(k % 7)) for k in range(400)], "k long, a double, b double")
    vectors = learning.assembled(df, ["a", "b"], "k")
    asked = [(k, seed) for k in (2, 4) for seed in (1, 2)]
    one = means.Sweep(vectors, asked).found()
    monkeypatch.setattr(means, "FEW_TASKS", 0)
    many = means.Sweep(vectors, asked).found()
    assert all(np.allclose(one[a][0], many[a][0]) and np.isclose(one[a][1], many[a][1]) for a in asked)


def test_copies_share_a_place_and_link_to_other_vectors(spark):
    rng = np.random.default_rng(4)
    some = np.concatenate([np.eye(6)[g] * 6 + rng.normal(0, 0.5, (12, 6)) for g in range(4)])
    data = np.concatenate([some] * 9)  # more copies than neighbours
    names = [f"c{k}" for k in range(6)]
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(data)], "k long, " + ", ".join(f"{n} double" for n in names))
    rows = sorted(learning.neighbour_map(learning.assembled(df, names, "k").persist(), "k", 5, 15).collect(), key=lambda r: r["k"])
    at = np.array([[r["embed_x"], r["embed_y"]] for r in rows])
    assert len(at) == len(data) and (at.reshape(9, 48, 2) == at[:48]).all()
    apart = ((at[:48, None] - at[None, :48]) ** 2).sum(2)
    np.fill_diagonal(apart, np.inf)
    assert (apart.argsort(1)[:, :4] // 12 == np.arange(48)[:, None] // 12).mean() > 0.95
