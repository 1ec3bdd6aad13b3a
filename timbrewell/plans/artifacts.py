"""Queries that write artifacts and read them again, and the smaller operators that the catalog's other queries don't show."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from timbrewell.functions import quality, synth
from timbrewell.operators import enrich, learning, nearest, stats
from timbrewell.plans import views
from timbrewell.plans.catalog import _POINTS, ORACLES, QUERIES, SCORED, _features, _first_id, _points, query, scored
from timbrewell.schema import FEATURES, PRESET
from timbrewell.sources import dmp, files, opm, web

__all__ = ["ORACLES", "QUERIES"]

_COLUMNS = ", ".join(f.name for f in PRESET.fields)


# ---------------------------------------------------------------- files out and in


@query(f"{views.WITH} SELECT {_COLUMNS} FROM v")
def csv_roundtrip(spark, sf_dir):
    """Presets written as CSV and read by their schema."""
    path = files.scratch(spark, "presets-csv")
    files.write_csv(views.presets(spark, sf_dir).select(*PRESET.fieldNames()), path)
    return files.read_csv(spark, path, PRESET)


@query(f"{views.WITH} SELECT CON, count(*) AS n FROM v WHERE FL >= 4 GROUP BY CON")
def cached_step(spark, sf_dir):
    """A step taken twice: the second time from its Parquet."""
    path, rows = files.scratch(spark, "steps"), views.presets(spark, sf_dir).where("FL >= 4")

    def step(df):
        return stats.value_counts(df, "CON")

    files.cached(rows, step, path, least=4)
    return files.cached(rows, step, path, least=4)


@query(f"{views.WITH} SELECT Game FROM g")
def fallback_chain(spark, sf_dir):
    """The first source can't be read, the second has no rows, the third has them, the fourth isn't reached."""
    games = views.tools(spark, sf_dir)
    return web.first_with_rows(
        lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet"),
        lambda: games.where("Game IS NULL"),
        lambda: games,
        lambda: games.select(F.lit("unreached").alias("Game")),
    )


@query(f"""{SCORED} SELECT CAST(preset_id AS VARCHAR) AS id, Name AS name, Game AS game, round(b, 6) AS brightness, round(x, 6) AS complexity, CON AS con, FL AS fl, LFRQ AS lfrq, M1_TL AS m1_tl, C2_AMS_EN AS c2_ams_en FROM s""")
def dataset_json(spark, sf_dir):
    """Presets published as JSON datasets of bounded size, one a file, and loaded again."""

    def slot(s):
        return F.struct(F.col(f"{s}_TL").alias("tl"), F.col(f"{s}_AMS_EN").alias("ams_en")).alias(s.lower())

    params = F.struct(F.col("LFRQ").alias("lfrq"), slot("M1"), slot("C2"))
    preset = F.struct(
        F.col("preset_id").cast("string").alias("id"),
        F.col("Name").alias("name"),
        F.col("Game").alias("game"),
        F.col("Brightness_Index").alias("brightness"),
        F.col("Complexity_Score").alias("complexity"),
        F.col("CON").alias("con"),
        F.col("FL").alias("fl"),
        params.alias("params"),
    )
    sets = scored(spark, sf_dir).groupBy(F.expr("preset_id div 20000")).agg(F.collect_list(preset).alias("presets"))
    path = files.scratch(spark, "datasets")
    sets.select(F.to_json(F.struct("presets")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = web.read_dataset(spark, path)
    cells = [F.col("params.lfrq").alias("lfrq"), F.col("params.m1.tl").alias("m1_tl"), F.col("params.c2.ams_en").alias("c2_ams_en")]
    return rows.select("id", "name", "game", "brightness", "complexity", "con", "fl", *cells)


@query(f"SELECT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{f}{chr(39)}, {chr(39)}pca{chr(39)})' for k, f in enumerate(FEATURES))}) AS t(place, feature, method)")
def feature_columns(spark, sf_dir):
    """The features among a preset's columns, in order, from the files that name them."""
    found = [c for c in views.presets(spark, sf_dir).columns if c in FEATURES]
    path = files.scratch(spark, "features")
    files.write_features(spark, path, found, "pca")
    names, method = files.read_features(spark, path)
    return names.withColumn("method", F.lit(method))


@query(f"{views.WITH} SELECT preset_id AS key, CAST(56 AS INT) AS size, ({' + '.join(f'{k + 1} * {f}' for k, f in enumerate(FEATURES))})::DOUBLE AS weighted FROM v")
def feature_matrix(spark, sf_dir):
    """One vector of all features for each preset, saved as a matrix and read again; weighted sums show order and values."""
    path = files.scratch(spark, "matrix")
    files.save_matrix(learning.assembled(views.presets(spark, sf_dir), FEATURES, "preset_id"), path, "preset_id", "features")
    weighted = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return files.read_matrix(spark, path).select("key", F.size("values").alias("size"), weighted.alias("weighted"))


@query("SELECT length(n_name) + 1 AS length, count(*) AS files FROM nation GROUP BY 1")
def file_inventory(spark, sf_dir):
    """Sizes of the files of a folder, into which each nation's name was written as a file of its own."""
    path = files.scratch(spark, "names")
    views.table(spark, sf_dir, "nation").select("n_name").write.option("maxRecordsPerFile", 1).text(path)
    return files.inventory(spark, path).where("file LIKE 'part-%'").groupBy("length").agg(F.count(F.lit(1)).alias("files"))


@query(f"{views.WITH} SELECT CAST(n - 1 AS INT) AS slot, 'BANK/PATCH' || printf('%02d', n) || '.dmp' AS path, 51 AS size, 'PATCH' || printf('%02d', n) AS name, CON AS algorithm, FL AS feedback, C2_TL AS last_level FROM (SELECT *, row_number() OVER (ORDER BY preset_id) AS n FROM v) WHERE n <= 6 AND n <> 3")
def zip_bank(spark, sf_dir):
    """A bank of six slots, of which the third is empty, as a zip archive, and the instruments in it."""
    first = [r["preset_id"] for r in views.presets(spark, sf_dir).select("preset_id").orderBy("preset_id").limit(6).collect()]
    slot = F.array_position(F.array(*[F.lit(k) for k in first]), F.col("preset_id")).cast("int") - 1
    rows = views.presets(spark, sf_dir).where(F.col("preset_id").isin(first)).withColumn("Composer", F.lit(None).cast("string")).select(slot.alias("slot"), synth.patch_of_preset().alias("patch"))
    bank = dmp.bank_archive(rows.withColumn("patch", F.when(F.col("slot") != 2, F.col("patch"))))
    with zipfile.ZipFile(io.BytesIO(bank)) as archive:
        entries = [(int(n[-6:-4]) - 1, n, bytearray(archive.read(n))) for n in archive.namelist()]
    found = spark.createDataFrame(entries, "slot int, path string, content binary")
    p = F.col("p")
    read = found.withColumn("p", dmp.decoded(F.col("content"), F.col("path")))
    return read.select("slot", "path", F.length("content").alias("size"), p["name"].alias("name"), p["algorithm"].alias("algorithm"), p["feedback"].alias("feedback"), p["operators"][3]["tl"].alias("last_level"))


@query(f"{views.WITH} SELECT Filename, CAST(row_number() OVER (PARTITION BY Filename ORDER BY preset_id) - 1 AS BIGINT) AS place, Num, Name, CON, C2_TL FROM v WHERE preset_id % 7 <> 0")
def no_name_skip(spark, sf_dir):
    """OPM files in which presets called 'no name' stand between the others, parsed: those give no rows."""
    unnamed = F.when(F.col("preset_id") % 14 == 0, F.lit("no name")).when(F.col("preset_id") % 7 == 0, F.lit("No Name"))
    texts = opm.write_text(views.presets(spark, sf_dir).withColumn("Name", F.coalesce(unnamed, F.col("Name"))))
    rows = opm.parse(texts.select(F.lit(0).alias("file_no"), F.col("Filename").alias("path"), "content"))
    return rows.select("Filename", F.col("preset_id").alias("place"), "Num", "Name", "CON", "C2_TL")


# ---------------------------------------------------------------- selections


@query("SELECT 'o_orderkey' AS name, count(o_orderkey) AS filled FROM orders UNION ALL SELECT 'o_custkey', count(o_custkey) FROM orders UNION ALL SELECT 'o_totalprice', count(o_totalprice) FROM orders")
def numeric_columns(spark, sf_dir):
    """The columns of a numeric type, with their values that are no nulls, in one pass."""
    rows = views.table(spark, sf_dir, "orders")
    names = quality.number_columns(rows)
    pairs = ", ".join(f"'{c}', `{c}`" for c in names)
    return rows.agg(*[F.count(c).alias(c) for c in names]).selectExpr(f"stack({len(names)}, {pairs}) AS (name, filled)")


@query(f"{views.WITH} SELECT preset_id FROM v WHERE Game = 'Game 7' UNION SELECT preset_id FROM v WHERE CON = 4")
def index_union(spark, sf_dir):
    """Ids that either of two selections holds, once."""
    rows = views.presets(spark, sf_dir)
    return enrich.union_all([rows.where("Game = 'Game 7'").select("preset_id"), rows.where("CON = 4").select("preset_id")]).distinct()


@query(f"WITH {_POINTS}, q AS (SELECT x AS qx, y AS qy, vec_id AS qid FROM p WHERE vec_id = (SELECT min(vec_id) FROM p)) SELECT vec_id, round(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 6) AS distance FROM p, q WHERE vec_id <> qid ORDER BY sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), vec_id LIMIT 5")
def similar_five(spark, sf_dir):
    """The five that are shown of those nearest in the plane."""
    rows = _points(spark, sf_dir)
    return nearest.plane_neighbours(rows, "vec_id", _first_id(rows, "vec_id"), 5)


_KS = range(2, 16)


@query(f"""WITH c AS (SELECT k, count(*) FILTER (o_orderkey % k = 0) AS y FROM orders, unnest({list(_KS)}) AS t(k) GROUP BY k),
n AS (SELECT k, 1 - (y - min(y) OVER ())::DOUBLE / (max(y) OVER () - min(y) OVER ()) - (k - min(k) OVER ())::DOUBLE / (max(k) OVER () - min(k) OVER ()) AS gap FROM c),
p AS (SELECT k, gap, lag(gap) OVER (ORDER BY k) AS a, lead(gap) OVER (ORDER BY k) AS b FROM n)
SELECT CAST(coalesce((SELECT k FROM p WHERE gap >= a AND gap >= b AND gap > 0 ORDER BY gap DESC, k LIMIT 1), 7) AS INT) AS knee""")
def knee_point(spark, sf_dir):
    """The knee of a falling curve: how many order keys each of 2 to 15 divides."""
    row = views.table(spark, sf_dir, "orders").agg(*[F.count_if(F.col("o_orderkey") % k == 0).alias(f"k{k}") for k in _KS]).first()
    return spark.createDataFrame([(learning.knee(list(_KS), list(row)),)], "knee int")


@query(f"""{views.WITH}, c AS (SELECT Game, count(*) AS n FROM v WHERE Game IS NOT NULL GROUP BY Game),
u AS (SELECT sum(n) OVER (ORDER BY n DESC, Game) AS upto, sum(n) OVER () AS total FROM c)
SELECT CAST(1 + count(*) FILTER (upto::DOUBLE / total < 0.95::DOUBLE - 1e-12) AS INT) AS games FROM u""")
def games_for_share(spark, sf_dir):
    """How many games, the fullest first, hold 95 % of the presets: the rule that counts components."""
    counts = [r["n"] for r in stats.value_counts(views.presets(spark, sf_dir), "Game").collect()]
    return spark.createDataFrame([(learning.components_for([n / sum(counts) for n in sorted(counts, reverse=True)]),)], "games int")


@query()
def embed_graph(spark, sf_dir):
    """The map by the graph of nearest neighbours."""
    return learning.neighbour_map(_features(spark, sf_dir), "preset_id")
