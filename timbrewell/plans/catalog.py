"""Queries over the driver's tables and the SQL that must give the same rows.

Doubles are rounded to six places on both sides, since sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrewell.functions import display, naming, quality, synth
from timbrewell.functions.scores import with_scores
from timbrewell.operators import enrich, filters, learning, nearest, stats
from timbrewell.plans import views
from timbrewell.schema import FEATURES, HIGHEST, LEVELS, OPERATOR, SLOTS
from timbrewell.sources import dmp, files, opm, web
from timbrewell.streaming import timers, voices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SUM = {p: " + ".join(f"{s}_{p}" for s in SLOTS) for p in OPERATOR}
_AUDIBLE = " + ".join(f"CAST({s}_TL < 127 AS INT)" for s in SLOTS)
SCORED = f"""{views.WITH}, s AS (SELECT v.*,
 greatest(0::DOUBLE, least(1::DOUBLE, 0.4::DOUBLE * (1::DOUBLE - ({_SUM["TL"]})::DOUBLE / 4 / 127) + 0.3::DOUBLE * (({_SUM["AR"]})::DOUBLE / 4 / 31) + 0.3::DOUBLE * (({_SUM["MUL"]})::DOUBLE / 4 / 15))) AS b,
 0.4::DOUBLE * (CON::DOUBLE / 7) + 0.4::DOUBLE * (({_AUDIBLE})::DOUBLE / 4) + 0.2::DOUBLE * (FL::DOUBLE / 7) AS x FROM v),
f AS (SELECT Game, arg_min(Composer, ord) FILTER (Composer IS NOT NULL) AS Composer, arg_min(Nationality, ord) FILTER (Nationality IS NOT NULL) AS Nationality FROM d GROUP BY Game),
e AS (SELECT s.*, f.Composer, f.Nationality, g.Game IS NOT NULL AS Uses_GEMS, CAST(preset_id % 9 AS INT) - 1 AS Cluster,
 CASE WHEN preset_id % 9 BETWEEN 1 AND 7 THEN CAST(preset_id % 9 AS INT) - 1 ELSE 0 END AS k FROM s LEFT JOIN f ON s.Game = f.Game LEFT JOIN g ON s.Game = g.Game)
"""


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c), 6) for c, t in df.dtypes if t == "double"})

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _mode(c: str, source: str, key: str) -> str:
    return f"SELECT {key} AS key, {c} AS mode FROM (SELECT {key}, {c}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {c}) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {key}, {c}) WHERE n = 1"


def _group_sql(key: str, more: str = "", spread: bool = True, source: str = "e", joins: str = "") -> str:
    std = ", round(stddev_samp(b), 6) AS brightness_std, round(stddev_samp(x), 6) AS complexity_std" if spread else ""
    return f"""{SCORED}, m1 AS ({_mode("CON", source, key)}), m2 AS ({_mode("FL", source, key)}), m3 AS ({_mode("Game", source, key)}),
a AS (SELECT {key}, round(avg(b), 6) AS brightness_mean, round(avg(x), 6) AS complexity_mean{std}, count(Filename) AS presets{more} FROM {source} WHERE {key} IS NOT NULL GROUP BY {key})
SELECT a.*, m1.mode AS CON_mode, m2.mode AS FL_mode{joins} FROM a JOIN m1 ON a.{key} = m1.key JOIN m2 ON a.{key} = m2.key LEFT JOIN m3 ON a.{key} = m3.key"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_scores(views.presets(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrich.with_composers(scored(spark, sf_dir), views.composers(spark, sf_dir))
    rows = enrich.with_tool_flag(rows, views.tools(spark, sf_dir))
    return rows.withColumn("Cluster", (F.col("preset_id") % 9).cast("int") - 1)


# ---------------------------------------------------------------- statistics


@query(_group_sql("Game", source="s"))
def game_stats(spark, sf_dir):
    return stats.group_stats(scored(spark, sf_dir), "Game")


@query(_group_sql("Composer", ", arg_min(Nationality, preset_id) FILTER (Nationality IS NOT NULL) AS Nationality"))
def composer_stats(spark, sf_dir):
    return stats.composer_stats(enriched(spark, sf_dir))


@query(_group_sql("Nationality", spread=False))
def nationality_stats(spark, sf_dir):
    return stats.nationality_stats(enriched(spark, sf_dir))


@query(_group_sql("k", spread=False, joins=", m3.mode AS Game_mode"))
def cluster_stats(spark, sf_dir):
    rows = enriched(spark, sf_dir).withColumn("k", display.cluster_id(F.col("Cluster")))
    return stats.cluster_stats(rows, "k")


@query(f"{views.WITH} SELECT CON, count(*) AS n FROM v GROUP BY CON")
def con_distribution(spark, sf_dir):
    return stats.value_counts(views.presets(spark, sf_dir), "CON", least_first=True)


@query(f"{views.WITH} SELECT Game, count(*) AS n FROM v WHERE Game IS NOT NULL GROUP BY Game")
def value_counts(spark, sf_dir):
    return stats.value_counts(views.presets(spark, sf_dir), "Game")


@query(f"{views.WITH} SELECT Game, count(*) AS n FROM v WHERE Game IS NOT NULL GROUP BY Game ORDER BY n DESC, Game LIMIT 10")
def top_games(spark, sf_dir):
    return stats.value_counts(views.presets(spark, sf_dir), "Game").limit(10)


def _describe_sql(metric: str, c: str) -> str:
    qs = ", ".join(f"round(quantile_cont({c}, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
    return f"SELECT '{metric}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS least, {qs}, round(max({c}), 6) AS greatest FROM s"


@query(f"{SCORED} {_describe_sql('Brightness_Index', 'b')} UNION ALL {_describe_sql('Complexity_Score', 'x')}")
def score_describe(spark, sf_dir):
    return stats.describe(scored(spark, sf_dir), ["Brightness_Index", "Complexity_Score"])


@query(f"{SCORED}, w AS (SELECT min(b) AS lo, max(b) AS hi FROM s) SELECT CAST(CASE WHEN hi > lo THEN least(floor((b - lo) / ((hi - lo) / 50::DOUBLE)), 49) ELSE 0 END AS INT) AS bin, count(*) AS n FROM s, w GROUP BY 1")
def score_histogram(spark, sf_dir):
    return stats.histogram(scored(spark, sf_dir), "Brightness_Index")


@query(f"{views.WITH} SELECT Game, " + ", ".join(f"round(count(*) FILTER (CON = {k}) * 100::DOUBLE / count(*), 6) AS v{k}" for k in range(8)) + " FROM v WHERE Game IS NOT NULL GROUP BY Game")
def con_crosstab_pct(spark, sf_dir):
    return stats.crosstab_percent(views.presets(spark, sf_dir), "Game", "CON", list(range(8)))


@query(f"{SCORED} SELECT count(*) AS presets, count(DISTINCT Game) AS games, count(DISTINCT Composer) AS composers, count(DISTINCT Nationality) AS nationalities, count(*) FILTER (Uses_GEMS) AS flagged FROM e")
def dataset_summary(spark, sf_dir):
    return stats.summary(enriched(spark, sf_dir))


@query(f"{SCORED} SELECT Composer, count(*) AS n, string_agg(DISTINCT Game, '|' ORDER BY Game) AS games, round(avg(b), 6) AS brightness_mean, round(avg(x), 6) AS complexity_mean FROM e WHERE Composer IS NOT NULL GROUP BY Composer")
def composer_entities(spark, sf_dir):
    return stats.entity_stats(enriched(spark, sf_dir), "Composer")


@query(f"""{views.WITH}, u AS (SELECT Game, Composer, row_number() OVER (PARTITION BY Game ORDER BY min(ord)) AS n FROM d WHERE Composer IS NOT NULL GROUP BY Game, Composer)
SELECT a.Game, a.n, c.composers FROM (SELECT Game, count(*) AS n FROM d GROUP BY Game) a LEFT JOIN (SELECT Game, string_agg(Composer, ', ' ORDER BY n) AS composers FROM u WHERE n <= 3 GROUP BY Game) c ON a.Game = c.Game""")
def game_first_composers(spark, sf_dir):
    return stats.first_composers(views.composers(spark, sf_dir))


# ---------------------------------------------------------------- cleaning

_KEYS = ", ".join(["Game", *[f for f in FEATURES if f not in LEVELS]])


@query(f"{views.WITH} SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY preset_id) AS n FROM v) WHERE n = 1")
def dedup_except_tl(spark, sf_dir):
    return enrich.dedup_but_levels(views.presets(spark, sf_dir))


@query(f"{views.WITH}, u AS (SELECT count(*) AS n FROM v GROUP BY {_KEYS}) SELECT CAST(sum(n) AS BIGINT) AS before, count(*) AS after, CAST(sum(n) - count(*) AS BIGINT) AS removed, CAST((sum(n) - count(*)) * 10000 // sum(n) AS BIGINT) AS removed_bp FROM u")
def dedup_report(spark, sf_dir):
    return enrich.dedup_report(views.presets(spark, sf_dir))


def _clamped(f: str) -> str:
    return f"CASE WHEN {f} IS NOT NULL THEN greatest(0, least({HIGHEST[f]}, {f})) END"


@query(f"{views.WITH} SELECT preset_id, {', '.join(f'{_clamped(f)} AS {f}' for f in FEATURES)} FROM r")
def clamp_params(spark, sf_dir):
    return quality.clamp(views.raw_presets(spark, sf_dir)).select("preset_id", *FEATURES)


@query(f"{views.WITH} " + " UNION ALL ".join(f"SELECT '{f}' AS parameter, n AS changed FROM (SELECT count(*) AS n FROM r WHERE {f} IS NULL OR {f} <> {_clamped(f)}) WHERE n > 0" for f in FEATURES))
def clamp_report(spark, sf_dir):
    return quality.clamp_report(views.raw_presets(spark, sf_dir))


@query(f"{views.WITH} " + " UNION ALL ".join(f"SELECT '{f}' AS parameter, n AS invalid FROM (SELECT count(*) AS n FROM r WHERE {f} < 0 OR {f} > {HIGHEST[f]}) WHERE n > 0" for f in FEATURES))
def range_violations(spark, sf_dir):
    return quality.range_violations(views.raw_presets(spark, sf_dir))


@query(f"{views.WITH} " + " UNION ALL ".join(f"SELECT '{f}' AS parameter, n AS invalid FROM (SELECT count(*) AS n FROM r WHERE {f} < 0 OR {f} > {HIGHEST[f]}) WHERE n > 0" for f in ("CON", "FL")))
def range_violations_narrow(spark, sf_dir):
    return quality.range_violations(views.raw_presets(spark, sf_dir), narrow=True)


@query(f"{views.WITH} " + " UNION ALL ".join(f"SELECT '{c}' AS parameter, n AS missing FROM (SELECT count(*) AS n FROM r WHERE {c} IS NULL) WHERE n > 0" for c in ("Game", "CON", "FL")))
def completeness(spark, sf_dir):
    return quality.completeness(views.raw_presets(spark, sf_dir))


@query(f"{views.WITH} SELECT preset_id, {', '.join(f'CAST(coalesce({f}, 0) AS BIGINT) AS {f}' for f in FEATURES)} FROM r")
def fill_missing(spark, sf_dir):
    return quality.filled(views.raw_presets(spark, sf_dir)).select("preset_id", *FEATURES)


# ---------------------------------------------------------------- joins


@query(f"{SCORED} SELECT preset_id, Game, Composer, Nationality FROM e")
def enrich_left_join(spark, sf_dir):
    return enrich.with_composers(views.presets(spark, sf_dir), views.composers(spark, sf_dir)).select("preset_id", "Game", "Composer", "Nationality")


@query(f"{SCORED} SELECT preset_id, Game, Uses_GEMS FROM e")
def gems_flag(spark, sf_dir):
    return enrich.with_tool_flag(views.presets(spark, sf_dir), views.tools(spark, sf_dir)).select("preset_id", "Game", "Uses_GEMS")


@query(f"""{SCORED} SELECT a.*, c.games, c.mean_presets FROM (SELECT Uses_GEMS, count(*) AS presets, round(count(*) * 100::DOUBLE / (SELECT count(*) FROM e), 6) AS percent FROM e GROUP BY Uses_GEMS) a
LEFT JOIN (SELECT Uses_GEMS, count(*) AS games, round(avg(n), 6) AS mean_presets FROM (SELECT Uses_GEMS, Game, count(*) AS n FROM e WHERE Game IS NOT NULL GROUP BY ALL) GROUP BY Uses_GEMS) c ON a.Uses_GEMS = c.Uses_GEMS""")
def gems_split_stats(spark, sf_dir):
    return stats.flag_split(enriched(spark, sf_dir), "Uses_GEMS")


def _side_mode(c: str, on: str) -> str:
    return f"(SELECT CAST({c} AS DOUBLE) FROM e WHERE {on} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(f"{SCORED} " + " UNION ALL ".join([f"SELECT '{c}_mode' AS metric, {_side_mode(c, 'Uses_GEMS')} AS with_flag, {_side_mode(c, 'NOT Uses_GEMS')} AS without_flag" for c in ("CON", "FL")] + [f"SELECT '{n}_mean' AS metric, round(avg({c}) FILTER (Uses_GEMS), 6) AS with_flag, round(avg({c}) FILTER (NOT Uses_GEMS), 6) AS without_flag FROM e" for n, c in (("brightness", "b"), ("complexity", "x"))]))
def flag_compare(spark, sf_dir):
    return stats.flag_compare(enriched(spark, sf_dir), "Uses_GEMS")


@query(f"{SCORED} SELECT Uses_GEMS, Game, n, CAST(rank AS INT) AS rank FROM (SELECT Uses_GEMS, Game, count(*) AS n, row_number() OVER (PARTITION BY Uses_GEMS ORDER BY count(*) DESC, Game) AS rank FROM e WHERE Game IS NOT NULL GROUP BY Uses_GEMS, Game) WHERE rank <= 15")
def flag_top_games(spark, sf_dir):
    return stats.top_games(enriched(spark, sf_dir), "Uses_GEMS")


@query(f"{views.WITH}, t AS (SELECT Game FROM v WHERE Game IS NOT NULL GROUP BY Game ORDER BY count(*) DESC, Game LIMIT 15) SELECT preset_id, Game FROM v WHERE Game IN (SELECT Game FROM t)")
def top_games_semi(spark, sf_dir):
    rows = views.presets(spark, sf_dir)
    return enrich.in_list(rows, stats.value_counts(rows, "Game").limit(15), "Game").select("preset_id", "Game")


@query(f"{views.WITH} SELECT preset_id, Game, Name FROM v WHERE NOT (coalesce(Game = 'Game 7', false) OR Name = 'Instrument 3')")
def others_anti(spark, sf_dir):
    rows = views.presets(spark, sf_dir)
    chosen = rows.where((F.col("Game") == "Game 7") | (F.col("Name") == "Instrument 3"))
    return enrich.not_in_list(rows, chosen, "preset_id").select("preset_id", "Game", "Name")


@query(f"{SCORED} SELECT * FROM f WHERE Game IS NOT NULL")
def first_non_null(spark, sf_dir):
    return enrich.first_non_null(views.composers(spark, sf_dir), "Game", "ord", ["Composer", "Nationality"])


@query(f"{views.WITH} SELECT preset_id, preset_id % 5 = 0 AS is_active FROM v")
def active_split(spark, sf_dir):
    rows = views.presets(spark, sf_dir).select("preset_id")
    return enrich.split_active(rows, rows.where("preset_id % 5 = 0"))


@query(f"""{SCORED}, q AS (SELECT lower(trim(Game)) || '||' || lower(trim(Name)) AS p, arg_min(b, preset_id) AS bb FROM (SELECT *, coalesce(Game, '') AS gg FROM s) WHERE Game IS NOT NULL GROUP BY 1)
SELECT preset_id, round(q.bb, 6) AS Brightness_Index FROM v LEFT JOIN q ON lower(trim(v.Game)) || '||' || lower(trim(v.Name)) = q.p WHERE v.Game IS NOT NULL""")
def key_alignment(spark, sf_dir):
    rows = views.presets(spark, sf_dir).where("Game IS NOT NULL")
    return enrich.align(rows.select("preset_id", "Game", "Name"), scored(spark, sf_dir).where("Game IS NOT NULL"), ["Brightness_Index"]).select("preset_id", "Brightness_Index")


@query(f"{SCORED} SELECT Game, round(avg(b), 6) AS brightness FROM s WHERE Game IS NOT NULL GROUP BY Game ORDER BY avg(b), Game LIMIT 10")
def least_bright(spark, sf_dir):
    means = scored(spark, sf_dir).where("Game IS NOT NULL").groupBy("Game").agg(F.avg("Brightness_Index").alias("brightness"))
    return means.orderBy("brightness", "Game").limit(10)


@query(f"{SCORED} SELECT * FROM (SELECT Composer, count(*) AS n FROM e WHERE Composer IS NOT NULL GROUP BY Composer ORDER BY n DESC, Composer LIMIT 10) ORDER BY n, Composer")
def top_k_two_stage(spark, sf_dir):
    return stats.value_counts(enriched(spark, sf_dir), "Composer").limit(10).orderBy("n", "Composer")


# ---------------------------------------------------------------- filters and look-ups

PANELS = {
    "none": filters.PresetFilter(),
    "cluster": filters.PresetFilter(clusters=(0, 3)),
    "game": filters.PresetFilter(game="Game 7"),
    "nationality": filters.PresetFilter(nationality="ASIA"),
    "gems": filters.PresetFilter(gems=True),
    "ranges": filters.PresetFilter(brightness=(0.4, 0.6), complexity=(0.5, 0.9)),
    "search": filters.PresetFilter(search="COMPOSER 1"),
    "all": filters.PresetFilter(clusters=(0, 1, 2, 3), gems=False, brightness=(0.3, 0.8), search="game"),
}
_PANEL_SQL = {
    "none": "true",
    "cluster": "k IN (0, 3)",
    "game": "Game = 'Game 7'",
    "nationality": "Nationality = 'ASIA'",
    "gems": "Uses_GEMS",
    "ranges": "b BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE AND x BETWEEN 0.5::DOUBLE AND 0.9::DOUBLE",
    "search": "(contains(lower(Name), 'composer 1') OR coalesce(contains(lower(Game), 'composer 1'), false) OR coalesce(contains(lower(Composer), 'composer 1'), false))",
    "all": "k IN (0, 1, 2, 3) AND NOT Uses_GEMS AND b BETWEEN 0.3::DOUBLE AND 0.8::DOUBLE AND (coalesce(contains(lower(Game), 'game'), false) OR coalesce(contains(lower(Composer), 'game'), false))",
}


@query(f"{SCORED} " + " UNION ALL ".join(f"SELECT '{n}' AS panel, preset_id FROM e WHERE {on} AND b BETWEEN 0 AND 1 AND x BETWEEN 0 AND 1" for n, on in _PANEL_SQL.items()))
def filter_panel(spark, sf_dir):
    rows = enriched(spark, sf_dir)
    hits = F.filter(F.array(*[F.when(p.predicate(), F.lit(n)) for n, p in PANELS.items()]), lambda x: x.isNotNull())
    return rows.select("preset_id", F.explode(hits).alias("panel"))


@query(f"{SCORED} SELECT DISTINCT Game FROM e WHERE contains(lower(Game), 'me 1') ORDER BY Game LIMIT 50")
def type_ahead(spark, sf_dir):
    return filters.type_ahead(enriched(spark, sf_dir).select("Game").distinct(), "Game", "ME 1")


@query(f"{views.WITH} SELECT * FROM (SELECT 'id' AS how, preset_id, Name, Game FROM v WHERE preset_id = (SELECT min(preset_id) + 4 FROM v) ORDER BY preset_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'name' AS how, preset_id, Name, Game FROM v WHERE Name = 'Instrument 3' AND Game = 'Game 7' ORDER BY preset_id LIMIT 1)")
def point_lookup(spark, sf_dir):
    rows = views.presets(spark, sf_dir).select("preset_id", "Name", "Game")
    one = rows.agg(F.min("preset_id")).first()[0]
    found = filters.point_lookup(rows, (one or 0) + 4).withColumn("how", F.lit("id"))
    return found.unionByName(filters.point_lookup(rows, None, "Instrument 3", "Game 7").withColumn("how", F.lit("name")))


@query(f"{views.WITH} SELECT preset_id, Name, Game FROM v WHERE regexp_matches(Name, '(?i)instrument 1.?$') AND coalesce(regexp_matches(Game, '(?i)GAME [12]$'), false)")
def name_search(spark, sf_dir):
    on = filters.matches("instrument 1.?$", "Name") & filters.matches("GAME [12]$", "Game")
    return views.presets(spark, sf_dir).where(on).select("preset_id", "Name", "Game")


@query(f"{views.WITH}, n AS (SELECT DISTINCT Game FROM v WHERE Game IS NOT NULL) SELECT Game, greatest((SELECT count(*) FROM n) - 20, 0) AS more FROM n ORDER BY Game LIMIT 20")
def names_and_more(spark, sf_dir):
    return filters.names_and_more(views.presets(spark, sf_dir), "Game")


def _compare_sql(side: str, on: str) -> str:
    mode = lambda c: f"(SELECT {c} FROM s WHERE {on} GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    return f"(SELECT count(*) FROM s WHERE {on}) AS {side}_presets, {mode('CON')} AS {side}_CON, {mode('FL')} AS {side}_FL, (SELECT round(avg(b), 6) FROM s WHERE {on}) AS {side}_brightness, (SELECT round(avg(x), 6) FROM s WHERE {on}) AS {side}_complexity"


@query(f"{SCORED} SELECT {_compare_sql('a', '''contains(lower(Game), 'game 1')''')}, {_compare_sql('b', '''contains(lower(Game), 'game 12')''')}")
def compare_two(spark, sf_dir):
    return stats.compare(scored(spark, sf_dir), filters.holds("Game 1", "Game"), filters.holds("Game 12", "Game"))


@query(f"{SCORED}, p AS (SELECT * FROM s WHERE Game = 'Game 7') SELECT count(*) AS presets, string_agg(DISTINCT CAST(CON AS VARCHAR), ',' ORDER BY CAST(CON AS VARCHAR)) AS algorithms, (SELECT CON FROM p GROUP BY CON ORDER BY count(*) DESC, CON LIMIT 1) AS CON_mode, (SELECT FL FROM p GROUP BY FL ORDER BY count(*) DESC, FL LIMIT 1) AS FL_mode, round(avg(b), 6) AS brightness_mean, round(avg(x), 6) AS complexity_mean FROM p")
def game_profile(spark, sf_dir):
    return stats.profile(scored(spark, sf_dir), F.col("Game") == "Game 7")


# ---------------------------------------------------------------- names, pages, texts

_TAGS = ["' (1994)'", "' (Unreleased)'", "' (Page 12) x'", "'  [b1] '", "' / Other Name'", "''"]
_VARIANTS = "VALUES " + ", ".join(f"({k}, {t})" for k, t in enumerate(_TAGS))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with tags behind them, as a listing might show."""
    tags = spark.sql(f"SELECT * FROM {_VARIANTS} AS t(tag, suffix)")
    return views.table(spark, sf_dir, "part").select("p_partkey", "p_name").crossJoin(F.broadcast(tags)).withColumn("raw", F.concat("p_name", "suffix"))


_NAMED = f"n AS (SELECT p_partkey, tag, p_name || suffix AS raw FROM part, ({_VARIANTS}) AS t(tag, suffix))"
_SQUASH = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(f"{views.WITH} SELECT preset_id, coalesce(replace(string_split(replace(Filename, '.opm', ''), '_-_')[1], '_', ' '), 'Unknown') AS game FROM v")
def game_name_extract(spark, sf_dir):
    return views.presets(spark, sf_dir).select("preset_id", naming.game_of_file(F.col("Filename")).alias("game"))


def _clean_sql() -> str:
    c = r"regexp_replace(regexp_replace(trim(raw), '\s*\(\d{4}\)\s*', ' ', 'g'), '\s*\((?:un)?released\)\s*', '', 'gi')"
    c = rf"regexp_replace(regexp_replace({c}, '\s*\([^)]*test\s*drive[^)]*\)\s*', '', 'gi'), '\s*\([^)]*page\s*\d+[^)]*\)\s*', '', 'gi')"
    bad = " OR ".join(f"contains(lower(c), '{x}')" for x in naming.NOT_GAMES)
    return f"WITH {_NAMED}, c AS (SELECT p_partkey, tag, length(trim(raw)) >= 3 AS ok, {_SQUASH.format(c)} AS c FROM n) SELECT p_partkey, tag, CASE WHEN ok AND length(c) >= 3 AND NOT ({bad}) THEN c END AS game FROM c"


@query(_clean_sql())
def clean_name(spark, sf_dir):
    return _named(spark, sf_dir).select("p_partkey", "tag", naming.clean_game(F.col("raw")).alias("game"))


@query(rf"WITH {_NAMED} SELECT p_partkey, tag, nullif({_SQUASH.format(chr(39).join(['regexp_replace(regexp_replace(trim(raw), ', chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')' + chr(92) + 's*$', ', ', '', '), ', chr(92) + 's*' + chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']' + chr(92) + 's*$', ', ', '', ')']))}, '') AS game FROM n")
def normalize_name(spark, sf_dir):
    return _named(spark, sf_dir).select("p_partkey", "tag", naming.normal_game(F.col("raw")).alias("game"))


@query(r"SELECT c_custkey, nullif(trim(regexp_replace(regexp_replace(t || c_name, '^\s*(?:Mr\.|Ms\.|Dr\.)\s+', '', 'i'), '\s+', ' ', 'g')), '') AS composer FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'mr.  ' WHEN 2 THEN 'Mr.' ELSE '' END AS t FROM customer)")
def normalize_composer(spark, sf_dir):
    titles = F.element_at(F.array(*[F.lit(x) for x in ("Dr. ", "mr.  ", "Mr.", "")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", naming.normal_composer(F.concat(titles, "c_name")).alias("composer"))


@query(rf"WITH {_NAMED}, c AS (SELECT p_partkey, tag, trim(regexp_replace(regexp_replace(trim(raw), '\s*\([^)]+\)\s*', ' ', 'g'), '\s*/\s*.*$', '')) AS c FROM n) SELECT p_partkey, tag, CASE WHEN length(c) >= 3 THEN c END AS game FROM c")
def pack_title(spark, sf_dir):
    return _named(spark, sf_dir).select("p_partkey", "tag", naming.pack_title(F.col("raw")).alias("game"))


_LINKS = r"list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')))"


@query(f"SELECT page_id, CAST(len({_LINKS}) AS INT) AS n, coalesce(array_to_string({_LINKS}, '|'), '') AS links FROM pages")
def html_links(spark, sf_dir):
    found = web.links(F.col("html"))
    return views.table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n"), F.array_join(found, "|").alias("links"))


@query(f"SELECT DISTINCT link FROM (SELECT unnest({_LINKS}) AS link FROM pages) WHERE link <> ''")
def html_links_distinct(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(F.explode(web.links(F.col("html"))).alias("link")).where("link <> ''").distinct().orderBy("link")


@query()
def html_game_list(spark, sf_dir):
    return web.games_of_pages(views.table(spark, sf_dir, "pages"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '<p>' || event_type || '</p>' ELSE event_type END AS html FROM events""")
def json_envelope(spark, sf_dir):
    text = F.col("event_type")
    inner = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("<p>"), text, F.lit("</p>")).alias("*")).alias("text")).alias("parse")))
    flat = F.to_json(F.struct(F.struct(text.alias("text")).alias("parse")))
    payload = F.when(F.col("event_id") % 2 == 0, inner).otherwise(flat)
    return views.table(spark, sf_dir, "events").select("event_id", web.envelope_html(payload).alias("html"))


def _nationality_sql(c: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({c}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in web.NATIONALITIES)
    return f"CASE {cases} ELSE 'Unknown' END"


@query(f"SELECT doc_id, {_nationality_sql('lower(coalesce(text, chr(32)))')} AS nationality FROM documents")
def keyword_classify(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", web.nationality_in(F.coalesce("text", F.lit(""))).alias("nationality"))


_CREDIT = "CASE doc_id % 4 WHEN 0 THEN ' music by Ada Byte' WHEN 1 THEN ' Ben Chord composed, soundtrack by Cy Drum' WHEN 2 THEN ' composed by Di Echo and music by Ed Fret' ELSE '' END"


_NAMED = ", ".join(f"nullif(regexp_extract(left(t, 3000), '{p}', 1), '')" for p in web.COMPOSER_PHRASES)
_MUSIC = " OR ".join(f"contains(lower(left(t, 2000)), '{w}')" for w in web.MUSIC_WORDS)


@query(f"SELECT doc_id, CASE WHEN {_MUSIC} THEN coalesce({_NAMED}) END AS composer FROM (SELECT doc_id, CASE {_CREDIT} WHEN '' THEN '' ELSE {_CREDIT} || ' ' END || coalesce(text, '') AS t FROM documents)")
def pattern_priority(spark, sf_dir):
    # the credit comes first, so that the document's whole text can follow it
    text = F.concat_ws(" ", F.nullif(F.expr(_CREDIT), F.lit("")), F.coalesce("text", F.lit("")))
    return views.table(spark, sf_dir, "documents").select("doc_id", web.composer_in(text).alias("composer"))


@query(f"{views.WITH} SELECT preset_id, Num, Name, {', '.join(FEATURES)}, Filename FROM v")
def opm_parse(spark, sf_dir):
    """Presets written as OPM files, one for each file name, and parsed again; ids are those of the written rows."""
    rows = views.presets(spark, sf_dir)
    files = opm.write_text(rows).select(F.lit(0).alias("file_no"), F.col("Filename").alias("path"), "content")
    place = F.row_number().over(Window.partitionBy("Filename").orderBy("preset_id")) - 1
    ids = rows.select(F.col("preset_id").alias("id"), "Filename", place.cast("long").alias("preset_id"))
    return opm.parse(files).join(ids, ["Filename", "preset_id"]).drop("preset_id").withColumnRenamed("id", "preset_id")


@query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in row) + ', ' + repr('Manual') + ')' for row in web.KNOWN_COMPOSERS if row[0] in ('Golden Axe', 'Comix Zone'))}) AS t(Game, Composer, Nationality, Source)")
def known_composers(spark, sf_dir):
    games = spark.createDataFrame([("Golden Axe",), ("Comix Zone",), ("Game 7",)], "Game string")
    return web.known_composers(spark, games)


# ---------------------------------------------------------------- vectors

_EMB = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT vec_id AS qid, e AS qe FROM v WHERE vec_id = (SELECT min(vec_id) FROM v))"
_POINTS = "p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "embeddings")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _vectors(spark, sf_dir).select("vec_id", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


def _first_id(rows: DataFrame, key: str) -> int:
    return rows.agg(F.min(key)).first()[0] or 0


@query(f"WITH {_EMB} SELECT vec_id, round(s, 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INT) AS rank FROM (SELECT vec_id, list_cosine_similarity(e, qe) AS s FROM v, q WHERE vec_id <> qid ORDER BY s DESC, vec_id LIMIT 10)")
def knn_cosine(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return nearest.cosine_neighbours(rows, "vec_id", "embedding", _first_id(rows, "vec_id"))


@query(f"WITH {_POINTS}, q AS (SELECT x AS qx, y AS qy, vec_id AS qid FROM p WHERE vec_id = (SELECT min(vec_id) FROM p)) SELECT vec_id, round(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 6) AS distance FROM p, q WHERE vec_id <> qid ORDER BY sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), vec_id LIMIT 10")
def knn_euclid2d(spark, sf_dir):
    rows = _points(spark, sf_dir)
    return nearest.plane_neighbours(rows, "vec_id", _first_id(rows, "vec_id"))


@query(f"WITH {_EMB}, a AS (SELECT x.vec_id AS query, y.vec_id AS neighbour, round(list_cosine_similarity(x.e, y.e), 12) AS s FROM v x, v y WHERE x.vec_id <> y.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM a) SELECT query, neighbour, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM n WHERE rank <= 10")
def knn_all_pairs(spark, sf_dir):
    return nearest.all_neighbours(_vectors(spark, sf_dir), "vec_id", "embedding")


_BOUNDS = "w AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM p)"
_MAP = f"{_POINTS}, {_BOUNDS}, m AS (SELECT vec_id, (x - (xl - (xh - xl) * 0.05::DOUBLE)) / ((xh + (xh - xl) * 0.05::DOUBLE) - (xl - (xh - xl) * 0.05::DOUBLE)) * 800 AS px, (y - (yl - (yh - yl) * 0.05::DOUBLE)) / ((yh + (yh - yl) * 0.05::DOUBLE) - (yl - (yh - yl) * 0.05::DOUBLE)) * 600 AS py FROM p, w)"


@query(f"WITH {_POINTS}, {_BOUNDS} SELECT round(xl - (xh - xl) * 0.05::DOUBLE, 6) AS x_min, round(xh + (xh - xl) * 0.05::DOUBLE, 6) AS x_max, round(yl - (yh - yl) * 0.05::DOUBLE, 6) AS y_min, round(yh + (yh - yl) * 0.05::DOUBLE, 6) AS y_max FROM w")
def map_bounds(spark, sf_dir):
    return display.padded_bounds(_points(spark, sf_dir))


@query(f"WITH {_MAP} SELECT vec_id, round(sqrt((px - 400) * (px - 400) + (py - 300) * (py - 300)), 6) AS distance FROM m WHERE sqrt((px - 400) * (px - 400) + (py - 300) * (py - 300)) < 60 ORDER BY sqrt((px - 400) * (px - 400) + (py - 300) * (py - 300)), vec_id LIMIT 1")
def radius_pick(spark, sf_dir):
    return nearest.pick(display.on_map(_points(spark, sf_dir), 800.0, 600.0), "vec_id", 400.0, 300.0, 60.0)


@query(f"WITH {_MAP} SELECT vec_id, round(px, 6) AS px, round(py, 6) AS py FROM m WHERE px BETWEEN -10 AND 410 AND py BETWEEN -10 AND 310")
def viewport(spark, sf_dir):
    return display.on_map(_points(spark, sf_dir), 800.0, 600.0).where(display.in_view(400.0, 300.0)).select("vec_id", "px", "py")


# ---------------------------------------------------------------- display values


def _case(values: dict, c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


@query(f"{SCORED}, c AS (SELECT preset_id, CASE WHEN preset_id % 11 = 0 THEN 4 ELSE k END AS id FROM e) SELECT preset_id, CAST(id AS INT) AS id, {_case(display.CLUSTERS, 'id')} AS name, {_case(display.CLUSTER_COLOURS, 'id')} AS colour FROM c")
def cluster_resolve(spark, sf_dir):
    name = F.when(F.col("preset_id") % 11 == 0, F.lit("Deep Space FM")).when(F.col("preset_id") % 13 == 0, F.lit("no such"))
    info = display.cluster_info(F.col("Cluster"), None, name)
    return enriched(spark, sf_dir).select("preset_id", info.alias("c")).select("preset_id", "c.*")


_FLAG_WORDS = [None, "", " ", "true", "0", "2", "YES", "n", "maybe", " Gems "]


@query("SELECT o_orderkey, CASE o_orderkey % 10 WHEN 3 THEN true WHEN 5 THEN true WHEN 6 THEN true WHEN 8 THEN true WHEN 9 THEN true ELSE false END AS gems FROM orders")
def gems_normalize(spark, sf_dir):
    words = F.array(*[F.lit(w).cast("string") for w in _FLAG_WORDS])
    return views.table(spark, sf_dir, "orders").select("o_orderkey", display.is_yes(F.get(words, (F.col("o_orderkey") % 10).cast("int"))).alias("gems"))


@query("SELECT l_returnflag, CAST(CASE WHEN count(*) > 0 THEN floor(count(*) FILTER (l_linestatus = 'F') * 100::DOUBLE / count(*) + 0.5) ELSE 0 END AS INT) AS percent FROM lineitem GROUP BY l_returnflag")
def percent_filtered(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("part"), F.count(F.lit(1)).alias("whole"))
    return rows.select("l_returnflag", display.percent(F.col("part"), F.col("whole")).alias("percent"))


# ---------------------------------------------------------------- patches, registers, notes


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir).select("preset_id", synth.patch_of_preset().alias("patch"))


@query(f"{SCORED} SELECT preset_id, Name AS name, Game || coalesce(' - ' || Composer, '') AS description, CON AS algorithm, FL AS feedback, LFRQ AS lfo, AMS AS ams, PMS AS fms, M1_TL AS tl1, C2_D1L AS sl4, M2_AMS_EN = 1 AS am3 FROM e")
def patch_struct(spark, sf_dir):
    p = F.col("patch")
    ops = p["operators"]
    return _patches(spark, sf_dir).select("preset_id", *[p[n].alias(n) for n in ("name", "description", "algorithm", "feedback", "lfo", "ams", "fms")], ops[0]["tl"].alias("tl1"), ops[3]["sl"].alias("sl4"), ops[2]["am"].alias("am3"))


_TABLE = {"ar": "AR", "dr": "D1R", "sr": "D2R", "rr": "RR", "sl": "D1L", "tl": "TL", "mul": "MUL", "dt": "DT1"}


@query(f"{views.WITH} " + " UNION ALL ".join(f"SELECT preset_id, '{n}' AS parameter, {', '.join(f'{s}_{c} AS op{k + 1}' for k, s in enumerate(SLOTS))} FROM v" for n, c in _TABLE.items()))
def patch_unpivot(spark, sf_dir):
    return synth.patch_table(_patches(spark, sf_dir), ["preset_id"])


def _hex(c: str) -> str:
    return f"printf('%02X', {c} & 255)"


_DMP_ORDER = ("MUL", "TL", "AR", "D1R", "D1L", "RR", "AMS_EN", "KS", "DT1", "D2R")


@query(f"{views.WITH} SELECT preset_id, '0B0201' || {' || '.join(_hex(c) for c in ('PMS', 'FL', 'CON', 'AMS'))} || {' || '.join(' || '.join(_hex(f'{s}_{c}') for c in _DMP_ORDER) + f' || {chr(39)}00{chr(39)}' for s in SLOTS)} AS bytes, true AS same FROM v")
def dmp_roundtrip(spark, sf_dir):
    rows = _patches(spark, sf_dir).select("preset_id", "patch", dmp.encoded().alias("content"))
    back = dmp.decoded(F.col("content"), F.lit("x.dmp"))
    same = F.to_json(back["operators"]) == F.to_json(F.col("patch")["operators"])
    return rows.select("preset_id", F.hex("content").alias("bytes"), (same & (back["algorithm"] == F.col("patch")["algorithm"])).alias("same"))


def _writes_sql() -> str:
    base = "CASE WHEN ch >= 3 THEN 256 ELSE 0 END + ch % 3"
    rows = [f"SELECT preset_id, ch, 0 AS n, {base} + 176 AS address, ((FL & 7) << 3) | (CON & 7) AS value FROM z", f"SELECT preset_id, ch, 1 AS n, {base} + 180 AS address, 192 | ((AMS & 3) << 4) | (PMS & 7) AS value FROM z"]
    for k, (s, off) in enumerate(zip(SLOTS, synth.OFFSETS, strict=True)):
        values = (f"(({s}_DT1 & 7) << 4) | ({s}_MUL & 15)", f"{s}_TL & 127", f"({s}_KS << 6) | ({s}_AR & 31)", f"{s}_AMS_EN * 128 | ({s}_D1R & 31)", f"{s}_D2R & 31", f"(({s}_D1L & 15) << 4) | ({s}_RR & 15)", "0")
        rows += [f"SELECT preset_id, ch, {2 + 7 * k + i} AS n, {base} + {off + 0x30 + 0x10 * i} AS address, {v} AS value FROM z" for i, v in enumerate(values)]
    return f"{views.WITH}, z AS (SELECT *, CAST(preset_id % 6 AS INT) AS ch FROM v) SELECT preset_id, ch, CAST(n AS INT) AS n, CAST(address AS INT) AS address, CAST(value AS INT) AS value FROM ({' UNION ALL '.join(rows)})"


@query(_writes_sql())
def register_writes(spark, sf_dir):
    rows = _patches(spark, sf_dir).withColumn("ch", (F.col("preset_id") % 6).cast("int"))
    return rows.select("preset_id", "ch", F.posexplode(synth.patch_writes(F.col("ch"))).alias("n", "w")).select("preset_id", "ch", "n", "w.*")


_NOTES = "n AS (SELECT DISTINCT CAST(event_id % 128 AS INT) AS note FROM events)"
_FNUM = f"""b AS (SELECT note, 440::DOUBLE * pow(2::DOUBLE, (note - 69) / 12::DOUBLE) * (1048576::DOUBLE * 144) / {synth.CLOCK} AS m, CAST(greatest(0, least(7, floor((note - 12) / 12::DOUBLE))) AS INT) AS first FROM n),
c AS (SELECT note, k AS block, CAST(floor(m / pow(2::DOUBLE, k - 1) + 0.5) AS INT) AS fnum FROM b, (SELECT unnest(range(8)) AS k) WHERE k >= first),
z AS (SELECT n.note, CAST(coalesce(min(block), 7) AS INT) AS block, coalesce(arg_min(fnum, block), 2047) AS fnum FROM n LEFT JOIN (SELECT * FROM c WHERE fnum <= 2047) c ON n.note = c.note GROUP BY n.note)"""


@query(f"WITH {_NOTES}, {_FNUM} SELECT note, block, fnum FROM z")
def note_fnum(spark, sf_dir):
    notes = views.table(spark, sf_dir, "events").select((F.col("event_id") % 128).cast("int").alias("note")).distinct()
    return notes.select("note", synth.frequency_number(F.col("note")).alias("f")).select("note", "f.*")


@query(f"WITH {_NOTES}, {_FNUM} SELECT note, CAST(4 AS INT) AS ch, 'A5' || printf('%02X', block << 3 | (fnum >> 8 & 7)) || 'A1' || printf('%02X', fnum & 255) || '28F5' AS writes FROM z")
def note_on_writes(spark, sf_dir):
    notes = views.table(spark, sf_dir, "events").select((F.col("event_id") % 128).cast("int").alias("note")).distinct()
    writes = F.transform(synth.note_on_writes(F.lit(4), F.col("note")), lambda w: F.format_string("%02X%02X", w["address"].bitwiseAND(255), w["value"]))
    return notes.select("note", F.lit(4).alias("ch"), F.array_join(writes, "").alias("writes"))


_PLAYED = "p AS (SELECT event_id AS seq, user_id % 7 AS session, CAST(event_id % 5 AS INT) + 60 AS note, event_id % 3 <> 0 AS is_on FROM events)"


def _played(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    return e.selectExpr("event_id AS seq", "user_id % 7 AS session", "CAST(event_id % 5 AS INT) + 60 AS note", "event_id % 3 <> 0 AS is_on")


@query(f"WITH {_PLAYED} SELECT seq, session, note, CAST((row_number() OVER (PARTITION BY session ORDER BY seq) - 1) % 6 AS INT) AS channel FROM p WHERE is_on")
def voice_round_robin(spark, sf_dir):
    return voices.round_robin(_played(spark, sf_dir).where("is_on").drop("is_on"), "session", "seq")


@query(f"""WITH {_PLAYED}, o AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY seq) - 1) % 6 AS channel FROM p WHERE is_on),
u AS (SELECT *, lead(seq) OVER (PARTITION BY session, channel ORDER BY seq) AS until FROM o),
f AS (SELECT u.session, u.channel, u.seq, min(q.seq) AS off_seq FROM u JOIN p q ON NOT q.is_on AND q.session = u.session AND q.note = u.note AND q.seq > u.seq AND (u.until IS NULL OR q.seq < u.until) GROUP BY ALL)
SELECT session, off_seq, CAST(channel AS INT) AS channel FROM f""")
def voice_releases(spark, sf_dir):
    rows = _played(spark, sf_dir)
    return voices.releases(rows.where("is_on").drop("is_on"), rows.where("NOT is_on").drop("is_on"))


@query(f"""WITH {_PLAYED}, o AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY seq) - 1) % 6 AS channel FROM p WHERE is_on),
u AS (SELECT *, lead(seq) OVER (PARTITION BY session, channel ORDER BY seq) AS until FROM o),
f AS (SELECT u.session, u.note, u.channel, u.seq, min(q.seq) AS off_seq FROM u JOIN p q ON NOT q.is_on AND q.session = u.session AND q.note = u.note AND q.seq > u.seq AND (u.until IS NULL OR q.seq < u.until) GROUP BY ALL)
SELECT session, seq, note, true AS is_on, CAST(channel AS INT) AS channel FROM o UNION ALL SELECT session, off_seq, note, false, CAST(channel AS INT) FROM f""")
def voice_stream(spark, sf_dir):
    """The events as a stream, with the state of each session, into files that executors write; the driver holds no rows."""
    source = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")
    played = events.selectExpr("event_id AS seq", "user_id % 7 AS session", "CAST(event_id % 5 AS INT) + 60 AS note", "event_id % 3 <> 0 AS is_on")
    rows, path = voices.stream_voices(played), files.scratch(spark, "voices")
    stream = rows.writeStream.format("parquet").option("checkpointLocation", files.scratch(spark, "voices-state")).outputMode("append").trigger(availableNow=True).start(path)
    stream.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query("""WITH p AS (SELECT p_partkey AS chip, CAST(p_partkey * 37 % 1024 AS INT) AS a, CAST(p_size AS INT) AS b, p_partkey % 3 = 0 AS csm FROM part)
SELECT chip, sample, 'A' AS timer, sample = 1024 - a AS flagged, csm AS key_on FROM (SELECT *, unnest(range(1024 - a, 9000, 1024 - a)) AS sample FROM p)
UNION ALL SELECT chip, sample, 'B', false, false FROM (SELECT *, unnest(range((256 - b) * 16, 9000, (256 - b) * 16)) AS sample FROM p)""")
def chip_timers(spark, sf_dir):
    """Both timers of a chip for each part from sample 0: A flags, B runs alone, every third chip is in CSM mode."""
    mode = F.lit(timers.LOAD_A | timers.LOAD_B | timers.ENABLE_A) + F.when(F.col("p_partkey") % 3 == 0, timers.CSM).otherwise(0)
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chip"), F.lit(0).alias("sample"), (F.col("p_partkey") * 37 % 1024).cast("int").alias("a"), F.col("p_size").cast("int").alias("b"), mode.alias("mode"))
    return timers.timer_events(rows, 9000)


@query(f"WITH {_PLAYED}, l AS (SELECT *, lag(is_on) OVER (PARTITION BY session, note ORDER BY seq) AS b FROM p) SELECT session, note AS key, seq FROM l WHERE is_on AND NOT coalesce(b, false)")
def key_presses(spark, sf_dir):
    rows = _played(spark, sf_dir).withColumnsRenamed({"note": "key", "is_on": "down"})
    return voices.presses(rows).select("session", "key", "seq")


@query("SELECT CAST(event_id % 6 AS INT) AS slot, arg_max(event_type, event_id) AS patch FROM events GROUP BY 1")
def slot_store(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select((F.col("event_id") % 6).cast("int").alias("slot"), F.col("event_id").alias("seq"), F.col("event_type").alias("patch"))
    return voices.last_slots(rows)


@query("SELECT c_custkey, CAST((greatest(0, least(7, c_custkey % 11 - 1)) + 1) * 12 + c_custkey % 13 AS INT) AS note FROM customer")
def midi_notes(spark, sf_dir):
    k = F.col("c_custkey")
    return views.table(spark, sf_dir, "customer").select("c_custkey", synth.midi_note(k % 11 - 1, k % 13).cast("int").alias("note"))


def _grey_sql() -> str:
    parts = [f"CAST(('0x' || substring(c, {k}, 2)) AS INT)" for k in (2, 4, 6)]
    grey = f"(({' + '.join(parts)}) / 3::DOUBLE)"
    mixed = ", ".join(f"CAST(floor({p} + ({grey} - {p}) * 0.7::DOUBLE + 0.5) AS INT)" for p in parts)
    return f"WITH n AS (SELECT n_nationkey, '#' || printf('%02x%02x%02x', n_nationkey * 10, n_nationkey * 7, 255 - n_nationkey * 9) AS c FROM nation) SELECT n_nationkey, c AS colour, '#' || printf('%02x%02x%02x', {mixed}) AS grey FROM n"


@query(_grey_sql())
def greyed_colours(spark, sf_dir):
    colour = F.format_string("#%02x%02x%02x", F.col("n_nationkey") * 10, F.col("n_nationkey") * 7, F.lit(255) - F.col("n_nationkey") * 9)
    return views.table(spark, sf_dir, "nation").select("n_nationkey", colour.alias("colour")).withColumn("grey", display.greyed(F.col("colour"), 0.7))


@query(f"{SCORED} SELECT preset_id, coalesce(Composer, 'Unknown') AS composer, coalesce(CASE Nationality WHEN 'Japan' THEN 'JP' WHEN 'USA' THEN 'US' WHEN 'UK' THEN 'UK' END, '??') AS flag, CASE WHEN Uses_GEMS THEN 'Yes' ELSE 'No' END AS gems FROM e")
def display_defaults(spark, sf_dir):
    return enriched(spark, sf_dir).select("preset_id", display.or_unknown(F.col("Composer")).alias("composer"), display.country_flag(F.col("Nationality")).alias("flag"), display.yes_no(F.col("Uses_GEMS")).alias("gems"))


@query("SELECT coalesce(a.n, b.n) AS n, a.name, b.brand FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS n, c_name AS name FROM customer) a FULL JOIN (SELECT row_number() OVER (ORDER BY p_partkey) AS n, p_brand AS brand FROM part) b ON a.n = b.n")
def positional_join(spark, sf_dir):
    """Two tables side by side by an explicit ordinal."""
    left = enrich.numbered(views.table(spark, sf_dir, "customer"), "c_custkey").select("n", F.col("c_name").alias("name"))
    right = enrich.numbered(views.table(spark, sf_dir, "part"), "p_partkey").select("n", F.col("p_brand").alias("brand"))
    return enrich.by_position([left, right], "n")


@query("SELECT name, count(*) AS n FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer) GROUP BY name")
def union_counts(spark, sf_dir):
    parts = [views.table(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))]
    return stats.value_counts(enrich.union_all(parts), "name")


@query(f"{views.WITH} SELECT Game, Composer, min(ord) AS first_seen FROM d WHERE Composer IS NOT NULL GROUP BY Game, Composer")
def pack_composers(spark, sf_dir):
    """Listing pages written from the composers, and read again: one page for each game."""
    rows = views.composers(spark, sf_dir).where("Composer IS NOT NULL")
    link = F.format_string('<a href="/packs/composer/%d">%s</a>', "ord", "Composer")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", link.alias("l")))), lambda x: x["l"]), " ")
    pages = rows.groupBy("Game").agg(body.alias("b"), F.min("ord").alias("page_id"))
    html = F.concat(F.lit("<h2>"), "Game", F.lit(" (W) / Other</h2>"), "b")
    found = web.pack_rows(web.packs(pages.select("page_id", html.alias("html"))))
    firsts = rows.groupBy("Game", "Composer").agg(F.min("ord").alias("first_seen"))
    return found.select("Game", "Composer").join(firsts, ["Game", "Composer"])


@query("SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE) / 4096, 6) AS gain, round(CAST(l_quantity AS DOUBLE) / 128 * 200 / 2, 6) AS height FROM lineitem")
def sample_scaling(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", synth.gain(q).alias("gain"), display.wave_height(q, 200.0).alias("height"))


# ---------------------------------------------------------------- learning

_SCALED = FEATURES


def _scaled_sql() -> str:
    cells = ", ".join(f"round(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () > 0 THEN stddev_pop({f}) OVER () ELSE 1 END, 6) + 0.0::DOUBLE AS {f}" for f in FEATURES)
    return f"{views.WITH} SELECT preset_id, {cells} FROM v"


@query(_scaled_sql())
def scaled_features(spark, sf_dir):
    rows = learning.scaled(views.presets(spark, sf_dir).select("preset_id", *FEATURES))
    return rows.select("preset_id", *[(F.round(F.col(f), 6) + 0.0).alias(f) for f in FEATURES])


@query(f"{views.WITH} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS std FROM v" for f in FEATURES))
def feature_moments(spark, sf_dir):
    return learning.moments(views.presets(spark, sf_dir), FEATURES)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.scaled(views.presets(spark, sf_dir).select("preset_id", *FEATURES))
    return learning.assembled(rows, FEATURES, "preset_id")


@query()
def pca_variance(spark, sf_dir):
    _, shares = learning.principal(_features(spark, sf_dir), 50)
    return learning.variance_table(spark, shares).withColumn("for_95", F.lit(learning.components_for(shares)))


@query()
def kmeans_clusters(spark, sf_dir):
    labelled, _ = learning.clusters(_features(spark, sf_dir))
    return labelled.groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def elbow_sweep(spark, sf_dir):
    found = learning.elbow(_features(spark, sf_dir), range(2, 16))
    rows = found.orderBy("k").collect()
    return found.withColumn("knee", F.lit(learning.knee([r["k"] for r in rows], [r["inertia"] for r in rows])))


@query()
def embed_2d(spark, sf_dir):
    return learning.plane(_features(spark, sf_dir), "preset_id")
