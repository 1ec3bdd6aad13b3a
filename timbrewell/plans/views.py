"""Preset-shaped views of the driver's tables, by integer arithmetic that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timbrewell.schema import FEATURES, HIGHEST, LEVELS


def _base(feature: str) -> str:
    return "o_orderkey" if feature in LEVELS else "(o_orderkey % 40)"


_META = """o_orderkey AS preset_id, CAST(o_orderkey % 16 AS INT) AS Num, concat('Instrument ', CAST(o_orderkey % 16 AS {text})) AS Name,
 CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE concat('Game ', CAST(o_custkey % 60 AS {text})) END AS Game,
 concat('Game_', CAST(o_custkey % 60 AS {text}), '_-_Track_', CAST(o_orderkey % 9 AS {text}), '.opm') AS Filename"""


def presets_sql(text: str = "STRING") -> str:
    cells = ", ".join(f"CAST(({_base(f)} * {2 * j + 3} + {j}) % {HIGHEST[f] + 1} AS INT) AS {f}" for j, f in enumerate(FEATURES))
    return f"SELECT {_META.format(text=text)}, {cells} FROM orders"


def raw_sql(text: str = "STRING") -> str:
    cells = []
    for j, f in enumerate(FEATURES):
        value = f"CAST(({_base(f)} * {2 * j + 3} + {j}) % {HIGHEST[f] + 4} AS INT) - 1"
        cells.append(f"{f'CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE {value} END' if j % 7 == 0 else value} AS {f}")
    return f"SELECT {_META.format(text=text)}, {', '.join(cells)} FROM orders"


def composers_sql(text: str = "STRING") -> str:
    return f"""SELECT c_custkey AS ord, concat('Game ', CAST(c_custkey % 60 AS {text})) AS Game,
 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('Composer ', CAST(c_custkey % 13 AS {text})) END AS Composer, r_name AS Nationality
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 60 < 45"""


def tools_sql(text: str = "STRING") -> str:
    return f"SELECT DISTINCT concat('Game ', CAST(s_suppkey % 60 AS {text})) AS Game FROM supplier WHERE s_suppkey % 4 = 0"


#: DuckDB common table expressions v, r, d and g.
WITH = f"WITH v AS ({presets_sql('VARCHAR')}), r AS ({raw_sql('VARCHAR')}), d AS ({composers_sql('VARCHAR')}), g AS ({tools_sql('VARCHAR')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql.replace("FROM orders", "FROM {orders}").replace("FROM supplier", "FROM {supplier}").replace("FROM customer JOIN nation ", "FROM {customer} JOIN {nation} ").replace("JOIN region ", "JOIN {region} "), **{t: table(spark, sf_dir, t) for t in tables})


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, presets_sql(), "orders")


def raw_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, raw_sql(), "orders")


def composers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, composers_sql(), "customer", "nation", "region")


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, tools_sql(), "supplier")
