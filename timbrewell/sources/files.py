"""CSV, Parquet and JSON in and out, cached steps and inventories."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed when the driver ends. A local session without one gets a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="timbrewell-")
        spark.sparkContext.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/timbrewell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Without a word if there is nothing."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, by an explicit schema."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").csv(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", "true").csv(path)


def fingerprint(df: DataFrame, **parameters: object) -> str:
    """Of the rows (in any order), the columns and parameters: changes whenever a step's input does."""
    one = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), *df.columns))).first()
    return hashlib.sha256(repr((tuple(one), df.dtypes, sorted(parameters.items()))).encode()).hexdigest()[:20]


def cached(df: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, **parameters: object) -> DataFrame:
    """step(df), kept as Parquet by the fingerprint of its input, so stale results are never taken."""
    spark = df.sparkSession
    at = f"{path}/{fingerprint(df, **parameters)}"
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        step(df).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_features(spark: SparkSession, path: str, features: list[str], method: str) -> None:
    """The list of features and the name of the method, as small files."""
    spark.createDataFrame([(json.dumps(features),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/feature_columns")
    spark.createDataFrame([(method,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/embedding_method")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """place and feature of a written list, and the name of the method."""
    names = spark.read.text(f"{path}/feature_columns").select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "feature"))
    return names, spark.read.text(f"{path}/embedding_method").first()["value"]


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def save_matrix(rows: DataFrame, path: str, key: str, vector: str) -> None:
    """A matrix beside its model: key and values of each row, a vector or an array, as Parquet ordered by key."""
    values = F.col(vector)
    if rows.schema[vector].dataType.typeName() != "array":
        values = vector_to_array(values)
    rows.select(F.col(key).alias("key"), values.cast("array<double>").alias("values")).repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sample_rows(df: DataFrame, key: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """n rows (or all) chosen by a hash of the key: the same ones each time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with their sizes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), "length").orderBy("file")


def embedding_export(rows: DataFrame) -> DataFrame:
    """The columns of the map that are published, in order."""
    return rows.select("embed_x", "embed_y", "Name", "Game", "CON", "FL", "Brightness_Index", "Complexity_Score", "Composer", "Nationality", "Cluster")
