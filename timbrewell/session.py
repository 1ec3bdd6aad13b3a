"""Spark session used by tests, the bench and scripts."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "timbrewell") -> SparkSession:
    """Local session with adaptive execution; on a cluster use the cluster's own session instead."""
    root = str(Path(__file__).resolve().parents[1])
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:  # local workers import this package wherever the driver was started
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
