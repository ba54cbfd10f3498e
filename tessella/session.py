"""Session settings the engine expects, for entry points that build their own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on local[cores]; a cluster passes its own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tessella")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    builder = builder.config("spark.executorEnv.PYTHONPATH", root)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
