"""A session with the settings the engine is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, **settings: str) -> SparkSession:
    """A single-machine session, for tests and benchmarks."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | settings
    spark = SparkSession.builder.master(f"local[{cores}]").appName("quarry").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
