"""Local session for tests, checks and benchmarks; on a cluster use the session you are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .core import plain_unions


def local_session(name: str, cores: int | str = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(name)
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return plain_unions(spark)
