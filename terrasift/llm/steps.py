"""Steps on shared storage, and reading of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def step(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once below spark.checkpoint.dir and read back: a lost executor repeats one step only.

    The step's shuffle files go when it has been written; nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(_CLEAN, "false")
    try:
        spark.conf.set(_CLEAN, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame) -> int:
    """Partitions for an exchange that AQE cannot size (range partitioning): the session's number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
