"""Session helpers: a local builder for tests and benches, and shared-storage paths."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}  # by application: step folders of sessions on one machine


def local_session(cpus: int | str = "*", app: str = "terrasift") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared checkpoint root that the cluster names.

    ``spark.checkpoint.dir`` names it. A session of one machine (local[n]: tests and the bench)
    may go without; on a cluster a folder of one machine would lose steps, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL_ROOTS.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        _LOCAL_ROOTS[context.applicationId] = root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread small rows over the session's shuffle partitions before each becomes thousands of rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def cut_lineage(df: DataFrame, purpose: str = "step") -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    The copy survives the loss of executors, so iterative operators restart from
    the last step and not from the source tables.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
