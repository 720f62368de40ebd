"""Sinks: zone reports, prepared tables, content-addressed publishing and version chains."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..session import fan_out
from .readers import fingerprint


def zone_features(zones: DataFrame, x0: float, y0: float) -> DataFrame:
    """One GeoJSON feature text per zone card."""
    ring = F.transform(geo.zone_ring("zone_id", F.lit(x0), F.lit(y0)), lambda p: F.array(p["lon"], p["lat"]))
    props = F.struct(*[F.col(c) for c in zones.columns])
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return zones.select("mission_id", "rank", F.to_json(feature).alias("value"))


def write_zones_geojson(zones: DataFrame, path: str, x0: float, y0: float) -> None:
    """GeoJSON text sequence: one feature per line in rank order, one folder per mission."""
    f = zone_features(zones, x0, y0)
    f.repartition("mission_id").sortWithinPartitions("mission_id", "rank").select("mission_id", "value").write.partitionBy("mission_id").mode("errorifexists").text(path)


def write_zones_csv(zones: DataFrame, path: str) -> None:
    z = zones.select(
        "mission_id", F.col("label").alias("zone"), F.col("poa").alias("POA"), F.col("pod_low").alias("POD_low_assumption"), F.col("pod_high").alias("POD_high_assumption"), F.col("pos").alias("POS"), "access", "rank")
    z.repartition("mission_id").sortWithinPartitions("mission_id", "rank").drop("rank").write.partitionBy("mission_id").option("header", "true").mode("errorifexists").csv(path)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as tasks can open it, where ``path`` is in a mounted file system, and NULL in any other store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(p):
        raise FileExistsError(path)
    return files.makeQualified(p).toUri().getPath() if files.getUri().getScheme() == "file" else None


_ESCAPED = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def _key_folder(key: str, value: str | None) -> str:
    """The name that Spark gives the folder of a key."""
    text = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"
    return f"{key}={text}"


def _put_files(root: str, key: str, run: str):
    """Writer of sorted (key, value) rows into a file a key; a file appears whole, and a task that runs again replaces it."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part-{TaskContext.get().partitionId():05d}-{run}.txt"
        attempt = f".{part}-{uuid.uuid4().hex}"
        now, out, n = None, None, 0

        def close():
            if out is not None:
                out.close()
                os.replace(out.name, os.path.join(os.path.dirname(out.name), part))

        for b in batches:
            if not len(b):
                continue
            keys, lines = b.column(0), pc.binary_join_element_wise(b.column(1), "", "\n", null_handling="replace", null_replacement="")
            at, text = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset :], memoryview(lines.buffers()[2])
            ends = pc.run_end_encode(keys)
            start = 0
            for value, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist()):
                if out is None or value != now:
                    close()
                    folder = os.path.join(root, _key_folder(key, value))
                    os.makedirs(folder, exist_ok=True)
                    now, out, n = value, open(os.path.join(folder, attempt), "wb"), n + 1
                out.write(text[at[start] : at[end]])
                start = end
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return put


def write_files(lines: DataFrame, path: str, key: str, order: str | None = None) -> None:
    """One text file for each key, of its ``value`` lines, in ``order`` where given.

    Small files cost by number and not by size, so keys are dealt over the session's shuffle partitions
    whatever their bytes. In a mounted file system tasks create the files themselves (Hadoop's local writer
    starts several processes a file to set its mode); elsewhere Spark writes them and tasks, not the driver
    one by one, put them into place. The layout is the same.
    """
    # dealt by a hash column: where the lines are a union of rows already dealt by the key, Spark leaves out
    # a shuffle by the key itself, and a join below that turns into a broadcast one then spreads a key's rows
    rows = fan_out(lines.withColumn("__deal", F.xxhash64(key)), "__deal")
    rows = rows if order is None else rows.sortWithinPartitions(key, order)
    root = _local_folder(lines.sparkSession, path)
    if root is None:
        rows.select(key, "value").write.partitionBy(key).option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("errorifexists").text(path)
        return
    rows = rows if order is not None else rows.sortWithinPartitions(key)
    done = rows.select(F.col(key).cast("string"), "value").mapInArrow(_put_files(root, key, uuid.uuid4().hex), "files bigint")
    done.agg(F.sum("files")).collect()


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A derived table; non-finite numbers become missing values."""
    cols = [F.when(F.isnan(f.name) | (F.abs(F.col(f.name)) == float("inf")), None).otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema]
    w = df.select(*cols).write.mode("errorifexists")
    w.option("header", "true").csv(path) if fmt == "csv" else w.parquet(path)


def content_digest(df: DataFrame, name: str = "digest") -> DataFrame:
    """One SHA-256 for a table's content, whatever the order and layout of its rows.

    Row hashes fall into 65,536 groups by prefix. A group folds its rows into exact sums of four hash
    words, which combine before the shuffle; the groups' lines, at most 65,536, are hashed in order.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    word = lambda i: F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")
    h = df.select(row.alias("h")).withColumn("b", F.substring("h", 1, 4))
    g = h.groupBy("b").agg(F.count(F.lit(1)).alias("n"), *[F.sum(word(i)).alias(f"w{i}") for i in range(4)])
    line = F.concat_ws(":", "b", "n", "w0", "w1", "w2", "w3")
    return g.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias(name))


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a table under the digest of its content and point ``name`` at it; published bytes never change.

    The table is staged first, the digest taken from the stored copy, and the folder moved into place in one
    step. A folder without ``_SUCCESS`` is a broken write and is not taken for a published one.
    """
    spark = df.sparkSession
    home = f"{root.rstrip('/')}/{name}"
    staged = f"{home}/_staging-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staged)
    digest = content_digest(spark.read.schema(df.schema).parquet(staged)).first()[0]
    target = f"{home}/digest={digest}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(f"{target}/_SUCCESS")):
        files.delete(path(staged), True)
    else:
        if files.exists(path(target)):
            files.delete(path(target), True)
        if not files.rename(path(staged), path(target)):
            raise OSError(f"cannot move {staged} to {target}")
    pointer = spark.createDataFrame([(name, digest)], "name string, digest string").withColumn("at", F.current_timestamp())
    pointer.write.mode("append").parquet(f"{root.rstrip('/')}/_pointers")
    return digest


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table the newest pointer of ``name`` names."""
    p = spark.read.parquet(f"{root.rstrip('/')}/_pointers").where(F.col("name") == name)
    digest = p.agg(F.max_by("digest", "at")).first()[0]
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/digest={digest}")


def receipt_hash(cols: Sequence[str]) -> Column:
    """SHA-256 of a row's canonical JSON (fields in name order, missing values kept)."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def append_version(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New version rows chained to the latest version of their mission.

    ``new`` has one row per mission: mission_id, event, evidence, created_at.
    """
    last = versions.groupBy("mission_id").agg(F.max("number").alias("__n"), F.max_by("hash", "number").alias("__h"))
    r = new.join(last, "mission_id", "left").select(
        "mission_id", F.coalesce(F.col("__n") + 1, F.lit(0)).cast("bigint").alias("number"), F.coalesce("__h", F.lit("genesis")).alias("parent_hash"), "event", "evidence", "created_at")
    return r.withColumn("hash", receipt_hash(r.columns))


def manifest(spark: SparkSession, path: str, name: str = r"([^/]+)$") -> DataFrame:
    """Name, SHA-256 and size of every file of an output folder; ``name`` says which part of a path names the file."""
    f = fingerprint(spark, path)
    return f.select(F.regexp_extract("path", name, 1).alias("name"), "sha256", "bytes")


def write_manifest(spark: SparkSession, path: str, out: str, name: str = r"([^/]+)$") -> None:
    """The manifest of a folder as JSON lines in another one, which is then its record."""
    manifest(spark, path, name).write.mode("errorifexists").json(out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("name string, sha256 string, bytes bigint").json(out)
