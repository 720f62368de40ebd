"""Table profiles and exact order statistics that no single task has to hold.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here
values are first counted (which combines before the shuffle), the distinct values of all keys are
dealt by range in the order (key, value), as many ranges as the data needs, and ranks are counted
range by range with one row per key and range carried over. The ranges only balance the work; the
answers are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

RANK_BLOCK = 1 << 19  # distinct values of one block, on average
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _ranked(counts: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Distinct values with the number of rows up to and including each, and the group total."""
    counts = cut_lineage(counts, "counts")
    heads = counts.groupBy(*keys).agg(F.sum("n").alias("__total"), *extra)
    ranges = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // RANK_BLOCK))
    b = counts.repartitionByRange(ranges, *keys, value).withColumn("__blk", F.spark_partition_id())
    b = cut_lineage(b, "ranks")  # the range of a value, fixed for every reader
    run = W.partitionBy(*keys, "__blk").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    inner = b.withColumn("__cum", F.sum("n").over(run))
    sw = W.partitionBy(*keys).orderBy("__blk").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    off = b.groupBy(*keys, "__blk").agg(F.sum("n").alias("__bn")).withColumn("__off", F.coalesce(F.sum("__bn").over(sw), F.lit(0))).drop("__bn")
    off = off.join(heads, list(keys))
    return inner.join(off, [*keys, "__blk"]).withColumn("__cum", F.col("__cum") + F.col("__off")).drop("__off", "__blk")


def _pick(value: str, p: float) -> Column:
    """Linear interpolation between the two ranks around p * (n - 1)."""
    total = F.max("__total")
    pos = F.lit(p) * (F.col("__total") - 1)
    lo = F.min(F.when(F.col("__cum") > F.floor(pos), F.col(value)))
    hi = F.min(F.when(F.col("__cum") > F.ceil(pos), F.col(value)))
    frac = F.lit(p) * (total - 1) - F.floor(F.lit(p) * (total - 1))
    return lo + (hi - lo) * frac


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    """Exact interpolated percentiles of a column per key."""
    v = df.where(finite(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__val"))
    ks = list(keys) or ["__one"]
    if not keys:
        v = v.withColumn("__one", F.lit(1))
    r = _ranked(v.groupBy(*ks, "__val").agg(F.count(F.lit(1)).alias("n")), ks, "__val")
    out = r.groupBy(*ks).agg(*[_pick("__val", p).alias(n) for n, p in wanted.items()])
    return out if keys else out.drop("__one")


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    return df.select(F.inline(F.array(*cells)))


def numeric_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of statistics per numeric column; non-finite and missing values are counted apart."""
    counts = _long(df, cols).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    ok = finite(F.col("v"))
    whole = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.sum(F.when(~ok, F.col("n")).otherwise(0)).alias("nonfinite"),
        F.count_if(ok).alias("unique_finite"), F.sum(F.when(ok & (F.col("v") == 0), F.col("n")).otherwise(0)).alias("zero"),
        F.sum(F.when(ok & (F.col("v") < 0), F.col("n")).otherwise(0)).alias("negative"),
    )
    r = _ranked(counts.where(ok), ["column"], "v", extra=[(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("__mean")])
    var = F.sum(F.col("n") * F.pow(F.col("v") - F.col("__mean"), 2)) / F.max("__total")
    nums = r.groupBy("column").agg(
        F.min("v").alias("min"), F.max("v").alias("max"), F.max("__mean").alias("mean"), F.sqrt(var).alias("population_std"),
        *[_pick("v", p).alias(n) for n, p in PERCENTILES.items()])
    return whole.join(nums, "column", "left")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, distinct and, for numbers, a description.

    The whole table is read once into (column, value) counts; everything else comes from those.
    """
    cells, types = [], {}
    for at, f in enumerate(df.schema):
        types[at] = (f.name, f.dataType.simpleString())
        whole, real = isinstance(f.dataType, _WHOLE), isinstance(f.dataType, _REAL)
        cells.append(F.struct(
            F.lit(at).alias("at"), (F.col(f.name) if whole else F.lit(None)).cast("bigint").alias("k"),
            (F.col(f.name) if real else F.lit(None)).cast("double").alias("d"), (F.lit(None) if whole or real else F.col(f.name)).cast("string").alias("s")))
    counts = df.select(F.inline(F.array(*cells))).groupBy("at", "k", "d", "s").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts, "profile").withColumn("v", F.coalesce(F.col("k").cast("double"), F.col("d")))
    missing = F.col("k").isNull() & F.col("d").isNull() & F.col("s").isNull()
    base = counts.groupBy("at").agg(
        F.sum("n").alias("rows"), F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("nulls"), F.count_if(~missing).alias("distinct"))
    r = _ranked(counts.where(finite(F.col("v"))).select("at", "v", "n"), ["at"], "v", extra=[(F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("__mean")])
    total = F.max("__total")
    var = F.try_divide(F.sum(F.col("n") * F.pow(F.col("v") - F.col("__mean"), 2)), (total - 1).cast("double"))
    want = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    nums = r.groupBy("at").agg(
        F.max("__mean").alias("mean"), F.sqrt(var).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), *[_pick("v", p).alias(n) for n, p in want.items()])
    name, kind = (F.element_at(F.array(*[F.lit(t[i]) for t in types.values()]), F.col("at") + 1) for i in (0, 1))
    return base.join(nums, "at", "left").select(name.alias("column"), kind.alias("dtype"), "*").drop("at")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row (over all or some columns)."""
    g = df.groupBy(*(cols or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
