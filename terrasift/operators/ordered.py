"""Ordered scans that stay correct and balanced when one key holds a large share of the rows.

``lag`` or a running sum over ``partitionBy(key)`` sorts all rows of a key in one task. That is the
best plan while every key is small, and it stalls the job when one key holds a third of the table.
:func:`choose_block` looks at the key counts of the source once (a column-pruned count that combines
before its shuffle) and says which plan to use:

* ``None``: no key is larger than ``HOT_ROWS``; plain windows, one shuffle.
* a block size: the order column is cut into blocks. Windows run inside ``(key, block)``; a summary of
  one row per block carries last rows, first rows and totals across block borders. The input is first
  written to shared storage, so nested scans stay linear and a lost executor costs one block only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK_ROWS = 1 << 18
HOT_ROWS = 4_000_000


def choose_block(source: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS, block: int = BLOCK_ROWS) -> int | None:
    """``None`` when every key has at most ``limit`` rows, else the block size to scan with."""
    hot = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    return None if hot.isEmpty() else block


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    lags: dict[str, str] | None = None,
    leads: dict[str, str] | None = None,
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Add previous values, next values, inclusive running sums and running maxima per key.

    ``order`` is an integer column, unique inside a key, so a block holds at most ``block`` rows.
    ``lags``/``leads`` map an output name to a column, ``sums``/``maxes`` an output name to an expression.
    """
    lags, leads, sums, maxes = lags or {}, leads or {}, sums or {}, maxes or {}
    keys = list(keys)
    if block is None:
        w = W.partitionBy(*keys).orderBy(order)
        run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.select(
            "*",
            *[F.lag(c).over(w).alias(n) for n, c in lags.items()],
            *[F.lead(c).over(w).alias(n) for n, c in leads.items()],
            *[F.sum(e).over(run).alias(n) for n, e in sums.items()],
            *[F.max(e).over(run).alias(n) for n, e in maxes.items()],
        )
    blk = "__block"
    w = W.partitionBy(*keys, blk).orderBy(order)
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    base = df.withColumn(blk, F.floor(F.col(order) / block).cast("bigint"))
    for name, expr in {**sums, **maxes}.items():
        base = base.withColumn("__v_" + name, expr)
    base = cut_lineage(base, "scan")
    inner = base.select(
        "*",
        *[F.lag(c).over(w).alias("__lag_" + n) for n, c in lags.items()],
        *[F.lead(c).over(w).alias("__lead_" + n) for n, c in leads.items()],
        *[F.sum("__v_" + n).over(run).alias("__run_" + n) for n in sums],
        *[F.max("__v_" + n).over(run).alias("__run_" + n) for n in maxes],
        F.row_number().over(w).alias("__rn"),
        *([F.lead(order).over(w).isNull().alias("__end")] if leads else []),
    )
    aggs = [F.count(F.lit(1)).alias("__rows")]
    if lags:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in lags.items()]), F.col(order)).alias("__last"))
    if leads:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in leads.items()]), F.col(order)).alias("__first"))
    aggs += [F.sum("__v_" + n).alias("__tot_" + n) for n in sums]
    aggs += [F.max("__v_" + n).alias("__tot_" + n) for n in maxes]
    sw = W.partitionBy(*keys).orderBy(blk)
    before = sw.rowsBetween(W.unboundedPreceding, -1)
    carry = base.groupBy(*keys, blk).agg(*aggs).select(
        *keys,
        blk,
        *([F.lag("__last").over(sw).alias("__prev")] if lags else []),
        *([F.lead("__first").over(sw).alias("__next")] if leads else []),
        *[F.sum("__tot_" + n).over(before).alias("__off_" + n) for n in sums],
        *[F.max("__tot_" + n).over(before).alias("__off_" + n) for n in maxes],
    )
    joined = inner.join(carry, [*keys, blk])
    out = [F.col(c) for c in df.columns]
    for n in lags:
        out.append(F.when(F.col("__rn") == 1, F.col("__prev")[n]).otherwise(F.col("__lag_" + n)).alias(n))
    for n in leads:
        out.append(F.when(F.col("__end"), F.col("__next")[n]).otherwise(F.col("__lead_" + n)).alias(n))
    for n in sums:
        out.append(F.coalesce(F.col("__run_" + n) + F.col("__off_" + n), F.col("__run_" + n), F.col("__off_" + n)).alias(n))
    for n in maxes:
        out.append(F.greatest(F.col("__run_" + n), F.col("__off_" + n)).alias(n))
    return joined.select(*out)


def with_previous(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], block: int | None = None) -> DataFrame:
    """Previous row's ``cols`` as ``prev_<col>``."""
    return ordered_scan(df, keys, order, lags={f"prev_{c}": c for c in cols}, block=block)
