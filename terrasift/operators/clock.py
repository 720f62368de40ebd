"""Clock-scale bounds over all ordered pairs of a track, without listing the pairs.

The largest (dy - e)/dx over pairs is found by Dinkelbach's method: for a trial slope ``s`` the best
pair maximises (dy - e) - s*dx, which needs only a running minimum of y - s*x; the slope of that pair
is the next trial. The trials rise strictly and end at the exact maximum after a few rounds. The
smallest (dy + e)/dx is the same search on mirrored y.

Pairs must respect the recorded order as well as increasing x. A track whose x never falls satisfies
both with one pass. Other tracks are split by the highest differing bit of the record positions, which
puts every ordered pair into exactly one (level, group) with its earlier point on the left.

Tracks of up to ``TASK_ROWS`` points are dealt whole to tasks, which go through all trials of many tracks
at once in arrays: one shuffle, whatever the number of rounds. A longer track is spread over tasks, with
one Spark job a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .ordered import ordered_scan, with_previous

BLOCKS = 16
TASK_ROWS = 1 << 17
ANY_PAIR = -1e18  # a trial that any pair beats


def _in_order(track: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Rows (side, track, x, l_min, l_max, r_min, r_max) by side and x, from points by track and record position.

    A side is a (track, level, group): pairs are of one side, the left point at a smaller x. Sides without one are left out.
    """
    first = np.flatnonzero(np.r_[True, track[1:] != track[:-1]])
    pos = np.arange(len(track)) - np.repeat(first, np.diff(np.r_[first, len(track)])) + 1
    down = (x[1:] < x[:-1]) & (pos[1:] > 1)
    falls = np.zeros(track[-1] + 1, bool)
    falls[track[1:][down]] = True
    at = np.flatnonzero(~falls[track])
    parts = [(track[at], np.full(len(at), -1), np.zeros(len(at), np.int64), at, np.ones(len(at), bool), np.ones(len(at), bool))]
    at, level = np.flatnonzero(falls[track]), 0
    last = np.zeros(len(falls), np.int64)
    np.maximum.at(last, track, pos)
    while len(at):
        half = pos[at] >> level
        right = half % 2 == 1
        parts.append((track[at], np.full(len(at), level), half >> 1, at, ~right, right))
        level += 1
        at = at[last[track[at]] >> level > 0]
    t, lvl, grp, at, left, right = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((x[at], grp, lvl, t))
    t, lvl, grp, at, left, right = (c[order] for c in (t, lvl, grp, at, left, right))
    new = np.r_[True, (t[1:] != t[:-1]) | (lvl[1:] != lvl[:-1]) | (grp[1:] != grp[:-1])]
    side, y, x = np.cumsum(new) - 1, y[at], x[at]
    one = np.flatnonzero(new | np.r_[True, x[1:] != x[:-1]])  # a row a side and x
    low = [np.minimum.reduceat(np.where(has, y, np.inf), one) for has in (left, right)]
    high = [np.maximum.reduceat(np.where(has, y, -np.inf), one) for has in (left, right)]
    side = side[one]
    many = (np.bincount(side) > 1)[side]
    return [c[many] for c in (side, t[one], x[one], low[0], high[0], low[1], high[1])]


def _steepest(n: int, side: np.ndarray, track: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, error: float, start: float) -> np.ndarray:
    """Largest slope of each of ``n`` tracks, at least ``start``; rows without a left or right point hold an infinite one."""
    s = np.full(n, start)
    while len(side):
        place = np.cumsum(np.r_[0, side[1:] != side[:-1]])
        g = left - s[track] * x
        order = np.argsort(g, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        later = (place[-1] - place) * len(order)  # ranks of a side lie below those of all sides before it
        least = np.minimum.accumulate(rank + later)
        row = np.flatnonzero(np.r_[False, place[1:] == place[:-1]])
        by = order[least[row - 1] - later[row]]
        fine = np.isfinite(g[by]) & np.isfinite(right[row])
        row, by = row[fine], by[fine]
        if not len(row):
            break
        gap = (right[row] - s[track[row]] * x[row]) - g[by] - error
        slope = (right[row] - left[by] - error) / (x[row] - x[by])
        of = np.flatnonzero(np.r_[True, track[row[1:]] != track[row[:-1]]])
        best = np.maximum.reduceat(gap, of)
        hit = np.flatnonzero(gap == np.repeat(best, np.diff(np.r_[of, len(row)])))
        hit = hit[np.unique(track[row[hit]], return_index=True)[1]]
        mine = track[row[hit]]
        rises = (gap[hit] > 0) & (slope[hit] > s[mine])
        s[mine[rises]] = slope[hit][rises]
        still = np.isin(track, mine[rises])
        side, track, x, left, right = side[still], track[still], x[still], left[still], right[still]
    return s


def _in_tasks(points: DataFrame, key: str, order: str, error: float) -> DataFrame:
    """(key, lower, u) of whole tracks; a task holds a batch of them and the track that goes on."""
    schema = T.StructType([points.schema[key]] + [T.StructField(c, T.DoubleType()) for c in ("lower", "u")])

    def solve(b: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        track = np.repeat(np.arange(len(first)), np.diff(np.r_[first, b.num_rows]))
        side, t, x, l_min, l_max, r_min, r_max = _in_order(track, b["x"].to_numpy(), b["y"].to_numpy())
        low = _steepest(len(first), side, t, x, l_min, r_max, error, 0.0)
        # min (dy + e)/dx = -max (-dy - e)/dx
        high = _steepest(len(first), side, t, x, -l_max, -r_min, error, ANY_PAIR)
        return pa.RecordBatch.from_arrays([b[key].take(pa.array(first)).combine_chunks(), pa.array(low), pa.array(high)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the track that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            b = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = b[key]
            first = np.r_[0, np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy()) + 1]
            if len(first) > 1:
                yield solve(b.slice(0, first[-1]), first[:-1])
            held = b.slice(first[-1]).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held), np.zeros(1, np.int64))

    return points.repartition(key).sortWithinPartitions(key, order).select(key, "x", "y").mapInArrow(run, schema)


def _sides(p: DataFrame, key: str, order: str, block: int | None) -> DataFrame:
    prev = with_previous(p, [key], order, ["x"], block)
    kind = prev.groupBy(key).agg(F.bool_or(F.coalesce(F.col("x") < F.col("prev_x"), F.lit(False))).alias("__falls"))
    p = p.join(kind, key)
    level = "bigint"
    plain = p.where("not __falls").select(
        key, F.lit(-1).cast(level).alias("lvl"), F.lit(0).cast(level).alias("grp"), "x", F.col("y").alias("yl"), F.col("y").alias("yr"))
    pos = ordered_scan(p.where("__falls"), [key], order, sums={"pos": F.lit(1).cast("bigint")}, block=block)
    top = pos.groupBy(key).agg(F.max("pos").alias("__top"))
    pos = pos.join(top, key)
    lv = F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("__top").cast("double"))).cast("int")))
    split = pos.withColumn("l", lv).withColumn("half", F.expr("shiftright(pos, l)"))
    right = F.col("half") % 2 == 1
    split = split.select(
        key, F.col("l").cast(level).alias("lvl"), F.floor(F.col("half") / 2).cast(level).alias("grp"), "x",
        F.when(~right, F.col("y")).alias("yl"), F.when(right, F.col("y")).alias("yr"))
    both = plain.unionByName(split)
    agg = both.groupBy(key, "lvl", "grp", "x").agg(
        F.min("yl").alias("l_min"), F.max("yl").alias("l_max"), F.min("yr").alias("r_min"), F.max("yr").alias("r_max"))
    cuts = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    heads = agg.groupBy(key, "lvl", "grp").agg(F.percentile_approx("x", cuts, F.lit(1000)).alias("__cuts"))
    b = agg.join(heads, [key, "lvl", "grp"])  # the caller writes this once, so the cuts are the same for every reader
    return b.withColumn("blk", F.size(F.filter("__cuts", lambda c: c <= F.col("x")))).drop("__cuts")


def _best(sides: DataFrame, trial: DataFrame, key: str, left: str, right: str, error: float) -> DataFrame:
    """Per track, the pair maximising (yr - yl - e) - s*(xr - xl); columns gap and slope."""
    d = sides.join(trial, key)
    g = F.when(F.col(left).isNotNull(), F.struct((F.col(left) - F.col("s") * F.col("x")).alias("g"), F.col("x").alias("x"), F.col(left).alias("y")))
    d = d.withColumn("__g", g)
    keys = [key, "lvl", "grp"]
    inner = d.withColumn("__in", F.min("__g").over(W.partitionBy(*keys, "blk").orderBy("x").rowsBetween(W.unboundedPreceding, -1)))
    blocks = d.groupBy(*keys, "blk").agg(F.min("__g").alias("__bm"))
    carry = blocks.withColumn("__before", F.min("__bm").over(W.partitionBy(*keys).orderBy("blk").rowsBetween(W.unboundedPreceding, -1))).drop("__bm")
    j = inner.join(carry, [*keys, "blk"]).withColumn("__m", F.least("__in", "__before")).where(F.col("__m").isNotNull() & F.col(right).isNotNull())
    gap = (F.col(right) - F.col("s") * F.col("x")) - F.col("__m.g") - error
    slope = (F.col(right) - F.col("__m.y") - error) / (F.col("x") - F.col("__m.x"))
    return j.select(key, gap.alias("gap"), slope.alias("slope")).groupBy(key).agg(F.max("gap").alias("gap"), F.max_by("slope", "gap").alias("slope"))


def _search(sides: DataFrame, key: str, left: str, right: str, error: float, start: float, max_rounds: int = 60) -> DataFrame:
    """Largest slope per track, or NULL when a track has no pair."""
    trial = cut_lineage(sides.select(key).distinct().withColumn("s", F.lit(start)).withColumn("open", F.lit(True)), "clock")
    for _ in range(max_rounds):
        best = _best(sides, trial.where("open").select(key, "s"), key, left, right, error)
        nxt = trial.join(best, key, "left")
        rises = F.col("open") & F.col("gap").isNotNull() & (F.col("gap") > 0) & (F.col("slope") > F.col("s"))
        trial = cut_lineage(
            nxt.select(key, F.when(rises, F.col("slope")).otherwise(F.col("s")).alias("s"), F.coalesce(rises, F.lit(False)).alias("open")), "clock")
        if trial.where("open").isEmpty():
            return trial.select(key, "s")
    raise RuntimeError("clock search did not settle")


def _in_rounds(points: DataFrame, key: str, order: str, error: float, block: int | None) -> DataFrame:
    """(key, lower, u) of tracks that are too long for a task."""
    sides = cut_lineage(_sides(points, key, order, block), "clock-sides")
    low = _search(sides, key, "l_min", "r_max", error, 0.0).withColumnRenamed("s", "lower")
    mirror = sides.select(key, "lvl", "grp", "x", "blk", (-F.col("l_max")).alias("ml"), (-F.col("r_min")).alias("mr"))
    # min (dy + e)/dx = -max (-dy - e)/dx
    high = _search(mirror, key, "ml", "mr", error, ANY_PAIR).withColumnRenamed("s", "u")
    return low.join(high, key).select(key, "lower", "u")


def scale_bounds(points: DataFrame, key: str, x: str, y: str, error: float, order: str = "seq", block: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    p = points.select(key, order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col(key).isNotNull())
    p = p.where(~F.isnan("x") & ~F.isnan("y") & (F.abs("x") != float("inf")) & (F.abs("y") != float("inf")))
    p = cut_lineage(p, "clock-points")
    long = p.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > task_rows).select(key)
    if long.isEmpty():
        out = _in_tasks(p, key, order, error)
    else:
        long = cut_lineage(long, "clock-long")
        out = _in_tasks(p.join(long, key, "left_anti"), key, order, error).unionByName(
            _in_rounds(cut_lineage(p.join(long, key, "left_semi"), "clock-long-points"), key, order, error, block))
    upper = F.when(F.col("u") > ANY_PAIR, -F.col("u"))
    return out.select(key, "lower", upper.alias("upper"), (F.col("lower") <= F.coalesce(upper, F.lit(float("inf")))).alias("compatible"))
