"""Exposure of weighted paths to planned sweeps, without a shuffled row per plan and path.

A path is one row with all its positions. Paths are dealt to (mission, bucket) groups whose
number follows from the positions of the mission, and each group gets the mission's effort
table, which is as large as its plans. A group adds up its own paths' efforts, so what it
returns is final and only sums by plan are left to do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grid as G
from ..session import cut_lineage

POSITIONS = 40_000  # of paths in one group
CHUNK = 400_000  # of (position, plan) pairs added up at once
_CELLS = 20  # bits of a cell number


def regular_frame(mid: Column | str, step: float) -> Column:
    """Nearest frame of a regular time axis starting at zero; ties go to the earlier frame."""
    m = F.col(mid) if isinstance(mid, str) else mid
    return F.ceil(m / step - 0.5).cast("bigint")


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` numbers from ``first``: the range of every number, and the number."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _meet(paths: pa.Table, effort: pa.Table, names: list[str], schema: pa.Schema) -> pa.Table:
    """Rows (path, plan) of one group that share a cell at a frame, with the effort met."""
    flat = paths.column("at").combine_chunks()
    length = flat.value_lengths().to_numpy()
    at = flat.flatten()
    frame, left, right = (at.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("frame_idx", "left_cell", "right_cell"))
    share = at.field("fraction").to_numpy(zero_copy_only=False)
    path = np.repeat(np.arange(len(length)), length)
    path, cell = np.r_[path, path], np.r_[frame << _CELLS | left, frame << _CELLS | right]
    share = np.r_[1 - share, share]
    plans, plan = np.unique(effort.column("plan_id").to_numpy(), return_inverse=True)
    key = effort.column("frame_idx").to_numpy() << _CELLS | effort.column("cell").to_numpy()
    order = np.argsort(key, kind="stable")
    key, plan, amount = key[order], plan[order], effort.column("effort").to_numpy()[order]
    order = np.argsort(path, kind="stable")
    path, cell, share = path[order], cell[order], share[order]
    first = np.searchsorted(key, cell)
    count = np.searchsorted(key, cell, "right") - first
    found_path, found_plan, found = [], [], []
    begin = 0
    ends = np.flatnonzero(np.r_[path[1:] != path[:-1], True]) + 1 if len(path) else np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(count)]
    while begin < len(path):  # whole paths, at most CHUNK pairs or one path
        k = int(np.searchsorted(total[ends], total[begin] + CHUNK, "right"))
        k = max(k, int(np.searchsorted(ends, begin, "right")) + 1)
        stop = int(ends[k - 1])
        of, row = _ranges(first[begin:stop], count[begin:stop])
        low = path[begin]
        slot = (path[begin:stop][of] - low) * len(plans) + plan[row]
        size = (path[stop - 1] - low + 1) * len(plans)
        met = np.flatnonzero(np.bincount(slot, minlength=size))
        found.append(np.bincount(slot, share[begin:stop][of] * amount[row], size)[met])
        found_path.append(low + met // len(plans))
        found_plan.append(met % len(plans))
        begin = stop
    row = pa.array(np.concatenate(found_path) if found else np.zeros(0, np.int64))
    keep = paths.select(names).take(row)
    columns = {c: keep.column(c) for c in names}
    columns["plan_id"] = pa.array(plans[np.concatenate(found_plan)] if found else np.zeros(0, np.int64))
    columns["effort"] = pa.array(np.concatenate(found) if found else np.zeros(0))
    return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema)


def exposure(paths: DataFrame, steps: DataFrame, scale: Column | float = 1.0, step_s: float = 15.0, assigned: DataFrame | None = None) -> DataFrame:
    """Effort each weighted path meets on each plan: mission_id, plan_id, scenario, path_id, weight, old, effort.

    ``steps`` lists the walked edges of a plan with the cells swept at both ends (``cells_a``,
    ``cells_b``). Half an edge's effort falls on each end, at the frame nearest its midpoint time.
    A step past the last frame of its mission meets the last frame. ``old`` is the effort that
    ``assigned`` (mission_id, scenario, path_id, effort) already holds for the path, else 0.
    """
    keys = ["mission_id", "scenario", "path_id"]
    packed = paths.groupBy(*keys).agg(
        F.max("weight").alias("weight"), F.collect_list(F.struct(F.col("frame_idx").cast("bigint").alias("frame_idx"), F.col("left_cell").cast("bigint").alias("left_cell"), F.col("right_cell").cast("bigint").alias("right_cell"), F.col("fraction").cast("double").alias("fraction"))).alias("at"))
    if assigned is None:
        packed = packed.withColumn("old", F.lit(0.0))
    else:
        packed = packed.join(assigned.select(*keys, F.col("effort").alias("old")), keys, "left").fillna(0.0, ["old"])
    packed = cut_lineage(packed, "packed-paths")
    span = F.aggregate("at", F.lit(-1).cast("bigint"), lambda top, p: F.greatest(top, p["frame_idx"]))
    missions = cut_lineage(packed.groupBy("mission_id").agg(F.ceil(F.sum(F.size("at")) / POSITIONS).cast("bigint").alias("__n"), F.max(span).alias("__last")), "missions")
    sc = scale if isinstance(scale, Column) else F.lit(scale)
    frame = regular_frame((F.col("arrive_s") + F.col("leave_s")) / 2, step_s)
    e = steps.join(missions, "mission_id").select(
        "mission_id", "plan_id", F.least(frame, F.col("__last")).alias("frame_idx"), "__n", F.explode(F.concat("cells_a", "cells_b")).alias("cell"), (sc / (2 * G.CELL)).alias("unit"))
    e = e.where(F.col("cell") >= 0).groupBy("mission_id", "plan_id", "frame_idx", "cell", "__n").agg(F.sum("unit").alias("effort"))
    e = e.withColumn("__bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
    e = e.select(F.col("mission_id").alias("__mission"), F.col("__bucket").alias("__share"), F.col("plan_id").cast("bigint").alias("plan_id"), "frame_idx", F.col("cell").cast("bigint").alias("cell"), "effort")
    dealt = packed.join(missions.drop("__last"), "mission_id").withColumn("__bucket", F.pmod(F.xxhash64("scenario", "path_id"), F.col("__n"))).drop("__n")
    kept = ["mission_id", "scenario", "path_id", "weight", "old"]
    schema = T.StructType([dealt.schema["mission_id"], T.StructField("plan_id", T.LongType()), *(dealt.schema[c] for c in kept[1:]), T.StructField("effort", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet(left, right, kept, arrow)

    return dealt.groupBy("mission_id", "__bucket").cogroup(e.groupBy("__mission", "__share")).applyInArrow(run, schema)
