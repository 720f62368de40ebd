"""Which rows lie within a distance of some row of a group, without listing close pairs.

Two incidents in one hot spot must not produce a pair per combination. Rows are first reduced to
occupied cells. A pair of cells whose farthest points are within the radius settles all its rows at
once; a pair whose nearest points are beyond it is dropped; only the thin ring in between is cut into
finer cells. A pair of cells with few places in it is compared place by place, so cells are cut as long as
some pair holds many and what is listed grows with the rows and not with their square.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import grid as G
from ..session import cut_lineage

FEW = 256  # pairs of places that a pair of cells is compared by
M_PER_DEG = math.radians(1) * G.EARTH_M


def near_any(
    left: DataFrame, right: DataFrame, left_id: str, group: str, dims: Sequence[tuple[str, str]], radius_m: float, few: int = FEW
) -> DataFrame:
    """Distinct (left_id, group) such that, for one row of the group, every place pair in ``dims`` is within ``radius_m``.

    ``dims`` names (lat, lon) columns present on both sides.
    """
    cols = int(360 / (radius_m / M_PER_DEG))
    base = 360.0 / cols
    names = [n for i, _ in enumerate(dims) for n in (f"r{i}", f"c{i}")]

    def cells(df: DataFrame, level: int, keep: Sequence[str]) -> DataFrame:
        size = base / 2**level
        out = [F.col(k) for k in keep]
        for i, (lat, lon) in enumerate(dims):
            out.append(F.floor((F.col(lat) + 90) / size).cast("bigint").alias(f"r{i}"))
            out.append(F.pmod(F.floor((F.col(lon) + 180) / size), F.lit(cols * 2**level)).cast("bigint").alias(f"c{i}"))
        return df.select(*out)

    def spread(level: int, i: int) -> tuple[Column, Column]:
        """Bounds on the distance between any two points of the paired cells."""
        size = base / 2**level
        mid = lambda c, o: (F.col(c) + 0.5) * size - o
        d = geo.haversine(mid(f"r{i}", 90), mid(f"c{i}", 180), mid(f"q_r{i}", 90), mid(f"q_c{i}", 180))
        slack = M_PER_DEG * size * math.sqrt(2) * 1.001
        return d - slack, d + slack

    spots = [c for d in dims for c in d]
    owners = cut_lineage(left.select(left_id, *spots).dropna(), "near-left")
    lp = cut_lineage(owners.select(*spots).distinct(), "near-places")  # equal places are compared once
    rp = cut_lineage(right.select(group, *spots).dropna().distinct(), "near-right")
    q = lambda df: df.select(group, *[F.col(n).alias("q_" + n) for n in names])

    a0 = cells(lp, 0, []).distinct()
    lat_edge = F.least(F.abs((F.col("r0") + 1) * base - 90), F.lit(89.9))
    lat_edge = F.least(F.greatest(lat_edge, F.abs(F.col("r0") * base - 90)), F.lit(89.9))
    k = F.least(F.ceil(F.lit(1.0) / F.cos(F.radians(lat_edge))) + 1, F.lit(cols // 2)).cast("int")
    near = a0.withColumn("dr", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("dc", F.explode(F.sequence(-k, k)))
    near = near.withColumn("q_r0", F.col("r0") + F.col("dr")).withColumn("q_c0", F.pmod(F.col("c0") + F.col("dc"), F.lit(cols)).cast("bigint"))
    pairs = near.drop("dr", "dc").join(q(cells(rp, 0, [group]).distinct()), ["q_r0", "q_c0"]).distinct()

    def exact(open_: DataFrame, level: int) -> DataFrame:
        lid = cells(lp, level, spots)
        rid = cells(rp, level, [group, *spots]).select(group, *[F.col(s).alias("q_" + s) for s in spots], *[F.col(n).alias("q_" + n) for n in names])
        ok = F.lit(True)
        for lat, lon in dims:
            ok = ok & (geo.haversine(F.col(lat), F.col(lon), F.col("q_" + lat), F.col("q_" + lon)) <= radius_m)
        return open_.join(lid, names).join(rid, [group, *["q_" + n for n in names]]).where(ok).select(group, *spots).distinct()

    parts, level = [], 0
    while True:
        lows, highs = zip(*[spread(level, i) for i in range(len(dims))])
        sure = highs[0] <= radius_m
        never = lows[0] > radius_m
        for lo, hi in zip(lows[1:], highs[1:]):
            sure, never = sure & (hi <= radius_m), never | (lo > radius_m)
        state = cut_lineage(pairs.withColumn("sure", sure).where(~never), "near-cells")
        hit = state.where("sure").select(group, *names).distinct()
        n_left = cells(lp, level, []).groupBy(*names).agg(F.count(F.lit(1)).alias("__l"))
        n_right = q(cells(rp, level, [group])).groupBy(group, *["q_" + n for n in names]).agg(F.count(F.lit(1)).alias("__r"))
        open_ = state.where("not sure").drop("sure").join(hit, [group, *names], "left_anti").join(n_left, names).join(n_right, [group, *["q_" + n for n in names]])
        open_ = cut_lineage(open_.select(group, *names, *["q_" + n for n in names], (F.col("__l") * F.col("__r") <= few).alias("few")), "near-open")
        settled = cells(lp, level, spots).join(hit, names).select(group, *spots)
        parts.append(cut_lineage(settled.unionByName(exact(open_.where("few"), level)), "near-found"))
        many = open_.where("not few")
        if many.isEmpty():
            break
        up = lambda df, prefix: [F.floor(F.col(n) / 2).cast("bigint").alias(prefix + n) for n in names]
        fine_l = cells(lp, level + 1, []).distinct()
        fine_l = fine_l.select(*up(fine_l, "up_"), *names)
        fine_r = cells(rp, level + 1, [group]).distinct()
        fine_r = fine_r.select(group, *[F.floor(F.col(n) / 2).cast("bigint").alias("up_q_" + n) for n in names], *[F.col(n).alias("q_" + n) for n in names])
        old = many.select(group, *[F.col(n).alias("up_" + n) for n in names], *[F.col("q_" + n).alias("up_q_" + n) for n in names])
        pairs = old.join(fine_l, ["up_" + n for n in names]).join(fine_r, [group, *["up_q_" + n for n in names]]).select(
            group, *names, *["q_" + n for n in names])
        level += 1
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return owners.join(found, spots).select(left_id, group).distinct()
