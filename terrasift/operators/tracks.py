"""Track operators: edges, flags, sessions, resampling, labels and audits, for all tracks at once."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, movement, textfn
from ..functions import grid as G
from ..functions.geo import floor_long
from ..session import cut_lineage
from .ordered import ordered_scan, with_previous


def consecutive(fixes: DataFrame, key: str = "track_id", order: str = "seq", block: int | None = None) -> DataFrame:
    """Edges between consecutive fixes: dt, dist, speed and grade; the first fix of a track has none.

    Division by zero gives NULL.
    """
    prev = with_previous(fixes, [key], order, ["t_s", "lat", "lon", "elev", "x_m", "y_m", order], block)
    prev = prev.where(F.col(f"prev_{order}").isNotNull())
    prev = prev.withColumn("dt", F.col("t_s") - F.col("prev_t_s")).withColumn("dist", geo.haversine("prev_lat", "prev_lon", "lat", "lon"))
    speed = F.try_divide(F.col("dist"), F.col("dt").cast("double"))
    grade = F.try_divide((F.col("elev") - F.col("prev_elev")).cast("double"), F.col("dist"))
    out = prev.withColumn("speed", speed).withColumn("grade", grade)
    return out.withColumn("quality_flag", segment_flag("dt", "dist", "speed"))


def segment_flag(dt, dist, speed) -> Column:
    """First matching quality flag; rows are flagged, never dropped."""
    dt, dist, speed = (F.col(c) if isinstance(c, str) else c for c in (dt, dist, speed))
    return (
        F.when(dt <= 0, "NONINCREASING_TIME")
        .when(dt > 120, "GAP_OVER_120S")
        .when(dist > 250, "JUMP_OVER_250M")
        .when(speed > 3, "SPEED_OVER_3MPS")
        .when(speed.isNull() | F.isnan(speed) | (F.abs(speed) == float("inf")), "NONFINITE_SPEED")
        .otherwise("CANDIDATE")
    )


def ordinal(df: DataFrame, key: str, order: str, name: str = "ordinal", block: int | None = None) -> DataFrame:
    """One-based position inside a group."""
    return ordered_scan(df, [key], order, sums={name: F.lit(1).cast("bigint")}, block=block)


def admit_edges(edges: DataFrame) -> DataFrame:
    """Planar length and admission status of each sweep edge: admitted, gap or excluded."""
    length = F.hypot((F.col("x_m") - F.col("prev_x_m")).cast("double"), (F.col("y_m") - F.col("prev_y_m")).cast("double"))
    v = F.try_divide(F.col("length"), F.col("dt").cast("double"))
    status = F.when(F.col("dt") > 120, "gap").when(
        v.isNull() | (v < 0.08) | (v > 3) | (F.col("length") > 250), "excluded"
    ).otherwise("admitted")
    return edges.withColumn("length", length).withColumn("status", status)


def exclusion_reasons(links: DataFrame) -> DataFrame:
    """Endpoint links with every reason that keeps them out of the fit.

    A link is one path of two vertices; ``n_paths`` and ``n_vertices`` count what was delivered.
    """
    counts = links.groupBy("case_a").agg(F.count(F.lit(1)).alias("__n"))
    xs = [F.col(c) for c in ("lon_a", "lat_a", "lon_b", "lat_b")]

    def bad(c):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    broken = bad(xs[0]) | bad(xs[1]) | bad(xs[2]) | bad(xs[3])
    outside = (F.abs(xs[0]) > 180) | (F.abs(xs[1]) > 90) | (F.abs(xs[2]) > 180) | (F.abs(xs[3]) > 90)
    errs = [F.col("err_a"), F.col("err_b")]
    wrong = bad(errs[0]) | bad(errs[1]) | (errs[0] <= 0) | (errs[1] <= 0)
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("case_a").eqNullSafe(F.col("case_b")), "CROSS_CASE_JOIN"),
            F.when(F.col("__n") != 1, "MULTIPLE_ENDPOINTS_UNRESOLVED"),
            F.when((F.col("type_a") != "IPP") | (F.col("type_b") != "Found"), "NON_PRIMARY_ENDPOINT"),
            F.when(broken | outside, "INVALID_COORDINATE"),
            F.when(wrong, "INVALID_UNCERTAINTY"),
            F.when(~(broken | outside) & (geo.haversine("lat_a", "lon_a", "lat_b", "lon_b") <= 0), "ZERO_DISTANCE"),
            F.when(~(F.col("n_paths").eqNullSafe(F.lit(1)) & F.col("n_vertices").eqNullSafe(F.lit(2))), "UNEXPECTED_GEOMETRY"),
        )
    )
    return links.join(counts, "case_a").withColumn("reasons", reasons).drop("__n")


def label_points(points: DataFrame, labels: DataFrame, key: str = "track_id", bucket: int = 900) -> DataFrame:
    """Label every point covered by exactly one closed interval of any mode, when that mode is walk.

    Both sides carry a time bucket, so a long track spreads over many join keys. The grouping keys
    contain the join keys, so counting the hits of a point needs no second shuffle.
    """
    p = points.withColumn("__b", floor_long(F.col("t_s") / bucket))
    lab = labels.select(
        key, F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("mode").alias("__m"),
        F.explode(F.sequence(floor_long(F.col("start") / bucket), floor_long(F.col("end") / bucket))).alias("__b"),
    )
    hit = F.col("t_s").between(F.col("__s"), F.col("__e"))
    per = p.join(lab, [key, "__b"], "left").groupBy(*points.columns, "__b").agg(
        F.count_if(hit).alias("__n"), F.max(F.when(hit, F.col("__m"))).alias("__mode"), F.max(F.when(hit, F.col("__s"))).alias("__start"))
    one = (F.col("__n") == 1) & (F.col("__mode") == "walk")
    return per.select(*points.columns, F.when(one, F.col("__start")).alias("label_start"))


def connected(points: DataFrame, key: str = "track_id", order: str = "seq", block: int | None = None) -> DataFrame:
    """Add ``linked``: whether a point continues its predecessor's walk."""
    prev = with_previous(points, [key], order, ["t_s", "lat", "lon", "label_start"], block)
    d = geo.displacement("prev_lat", "prev_lon", "lat", "lon")
    step = F.hypot(F.col("__d.dx"), F.col("__d.dy"))
    dt = F.col("t_s") - F.col("prev_t_s")

    def ok(lat, lon, lab):
        return F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180) & F.col(lab).isNotNull()

    link = (
        ok("lat", "lon", "label_start") & ok("prev_lat", "prev_lon", "prev_label_start")
        & (F.col("label_start") == F.col("prev_label_start")) & (dt > 0) & (dt <= 15) & (step <= 4.0 * dt)
    )
    return prev.withColumn("__d", d).withColumn("linked", F.coalesce(link, F.lit(False))).drop("__d")


def sessionize(points: DataFrame, key: str = "track_id", order: str = "seq", min_points: int = 3, min_seconds: int = 60, block: int | None = None) -> DataFrame:
    """Continuous segments: a new one starts wherever a point is not linked to its predecessor."""
    c = connected(points, key, order, block)
    s = ordered_scan(c, [key], order, sums={"segment": (~F.col("linked")).cast("bigint")}, block=block)

    def wanted(n, first, last, ok):
        return (n >= min_points) & (last - first >= min_seconds) & ok

    labelled = F.col("label_start").isNotNull()
    if block is None:
        w = W.partitionBy(key, "segment")
        ok = wanted(F.count(F.lit(1)).over(w), F.min("t_s").over(w), F.max("t_s").over(w), F.bool_and(labelled).over(w))
        return s.withColumn("__keep", ok).where("__keep").drop("__keep")
    s = cut_lineage(s, "segments")
    size = s.groupBy(key, "segment").agg(
        F.count(F.lit(1)).alias("__n"), F.min("t_s").alias("__a"), F.max("t_s").alias("__z"), F.bool_and(labelled).alias("__ok"))
    keep = size.where(wanted(F.col("__n"), F.col("__a"), F.col("__z"), F.col("__ok"))).select(key, "segment")
    return s.join(keep, [key, "segment"], "left_semi")


def resample(segments: DataFrame, step: int = 30, key: str = "track_id") -> DataFrame:
    """Positions on the aligned time grid, linearly interpolated, longitude unwrapped.

    Each edge emits the grid times in (t0, t1]; a segment's first point emits its own time when aligned.
    """
    t0, t1 = F.col("prev_t_s"), F.col("t_s")
    lo = F.when(F.col("linked"), (floor_long(t0 / step) + 1) * step).otherwise(F.ceil(t1 / step).cast("bigint") * step)
    hi = floor_long(t1 / step) * step
    grid = F.when(lo <= hi, F.sequence(lo, hi, F.lit(step).cast("bigint")))
    g = segments.withColumn("grid_t", F.explode(grid))
    a = F.when(F.col("linked"), (F.col("grid_t") - t0) / (t1 - t0)).otherwise(F.lit(1.0))
    plat = F.when(F.col("linked"), F.col("prev_lat")).otherwise(F.col("lat"))
    plon = F.when(F.col("linked"), F.col("prev_lon")).otherwise(F.col("lon"))
    return g.select(
        *[c for c in ("person",) if c in segments.columns], key, "segment", "grid_t",
        (plat + a * (F.col("lat") - plat)).alias("lat"),
        (plon + a * geo.wrap_degrees(F.col("lon") - plon)).alias("lon"),
    )


def samples(grid: DataFrame, step: int = 30, key: str = "track_id", block: int | None = None) -> DataFrame:
    """Previous and next step vectors at every inner grid time of a segment."""
    ident = [c for c in ("person",) if c in grid.columns] + [key, "segment"]
    j = ordered_scan(
        grid, [key, "segment"], "grid_t", lags={"lat0": "lat", "lon0": "lon"}, leads={"lat2": "lat", "lon2": "lon"}, block=block)
    j = j.where(F.col("lat0").isNotNull() & F.col("lat2").isNotNull())
    j = j.withColumn("p", geo.displacement("lat0", "lon0", "lat", "lon")).withColumn("n", geo.displacement("lat", "lon", "lat2", "lon2"))
    j = j.withColumn("v0", F.hypot("p.dx", "p.dy") / step).withColumn("v1", F.hypot("n.dx", "n.dy") / step)
    j = j.where((F.col("v0") <= 4) & (F.col("v1") <= 4))
    turn = movement.turn_class(movement.heading("p.dx", "p.dy"), movement.heading("n.dx", "n.dy"), "v0", "v1")
    return j.select(
        *ident, F.col("grid_t").alias("utc"), movement.speed_bin("v0").alias("prev_bin"),
        movement.joint_class(movement.speed_bin("v1"), turn).alias("next_class"), "v0", "v1",
        F.col("p.dx").alias("pdx"), F.col("p.dy").alias("pdy"), F.col("n.dx").alias("ndx"), F.col("n.dy").alias("ndy"),
        *["lat0", "lon0", "lat", "lon", "lat2", "lon2"],
    )


def windows(s: DataFrame, steps: int = 10, step_s: int = 30, key: str = "track_id", block: int | None = None) -> DataFrame:
    """Disjoint windows of ``steps`` consecutive vectors, with displacement at steps 1, 4 and ``steps``.

    A run is a chain of samples 30 s apart whose vectors agree.
    """
    prev = with_previous(s, [key], "utc", ["utc", "ndx", "ndy"], block)
    chained = (F.col("utc") - F.col("prev_utc") == step_s) & (F.col("pdx") == F.col("prev_ndx")) & (F.col("pdy") == F.col("prev_ndy"))
    b = prev.withColumn("brk", ~F.coalesce(chained, F.lit(False)))
    r = ordered_scan(b, [key], "utc", maxes={"run": F.when(F.col("brk"), F.col("utc"))}, block=block)
    pos = floor_long((F.col("utc") - F.col("run")) / step_s)
    r = r.withColumn("w", floor_long(pos / steps)).withColumn("k", pos % steps + 1)
    at = lambda c, n: F.sum(F.when(F.col("k") <= n, F.col(c)))
    ident = [c for c in ("person",) if c in s.columns] + [key, "run", "w"]
    return (
        r.groupBy(*ident)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("utc").alias("start"),
            at("ndx", 1).alias("x1"), at("ndy", 1).alias("y1"), at("ndx", 4).alias("x4"), at("ndy", 4).alias("y4"),
            at("ndx", steps).alias("x10"), at("ndy", steps).alias("y10"),
        )
        .where(F.col("n") == steps)
        .drop("n")
    )


def monotone(fixes: DataFrame, key: str = "track_id", order: str = "seq", block: int | None = None) -> DataFrame:
    """Per track: whether times strictly increase, and how many pairs do not."""
    prev = with_previous(fixes, [key], order, ["t_s"], block)
    bad = F.coalesce(F.col("t_s") <= F.col("prev_t_s"), F.lit(False))
    return prev.groupBy(key).agg((~F.bool_or(bad)).alias("increasing"), F.count_if(bad).alias("bad_pairs"))


def path_hashes(fixes: DataFrame, key: str = "track_id", order: str = "seq") -> DataFrame:
    """SHA-256 of each track's rounded coordinates; times do not take part.

    The digest is updated point by point over the sorted rows of a partition, so a track of any length
    is read once and never gathered.
    """
    pts = fixes.select(F.col(key), F.col(order).alias("__o"), textfn.point_json("lon", "lat").alias("__p"))
    schema = T.StructType([fixes.schema[key], T.StructField("geometry_sha", T.StringType())])

    def digest(batches):
        now, sha = None, None
        for batch in batches:
            keys = batch[key]
            edges = [0, *(keys.ne(keys.shift()).to_numpy().nonzero()[0].tolist()[1 if len(keys) else 0 :]), len(keys)]
            done = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                text = ",".join(batch["__p"].iloc[a:b])
                if sha is not None and keys.iloc[a] == now:
                    sha.update(("," + text).encode())
                    continue
                if sha is not None:
                    sha.update(b"]]")
                    done.append((now, sha.hexdigest()))
                now, sha = keys.iloc[a], hashlib.sha256(("[[" + text).encode())
            if done:
                yield pd.DataFrame(done, columns=[key, "geometry_sha"])
        if sha is not None:
            sha.update(b"]]")
            yield pd.DataFrame([(now, sha.hexdigest())], columns=[key, "geometry_sha"])

    return pts.repartition(key).sortWithinPartitions(key, "__o").select(key, "__p").mapInPandas(digest, schema)


# ---------------------------------------------------------------- dedupe
FINISH_ROWS = 1 << 20  # undecided rows that one task settles in order


def _in_order(batches):
    """Rows by order -> those kept: no (person, time) twice, no coordinate of another person."""
    times, owner = set(), {}
    for batch in batches:
        keep = []
        for at, person, time, ck, own in zip(*[batch[c].tolist() for c in batch.columns], strict=True):
            fine = (person, time) not in times and (own or owner.get(ck, person) == person)
            if fine:
                times.add((person, time))
                owner[ck] = person
            keep.append(fine)
        yield batch.loc[np.array(keep, bool), batch.columns[:1]]


def first_wins(df: DataFrame, person: str, time: str, coord: list[str], order: str, finish: int = FINISH_ROWS) -> DataFrame:
    """Keep rows in ``order``: one per (person, time), and no coordinate window of another person.

    The rule is sequential: a refused row blocks nobody. Each round settles every row that is first
    in both of its groups and drops what those rows block; at most ``finish`` undecided rows, such as a
    chain in which every row waits for the one before it, are settled in order by one task. Deciding such
    chains in logarithmic rounds would decide lexicographically first matchings, for which no such
    method is known. A round reads only what the last one left undecided.
    """
    ck = F.sha2(F.concat_ws("|", *[F.round(c, 6).cast("string") for c in coord]), 256)
    df = cut_lineage(df, "first-wins")
    # __own: the coordinate has been taken, by this very person
    undecided = cut_lineage(df.select(F.col(order).alias("__o"), F.col(person).alias("__p"), F.col(time).alias("__time"), ck.alias("__ck"), F.lit(False).alias("__own")), "first-wins")
    kept = []
    while undecided.count() > finish:
        by_time = undecided.groupBy("__p", "__time").agg(F.min("__o").alias("__t"))
        by_ck = undecided.groupBy("__ck").agg(F.min("__o").alias("__c"))
        j = undecided.join(by_time, ["__p", "__time"]).join(by_ck, "__ck")
        now = cut_lineage(j.where((F.col("__o") == F.col("__t")) & (F.col("__own") | (F.col("__o") == F.col("__c")))).select("__o", "__p", "__time", "__ck"), "first-wins")
        kept.append(now.select("__o"))
        owner = now.groupBy("__ck").agg(F.min("__p").alias("__owner"))
        rest = undecided.join(now.select("__p", "__time"), ["__p", "__time"], "left_anti").join(owner, "__ck", "left")
        rest = rest.where(F.col("__owner").isNull() | (F.col("__owner") == F.col("__p")))
        undecided = cut_lineage(rest.select("__o", "__p", "__time", "__ck", (F.col("__own") | F.col("__owner").isNotNull()).alias("__own")), "first-wins")
    last = undecided.repartition(1).sortWithinPartitions("__o").mapInPandas(_in_order, T.StructType([undecided.schema["__o"]]))
    kept.append(cut_lineage(last, "first-wins"))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return df.join(out.withColumnRenamed("__o", order), order, "left_semi")


# ---------------------------------------------------------------- audits
def track_summary(edges: DataFrame, key: str = "track_id") -> DataFrame:
    """Admitted distance, points, gaps and excluded edges per track."""
    ok = F.col("status") == "admitted"
    return edges.groupBy(key).agg(
        F.round(F.sum(F.when(ok, F.col("length")).otherwise(0.0)), 1).alias("distance_m"),
        (F.count(F.lit(1)) + 1).alias("points"),
        F.count_if(F.col("status") == "gap").alias("gaps"),
        F.count_if(F.col("status") == "excluded").alias("excluded"),
    )


COVERED = 0.01  # intensity from which a cell counts as covered


def covered_area(coverage: DataFrame, key: str = "track_id") -> DataFrame:
    """Square kilometres of cells whose intensity at the middle detection width passes ``COVERED``; ``coverage`` has effort by cell."""
    return coverage.groupBy(key).agg((F.count_if(F.col("effort") * G.WIDTHS[1] > COVERED) * G.CELL**2 / 1e6).alias("coverage_km2"))


def audit_tracks(points: DataFrame, key: str = "track_id", order: str = "seq", by: str = "person", block: int | None = None) -> DataFrame:
    """Pairs of one walk interval: faulty times, gaps, speeds, usable seconds."""
    c = connected(points, key, order, block)
    dt = F.col("t_s") - F.col("prev_t_s")
    pair = F.coalesce(F.col("label_start") == F.col("prev_label_start"), F.lit(False))
    d = geo.displacement("prev_lat", "prev_lon", "lat", "lon")
    fast = F.hypot(F.col("__d.dx"), F.col("__d.dy")) > 4.0 * dt
    bad = ~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return c.withColumn("__d", d).groupBy(by).agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("invalid_points"),
        F.count_if(pair).alias("pairs"),
        F.count_if(pair & (dt <= 0)).alias("nonpositive"),
        F.count_if(pair & (dt > 15)).alias("gaps"),
        F.count_if(pair & (dt > 0) & fast).alias("fast"),
        F.coalesce(F.sum(F.when(F.col("linked"), dt)), F.lit(0)).cast("bigint").alias("usable_s"),
    )


def audit_duplicates(points: DataFrame, raw: str = "raw_t", key: str = "track_id", order: str = "seq", by: str = "person", block: int | None = None) -> DataFrame:
    """Same-second records inside one walk interval, by kind."""
    prev = with_previous(points, [key], order, ["t_s", "lat", "lon", "label_start", raw], block)
    walk = F.coalesce(F.col("label_start") == F.col("prev_label_start"), F.lit(False))
    dt = F.col("t_s") - F.col("prev_t_s")
    draw = F.col(raw) - F.col(f"prev_{raw}")
    same = (F.col("lat") == F.col("prev_lat")) & (F.col("lon") == F.col("prev_lon"))
    return prev.groupBy(by).agg(
        F.count_if(F.col("label_start").isNotNull()).alias("walk_points"),
        F.count_if(walk & (dt == 0) & same).alias("same_time_same_place"),
        F.count_if(walk & (dt == 0) & ~same).alias("same_time_other_place"),
        F.count_if(walk & (dt < 0)).alias("backwards"),
        F.count_if(walk & (draw == 0) & same).alias("same_raw_time"),
        F.count_if(walk & (dt == 0) & (draw > 0) & ~same).alias("within_second"),
    )


def time_agreement(points: DataFrame, numeric: str, text: str, by: str = "person") -> DataFrame:
    """How often a text time and a numeric time of one record differ by more than a second."""
    return points.groupBy(by).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.abs(F.col(numeric) - F.col(text)) > 1).alias("mismatches"))


def responder_qa(fixes: DataFrame, key: str = "track_id", order: str = "seq", block: int | None = None) -> DataFrame:
    """Accepted segments, flags and speeds per responder; the median is exact."""
    e = consecutive(fixes, key, order, block)
    status = F.when(F.col("dt") <= 0, "time").when(F.col("dt") > 120, "gap").when(F.col("speed") > 3, "fast").otherwise("ok")
    e = e.withColumn("__st", status)
    ok_speed = F.when(F.col("__st") == "ok", F.col("speed"))
    aggs = [
        (F.count(F.lit(1)) + 1).alias("points"), F.count_if(F.col("__st") == "ok").alias("accepted"),
        F.count_if(F.col("__st") == "time").alias("nonincreasing"), F.count_if(F.col("__st") == "gap").alias("gaps"),
        F.count_if(F.col("__st") == "fast").alias("fast"), F.avg(ok_speed).alias("mean_speed"),
    ]
    if block is None:
        return e.groupBy(key).agg(*aggs, F.median(ok_speed).alias("median_speed"))
    from .profile import exact_percentiles

    e = cut_lineage(e, "responders")
    med = exact_percentiles(e.where("__st = 'ok'"), [key], "speed", {"median_speed": 0.5})
    return e.groupBy(key).agg(*aggs).join(med, key, "left")


def path_lengths(fixes: DataFrame, key: str = "track_id", order: str = "seq", block: int | None = None) -> DataFrame:
    prev = with_previous(fixes, [key], order, ["t_s", "x_m", "y_m"], block)
    leg = F.hypot((F.col("x_m") - F.col("prev_x_m")).cast("double"), (F.col("y_m") - F.col("prev_y_m")).cast("double"))
    return prev.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.min_by("t_s", order).alias("first_t"), F.max_by("t_s", order).alias("last_t"),
        F.count_if(F.col("t_s") <= F.col("prev_t_s")).alias("nonincreasing"), F.coalesce(F.sum(leg), F.lit(0.0)).alias("length"))


def clock_bounds(points: DataFrame, key: str, x: str, y: str, error: float = 128.0, block: int | None = None) -> DataFrame:
    """Bounds on a clock scale from every pair of points of a track with increasing ``x``.

    lower = max over pairs of (dy - e)/dx, upper = min over pairs of (dy + e)/dx, over pairs with dx > 0.
    See :mod:`terrasift.operators.clock` for how this avoids listing the pairs.
    """
    from .clock import scale_bounds

    return scale_bounds(points, key, x, y, error, block=block)
