"""Weighted target paths: frames, exposure to planned sweeps, gains, reweighting, quotas and light."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, textfn, timefn
from ..functions import grid as G
from ..functions.geo import floor_long
from ..session import fan_out
from . import mass as M
from .exposure import exposure as exposure  # noqa: PLC0414
from .exposure import regular_frame as regular_frame  # noqa: PLC0414


def _halves(paths: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Both end cells of every path position, each with its share."""
    return paths.select(*keep, F.inline(F.array(
        F.struct(F.col("left_cell").alias("cell"), (1 - F.col("fraction")).alias("share")),
        F.struct(F.col("right_cell").alias("cell"), F.col("fraction").alias("share")))))


def frame_mass(paths: DataFrame, keys: Sequence[str] = ("mission_id", "scenario", "frame_idx")) -> DataFrame:
    """Mass per cell of every frame; the sentinel cell is the outside mass."""
    h = _halves(paths, [*keys, "weight"])
    return h.groupBy(*keys, "cell").agg(F.sum(F.col("weight") * F.col("share")).alias("mass")).where("mass > 0")


def check_paths(paths: DataFrame, outside: DataFrame, keys: Sequence[str] = ("mission_id", "scenario")) -> DataFrame:
    """Weights plus outside sum to one per scenario; fractions and cells are in range; a path's frames run forward."""
    ok = F.col("fraction").between(0, 1) & F.col("left_cell").between(0, G.OUTSIDE_CELL) & F.col("right_cell").between(0, G.OUTSIDE_CELL) & (F.col("weight") >= 0)
    per = paths.groupBy(*keys, "path_id").agg(F.max("weight").alias("w"), F.bool_and(ok).alias("ok"), (F.count_distinct("frame_idx") == F.count(F.lit(1))).alias("once"))
    tot = per.groupBy(*keys).agg(F.sum("w").alias("w"), F.bool_and(F.col("ok") & F.col("once")).alias("fine"))
    return tot.join(outside, list(keys)).select(*keys, (F.col("fine") & (F.abs(F.col("w") + F.col("outside") - 1) <= 1e-8)).alias("ok"))


def nearest_frame(visits: DataFrame, frames: DataFrame, key: str = "mission_id", bucket: float = 60.0) -> DataFrame:
    """Frame whose time is nearest each visit's midpoint; the earlier one wins a tie.

    Every frame owns the time up to halfway to its neighbours. Those intervals are cut into buckets, so
    visits find their frame by an equi join and a busy mission spreads over many keys. A mission has at
    most a few thousand frames (six hours), so ordering them is bounded.
    """
    w = W.partitionBy(key).orderBy("t_s")
    t = F.col("t_s").cast("double")
    fr = frames.select(
        key, "frame_idx", t.alias("t"), F.lag(t).over(w).alias("p"), F.lead(t).over(w).alias("n"),
        F.min(t).over(W.partitionBy(key)).alias("first"), F.max(t).over(W.partitionBy(key)).alias("last"))
    fr = fr.withColumn("lo", F.coalesce((F.col("p") + F.col("t")) / 2, F.col("t") - 1)).withColumn("hi", F.coalesce((F.col("n") + F.col("t")) / 2, F.col("t")))
    span = fr.select(key, "first", "last").distinct()
    cells = fr.select(key, "frame_idx", "lo", "hi", F.explode(F.sequence(floor_long(F.col("lo") / bucket), floor_long(F.col("hi") / bucket))).alias("__b"))
    v = visits.join(span, key).withColumn("__m", F.least(F.greatest((F.col("arrive_s") + F.col("leave_s")) / 2, "first"), "last"))
    v = v.withColumn("__b", floor_long(F.col("__m") / bucket))
    hit = v.join(cells, [key, "__b"]).where((F.col("__m") > F.col("lo")) & (F.col("__m") <= F.col("hi")))
    return hit.select(*visits.columns, "frame_idx")


def lookup_evidence(positions: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("mission_id", "bin_end_s")) -> DataFrame:
    """Evidence intensity under each position, zero where there is none."""
    j = positions.join(evidence.select(*keys, "cell", "intensity"), [*keys, "cell"], "left")
    return j.withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def evidence_upto(evidence: DataFrame, seconds: Column, horizon: int = G.MAX_FORECAST_S) -> DataFrame:
    """Only what was observed by ``seconds`` and within the horizon: no future evidence."""
    return evidence.where((F.col("bin_end_s") <= seconds) & (F.col("bin_end_s") <= horizon))


def gain(exposed: DataFrame) -> DataFrame:
    """Added detection per plan, scenario and width: sum w * exp(-W * old) * (1 - exp(-W * new)).

    ``exposed`` is what :func:`exposure` gives; ``old`` is what assigned plans already meet.
    """
    x = exposed
    x = x.withColumn("width", F.explode(F.array(*[F.lit(w) for w in G.WIDTHS])))
    g = F.col("weight") * F.exp(-F.col("width") * F.col("old")) * -F.expm1(-F.col("width") * F.col("effort"))
    return x.groupBy("mission_id", "plan_id", "scenario", "width").agg(F.sum(g).alias("gain"))


def plan_gain(gains: DataFrame) -> DataFrame:
    """Worst scenario at the middle width, and the whole range; a scenario a plan never meets gains nothing."""
    k = len(G.SCENARIO_WEIGHTS)
    mid = F.col("width") == G.WIDTHS[1]
    full = F.count_if(mid) == k
    return gains.groupBy("mission_id", "plan_id").agg(
        F.when(full, F.min(F.when(mid, F.col("gain")))).otherwise(0.0).alias("worst"),
        F.when(F.count(F.lit(1)) == k * 3, F.min("gain")).otherwise(0.0).alias("low"), F.max("gain").alias("high"))


def accept(assigned: DataFrame, exposed: DataFrame) -> DataFrame:
    """Accumulated effort per path once a plan is accepted."""
    cols = ["mission_id", "scenario", "path_id", "effort"]
    return assigned.select(*cols).unionByName(exposed.select(*cols)).groupBy(*cols[:3]).agg(F.sum("effort").alias("effort"))


def swept_area(steps: DataFrame) -> DataFrame:
    """Square metres of distinct cells swept per plan."""
    c = steps.select("mission_id", "plan_id", F.explode(F.concat("cells_a", "cells_b")).alias("cell")).where("cell >= 0").distinct()
    return c.groupBy("mission_id", "plan_id").agg((F.count(F.lit(1)) * G.CELL**2).alias("area_m2"))


def _cell_zone(cell: str = "cell") -> Column:
    r, c = floor_long(F.col(cell) / G.N), F.col(cell) % G.N
    return (floor_long(r / G.ZONE) * G.ZONES + floor_long(c / G.ZONE)).cast("bigint")


def priority(paths: DataFrame) -> DataFrame:
    """Per zone, the largest scenario consensus over all frames."""
    f = frame_mass(paths).where(F.col("cell") < G.OUTSIDE_CELL)
    z = f.groupBy("mission_id", "frame_idx", "scenario", _cell_zone().alias("zone_id")).agg(F.sum("mass").alias("value"))
    c = M.consensus(z, ["mission_id", "frame_idx", "zone_id"])
    return c.groupBy("mission_id", "zone_id").agg(F.max("consensus").alias("priority")).where("priority > 0")


def reweight(weights: DataFrame, positions: DataFrame, evidence: DataFrame, outside: DataFrame) -> DataFrame:
    """Bayes update of path weights by negative evidence along each path.

    ``positions`` holds both end cells of a path at each evidence bin. Log survival adds up per path;
    weights and outside are divided by their common evidence.
    """
    h = positions.select("mission_id", "scenario", "path_id", "bin_end_s", F.inline(F.array(
        F.struct(F.col("left_cell").alias("cell"), (1 - F.col("fraction")).alias("share")),
        F.struct(F.col("right_cell").alias("cell"), F.col("fraction").alias("share")))))
    loss = h.join(evidence.select("mission_id", "bin_end_s", "cell", "intensity"), ["mission_id", "bin_end_s", "cell"]).groupBy(
        "mission_id", "scenario", "path_id").agg(F.sum(F.col("share") * F.col("intensity")).alias("loss"))
    x = weights.join(loss, ["mission_id", "scenario", "path_id"], "left").withColumn("q", F.col("weight") * F.exp(-F.coalesce("loss", F.lit(0.0))))
    ev = x.groupBy("mission_id", "scenario").agg(F.sum("q").alias("inside")).join(outside, ["mission_id", "scenario"])
    ev = ev.select("mission_id", "scenario", (F.col("inside") + F.col("outside")).alias("evidence"))
    e = F.when(F.col("evidence") > 0, F.col("evidence")).otherwise(F.raise_error(F.lit("observation incompatible with all paths")).cast("double"))
    return x.join(ev, ["mission_id", "scenario"]).select("mission_id", "scenario", "path_id", (F.col("q") / e).alias("weight"), "evidence")


def mean_speed(paths: DataFrame) -> DataFrame:
    """Weighted mean speed (km/h) and distance per scenario."""
    w = F.greatest(F.sum("weight"), F.lit(1e-12))
    return paths.groupBy("mission_id", "scenario").agg(
        (F.sum(F.col("weight") * F.col("speed_mps")) * 3.6 / w).alias("mean_kmh"), (F.sum(F.col("weight") * F.col("distance_m")) / w).alias("mean_m"))


def zone_speed(paths: DataFrame) -> DataFrame:
    """Mixture speed per zone: speed mass over mass."""
    sw = M.scenario_weight()
    h = _halves(paths, ["mission_id", "scenario", "weight", "speed_mps"]).where(F.col("cell") < G.OUTSIDE_CELL)
    m = F.col("weight") * F.col("share") * sw
    z = h.groupBy("mission_id", _cell_zone().alias("zone_id")).agg(F.sum(m * F.col("speed_mps") * 3.6).alias("speed_mass"), F.sum(m).alias("poa"))
    return z.withColumn("speed_kmh", F.col("speed_mass") / F.greatest(F.col("poa"), F.lit(1e-12)))


def ess(weights: DataFrame, low: int = 256) -> DataFrame:
    """Effective number of paths per scenario, and whether it is thin."""
    n = F.pow(F.sum("weight"), 2) / F.greatest(F.sum(F.col("weight") * F.col("weight")), F.lit(1e-300))
    return weights.groupBy("mission_id", "scenario").agg(n.alias("effective")).withColumn("low_support", F.col("effective") < low)


def total_variation(a: DataFrame, b: DataFrame, keys: Sequence[str], bin_: str = "zone_id", value: str = "value") -> DataFrame:
    x = a.select(*keys, bin_, F.col(value).alias("__a")).join(b.select(*keys, bin_, F.col(value).alias("__b")), [*keys, bin_], "full")
    return x.groupBy(*keys).agg((0.5 * F.sum(F.abs(F.coalesce("__a", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0))))).alias("total_variation"))


def same_assignments(a: DataFrame, b: DataFrame, key: str = "run_id") -> DataFrame:
    """Whether two plans give every team the same zone."""
    x = a.select(key, "team_id", F.col("zone_id").alias("za")).join(b.select(key, "team_id", F.col("zone_id").alias("zb")), [key, "team_id"], "full")
    return x.groupBy(key).agg(F.bool_and(F.col("za").eqNullSafe(F.col("zb"))).alias("same"))


def stratified_sample(weights: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Stratified draws on the weight CDF: k equal strata, one draw each, repeats merged by count.

    A path spans an interval of the CDF, so it owns the draws whose uniforms fall in it; those are
    generated inside the row. The CDF runs over one scenario's paths, bounded by the grid (two per cell).
    """
    w = W.partitionBy("mission_id", "scenario")
    run = w.orderBy("path_id").rowsBetween(W.unboundedPreceding, 0)
    x = weights.withColumn("__t", F.sum("weight").over(w)).withColumn("__hi", F.sum("weight").over(run) / F.col("__t"))
    last = F.lead("path_id").over(w.orderBy("path_id")).isNull()
    x = x.withColumn("__hi", F.when(last, 1.0).otherwise(F.col("__hi"))).withColumn("__lo", F.coalesce(F.lag("__hi").over(w.orderBy("path_id")), F.lit(0.0)))
    first, end = floor_long(F.col("__lo") * k), F.least(floor_long(F.col("__hi") * k), F.lit(k - 1).cast("bigint"))
    x = x.where(first <= end).withColumn("i", F.explode(F.sequence(first, end)))
    u = (F.col("i") + textfn.hash_uniform("i", F.lit(0), F.lit(seed), F.lit(5))) / k
    hit = x.where((u >= F.col("__lo")) & (u < F.col("__hi")))
    return hit.groupBy("mission_id", "scenario", "path_id", "__t").agg(F.count(F.lit(1)).alias("draws")).select(
        "mission_id", "scenario", "path_id", "draws", (F.col("__t") * F.col("draws") / k).alias("weight"))


def quota(populations: DataFrame, budget: int, key: str = "mission_id", cap: int | None = None) -> DataFrame:
    """Water-fill a budget over ordered populations.

    The level is the largest L (at most ``cap``, where given) with sum(min(n, L)) <= budget. With the populations sorted, a
    running sum says where the level falls; what is left goes one each, in order, to those not yet full.
    """
    w = W.partitionBy(key)
    asc = w.orderBy("n", "pos")
    x = populations.withColumn("below", F.coalesce(F.sum("n").over(asc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("left", F.count(F.lit(1)).over(w) - F.row_number().over(asc) + 1)
    level = F.floor((F.lit(budget) - F.col("below")) / F.col("left"))
    # the level is set by the first population that does not fit whole
    top = F.lit(cap if cap is not None else (1 << 62)).cast("bigint")
    x = x.withColumn("lv", F.max(F.when(level < F.col("n"), level)).over(w)).withColumn("level", F.least(F.coalesce("lv", top), top))
    x = x.withColumn("base", F.least("n", "level")).withColumn("spare", F.lit(budget) - F.sum(F.least("n", "level")).over(w))
    want = (F.col("base") < F.least(F.col("n"), top)).cast("bigint")
    x = x.withColumn("turn", F.sum(want).over(w.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    extra = F.when((want == 1) & (F.col("turn") <= F.col("spare")), 1).otherwise(0)
    return x.select(key, "pos", "n", (F.col("base") + extra).cast("bigint").alias("quota"))


def candidates(zones: DataFrame, teams: DataFrame, top: int = 32) -> DataFrame:
    """The best ``top`` zones each team can reach and leave within its budget.

    ``zones`` has one row per team and zone (at most 1,024 per team) with the team's reach time.
    """
    j = zones.join(teams, ["mission_id", "team_id"]).where((2 * F.col("reach_s") < F.col("budget_s")) & (F.col("priority") > 0) & ~F.col("excluded"))
    w = W.partitionBy("mission_id", "team_id").orderBy(F.desc("priority"), "zone_id")
    return j.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)


def best_plan(plans: DataFrame) -> DataFrame:
    """Plan with the largest gain per second of each team; the first one wins a tie."""
    v = F.col("gain") / F.greatest(F.col("total_s"), F.lit(1.0))
    return plans.groupBy("mission_id", "team_id").agg(F.max_by(F.struct("plan_id", v.alias("value")), F.struct(v, -F.col("plan_id"))).alias("b")).select("mission_id", "team_id", "b.plan_id", "b.value")


# ---------------------------------------------------------------- light
def light_bins(starts: DataFrame, step: int = 60, key: str = "mission_id") -> DataFrame:
    """Light rate of each minute of a horizon, sampled at its midpoint, with the integral at both ends.

    Columns in: key, start_s (epoch seconds), horizon_s, lat, lon, night_factor. A horizon is at most
    eight hours, so a key has at most 481 bins. Starts are spread by key before they grow, so that bins
    are not shuffled, here or in what joins them on the key.
    """
    n = F.ceil(F.col("horizon_s") / step).cast("int")
    b = fan_out(starts, key).withColumn("bin", F.explode(F.sequence(F.lit(0), n)))
    mid = F.timestamp_seconds(F.col("start_s") + F.col("bin") * step + step / 2)
    b = b.withColumn("alt", timefn.solar_elevation(mid, "lat", "lon")).withColumn("rate", timefn.light_factor("alt", F.col("night_factor")))
    w = W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    b = b.withColumn("hi", F.sum(F.col("rate") * step).over(w)).withColumn("lo", F.col("hi") - F.col("rate") * step)
    return b.withColumn("t0", (F.col("bin") * step).cast("double")).withColumn("t1", ((F.col("bin") + 1) * step).cast("double"))


def _at_bins(queries: DataFrame, bins: DataFrame, key: str) -> DataFrame:
    """Queries with all bins of their key; the caller's condition keeps one of them.

    The bins stay where they are and pass once. A size guessed from the narrow starts says nothing
    about the bins, so neither side is broadcast.
    """
    return queries.withColumnRenamed(key, "__key").join(bins.hint("merge"), F.col("__key") == F.col(key)).drop("__key")


def effective_seconds(queries: DataFrame, bins: DataFrame, key: str = "mission_id", step: int = 60) -> DataFrame:
    """Light-weighted seconds at each queried time, from the bin of its minute."""
    q = queries.withColumn("__bin", floor_long(F.col("t_s") / step))
    j = _at_bins(q, bins.select(key, "bin", "lo", "rate", "t0"), key).where(F.col("bin").between(F.col("__bin"), F.col("__bin")))
    return j.select(*queries.columns, (F.col("lo") + F.col("rate") * (F.col("t_s") - F.col("t0"))).alias("effective_s"), F.col("rate").alias("factor"))


def finish_times(queries: DataFrame, bins: DataFrame, key: str = "mission_id") -> DataFrame:
    """Clock time at which a light-weighted amount is reached.

    A bin holds the amounts above the integral before it, up to its own; the first holds those below too, and
    the last those above. Every query row has one result row; an amount of zero or less is reached at the start.
    """
    w = W.partitionBy(key).orderBy("bin")
    b = bins.select(
        key, "lo", "hi", "rate", "t0", "t1", F.lag("hi").over(w).alias("__low"), F.lag("bin").over(w).isNull().alias("__first"), F.lead("bin").over(w).isNull().alias("__last"))
    t = F.col("target_s")
    holds = (F.col("__first") | (t > F.col("__low"))) & (F.col("__last") | (t <= F.col("hi")))
    j = _at_bins(queries, b, key).where(F.coalesce(holds, F.col("__first")))
    over = F.col("__last") & (t > F.col("hi"))
    finish = F.when(t <= 0, F.col("t0")).when(over, F.col("t1") + (t - F.col("hi")) / F.col("rate")).otherwise(F.col("t0") + (t - F.col("lo")) / F.col("rate"))
    return j.select(*queries.columns, finish.alias("finish_s"))


def phase_minutes(bins: DataFrame, key: str = "mission_id", step: int = 60) -> DataFrame:
    width = F.greatest(F.lit(0.0), F.least(F.col("t1"), F.col("horizon_s")) - F.col("t0")) / 60
    ph = timefn.light_phase("alt")
    return bins.groupBy(key).agg(
        *[F.sum(F.when(ph == p, width).otherwise(0.0)).alias(p.lower() + "_minutes") for p in ("DAY", "TWILIGHT", "NIGHT")],
        F.min(F.when(F.col("t0") <= F.col("horizon_s"), F.col("rate"))).alias("worst_factor"))
