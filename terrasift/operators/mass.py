"""Probability mass on the cell grid: histograms, negative evidence, scenarios, zones.

A mass table is long: one row per occupied cell plus one row (-1, -1) for the mass outside the window.
A group is one mission and scenario, so it never has more than 512 * 512 + 1 rows; windows over such a
group are bounded by the grid, however large the input is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import grid as G
from ..functions.geo import floor_long

SCENARIO = ["mission_id", "scenario"]


def _out() -> Column:
    return F.lit(-1).cast("bigint")


def scenario_weight(scenario: Column | str = "scenario") -> Column:
    s = F.col(scenario) if isinstance(scenario, str) else scenario
    out = F.lit(0.0)
    for name, w in G.SCENARIO_WEIGHTS.items():
        out = F.when(s == name, w).otherwise(out)
    return out


def histogram(points: DataFrame, keys: Sequence[str], cell_m: float | None = None) -> DataFrame:
    """Share of points per cell; points outside the window go to the outside row, never to an edge cell.

    With ``cell_m`` the points are planar metres and every square bin counts, without bounds.
    """
    if cell_m is not None:
        cells = points.select(*keys, floor_long(F.col("x") / cell_m).alias("row"), floor_long(F.col("y") / cell_m).alias("col"))
    else:
        ok = geo.inside("row", "col")
        cells = points.select(
            *keys, F.when(ok, floor_long("row")).otherwise(_out()).alias("row"), F.when(ok, floor_long("col")).otherwise(_out()).alias("col"))
    n = cells.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(W.partitionBy(*keys))
    return n.select(*keys, "row", "col", (F.col("__n") / total).alias("mass"))


def ensure_outside(mass: DataFrame) -> DataFrame:
    """Give every mission and scenario an outside row."""
    zero = mass.select(*SCENARIO).distinct().select(*SCENARIO, _out().alias("row"), _out().alias("col"), F.lit(0.0).alias("mass"))
    return mass.unionByName(zero).groupBy(*SCENARIO, "row", "col").agg(F.sum("mass").alias("mass"))


def reserve_outside(mass: DataFrame, share: Column | float) -> DataFrame:
    """Move a share in [0, .5] of all mass outside; other shares are refused."""
    r = share if isinstance(share, Column) else F.lit(float(share))
    r = F.when(r.between(0, 0.5), r).otherwise(F.raise_error(F.lit("share must be within 0 and .5")).cast("double"))
    m = F.when(F.col("row") == -1, r + (1 - r) * F.col("mass")).otherwise(F.col("mass") * (1 - r))
    return ensure_outside(mass).withColumn("mass", m)


def mixture(mass: DataFrame) -> DataFrame:
    return mass.groupBy("mission_id", "row", "col").agg(F.sum(scenario_weight() * F.col("mass")).alias("mass"))


def attach_coverage(mass: DataFrame, coverage: DataFrame) -> DataFrame:
    """Prior with the effort on its cell, zero where nothing was searched."""
    return mass.join(coverage.select("mission_id", "row", "col", "effort"), ["mission_id", "row", "col"], "left").withColumn(
        "effort", F.coalesce(F.col("effort"), F.lit(0.0)))


def posterior(mass: DataFrame, coverage: DataFrame, width: float = 15.0) -> DataFrame:
    """Negative evidence: mass * exp(-width * effort), renormalised with the outside mass untouched."""
    j = attach_coverage(mass, coverage).withColumn("q", F.col("mass") * F.exp(-F.col("effort") * width))
    z = F.sum("q").over(W.partitionBy(*SCENARIO))
    z = F.when(z > 0, z).otherwise(F.raise_error(F.lit("observation incompatible with all states")).cast("double"))
    return j.select(*SCENARIO, "row", "col", (F.col("q") / z).alias("mass"))


def zone_sum(cells: DataFrame, keys: Sequence[str], measure: Column | str = "mass") -> DataFrame:
    """Sum of a measure over each 16 x 16 zone."""
    m = F.col(measure) if isinstance(measure, str) else measure
    return cells.where(F.col("row") >= 0).groupBy(*keys, geo.zone_of("row", "col").alias("zone_id")).agg(F.sum(m).alias("value"))


def consensus(zones: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Geometric mean over the scenarios; a zone missing or empty in one scenario gets zero."""
    k = len(G.SCENARIO_WEIGHTS)
    v = F.col(value)
    all_positive = F.count_if(v > 0) == k
    pooled = F.when(all_positive, F.exp(F.sum(F.ln(F.when(v > 0, v).otherwise(1.0))) / k)).otherwise(0.0)
    return zones.groupBy(*keys).agg(pooled.alias("consensus"))


def agreement(zones: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Smallest over largest scenario value, zero when nothing is there."""
    k = len(G.SCENARIO_WEIGHTS)
    low = F.when(F.count(F.lit(1)) == k, F.min(value)).otherwise(0.0)
    return zones.groupBy(*keys).agg(F.coalesce(F.try_divide(low, F.max(value)), F.lit(0.0)).alias("agreement"))


def _zone_facts(coverage: DataFrame, terrain: DataFrame) -> DataFrame:
    """Hazard share and track flag per zone."""
    hz = terrain.where(geo.is_hazard("landcover", "slope")).select("mission_id", geo.zone_of("row", "col").alias("zone_id"), F.lit(1).alias("h"), F.lit(0).alias("t"))
    tr = coverage.where(F.col("effort") * G.WIDTHS[1] > 0.05).select("mission_id", geo.zone_of("row", "col").alias("zone_id"), F.lit(0).alias("h"), F.lit(1).alias("t"))
    return hz.unionByName(tr).groupBy("mission_id", "zone_id").agg(
        (F.sum("h") / float(G.ZONE**2)).alias("hazard_share"), (F.max("t") == 1).alias("has_track"))


def zone_cards(mass: DataFrame, coverage: DataFrame, terrain: DataFrame, min_prior: float = 1e-7) -> DataFrame:
    """One card per zone: posterior mass with its range over widths, prior, detection, score and rank.

    One join, one normalising window per mission and scenario, one aggregation per zone.
    """
    j = attach_coverage(mass, coverage)
    w = W.partitionBy(*SCENARIO)
    for k, width in enumerate(G.WIDTHS):
        j = j.withColumn(f"q{k}", F.col("mass") * F.exp(-F.col("effort") * width))
    j = j.select(
        "*", *[(F.col(f"q{k}") / F.sum(f"q{k}").over(w)).alias(f"p{k}") for k in range(3)], scenario_weight().alias("sw"),
    ).where(F.col("row") >= 0)
    aggs = [F.sum(F.col("sw") * F.col("mass")).alias("prior_poa")]
    for k, width in enumerate(G.WIDTHS):
        aggs.append(F.sum(F.col("sw") * F.col(f"p{k}")).alias(f"poa{k}"))
        aggs.append(F.sum(F.col("sw") * F.col("mass") * -F.expm1(-F.col("effort") * width)).alias(f"pos{k}"))
    for s in G.SCENARIO_WEIGHTS:
        aggs.append(F.sum(F.when(F.col("scenario") == s, F.col("p1")).otherwise(0.0)).alias(f"scn_{s}"))
    z = j.groupBy("mission_id", geo.zone_of("row", "col").alias("zone_id")).agg(*aggs)
    z = z.join(_zone_facts(coverage, terrain), ["mission_id", "zone_id"], "full")
    nums = [c for c in z.columns if c not in ("mission_id", "zone_id", "has_track")]
    z = z.fillna(0.0, nums).fillna(False, ["has_track"])
    scn = [F.col(f"scn_{s}") for s in G.SCENARIO_WEIGHTS]
    low, high = F.least(*scn), F.greatest(*scn)
    pooled = F.when(low > 0, F.exp(sum((F.ln(F.when(c > 0, c).otherwise(1.0)) for c in scn), F.lit(0.0)) / len(scn))).otherwise(0.0)
    pod = lambda k: F.coalesce(F.try_divide(F.col(f"pos{k}"), F.col("prior_poa")), F.lit(0.0))
    z = eligible_zones(z).select(
        "mission_id", "zone_id", geo.zone_label("zone_id").alias("label"), F.col("poa1").alias("poa"),
        F.least("poa0", "poa1", "poa2").alias("poa_min"), F.greatest("poa0", "poa1", "poa2").alias("poa_max"), "prior_poa",
        pod(0).alias("pod_low"), pod(2).alias("pod_high"), F.col("pos1").alias("pos"), F.array(*scn).alias("scenarios"),
        F.when(F.col("eligible"), pooled * 0.35).otherwise(0.0).alias("score"),
        F.coalesce(F.try_divide(low, high), F.lit(0.0)).alias("agreement"), "access", "has_track", "hazard_share",
    )
    ranked = rank_zones(z)
    return ranked.where((F.col("prior_poa") >= min_prior) | F.col("has_track"))


def eligible_zones(zones: DataFrame, limit: float = 0.02) -> DataFrame:
    ok = F.col("hazard_share") < limit
    return zones.withColumn("eligible", ok).withColumn("access", F.when(ok, "REVIEW_REQUIRED").otherwise("AGENCY_ONLY"))


def significant(value: Column | str) -> Column:
    """A double to twelve significant digits."""
    return F.format_string("%.11e", value).cast("double")


def rank_zones(zones: DataFrame) -> DataFrame:
    """Rank over all 1,024 zones of a mission by score, then zone id; absent zones count as score zero.

    Distributed sums differ in the last digits from run to run, so scores equal to twelve significant
    digits tie, however small they are.
    """
    zones = zones.withColumn("score", significant("score"))
    up = F.col("score") > 0
    by_score = W.partitionBy("mission_id").orderBy(F.desc("score"), "zone_id")
    by_id = W.partitionBy("mission_id").orderBy("zone_id").rowsBetween(W.unboundedPreceding, -1)
    positives = F.count_if(up).over(W.partitionBy("mission_id"))
    before = F.coalesce(F.count_if(up).over(by_id), F.lit(0))
    zero_rank = positives + F.col("zone_id") + 1 - before
    return zones.withColumn("rank", F.when(up, F.row_number().over(by_score)).otherwise(zero_rank).cast("bigint"))


def visible_zones(zones: DataFrame, top: int = 100) -> DataFrame:
    return zones.where((F.col("rank") <= top) | F.col("has_track"))


def listed_zones(zones: DataFrame, text: str) -> DataFrame:
    return visible_zones(zones).where(F.col("label").contains(text.upper()) & (F.col("access") != "AGENCY_ONLY"))


def top_zones(zones: DataFrame, n: int) -> DataFrame:
    """The best ``n`` zones of each mission: a report, so the limit is the feature."""
    return zones.where(F.col("rank") <= n)


def mission_totals(mass: DataFrame, coverage: DataFrame, terrain: DataFrame) -> DataFrame:
    """Outside, water and inside mass, searched area and zones per mission."""
    post = posterior(mass, coverage, G.WIDTHS[1])
    water = terrain.where(geo.is_water("landcover")).select("mission_id", "row", "col", F.lit(True).alias("water"))
    m = post.join(water, ["mission_id", "row", "col"], "left").withColumn("wm", scenario_weight() * F.col("mass"))
    out = F.col("row") == -1
    totals = m.groupBy("mission_id").agg(
        *[F.sum(F.when(out & (F.col("scenario") == s), F.col("mass")).otherwise(0.0)).alias(f"outside_{s}") for s in G.SCENARIO_WEIGHTS],
        F.sum(F.when(out, F.col("wm")).otherwise(0.0)).alias("outside_mixed"),
        F.sum(F.when(F.col("water"), F.col("wm")).otherwise(0.0)).alias("water_mass"),
        F.sum(F.when(~out, F.col("wm")).otherwise(0.0)).alias("inside_mass"),
    )
    c = F.col("effort") * G.WIDTHS[1]
    cov = coverage.groupBy("mission_id").agg(
        (F.count_if(c > 0.01) * (G.CELL**2 / 1e6)).alias("coverage_km2"),
        F.count_distinct(F.when(c > 0.05, geo.zone_of("row", "col"))).alias("searched_zones"),
    )
    return totals.join(cov, "mission_id", "left").fillna(0.0, ["coverage_km2"]).fillna(0, ["searched_zones"])


def mass_region(mass: DataFrame, share: float = 0.5) -> DataFrame:
    """Cells of the smallest set holding ``share`` of each scenario's inside mass; the crossing cell is in."""
    m = mass.where((F.col("row") >= 0) & (F.col("mass") > 0))
    w = W.partitionBy(*SCENARIO)
    run = w.orderBy(F.desc("mass"), "row", "col").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("mass").over(run), F.lit(0.0))
    return m.withColumn("__b", before).withColumn("__t", F.sum("mass").over(w) * share).where(F.col("__b") < F.col("__t")).drop("__b", "__t")


def region_votes(mass: DataFrame, share: float = 0.5) -> DataFrame:
    return mass_region(mass, share).groupBy("mission_id", "row", "col").agg(F.count(F.lit(1)).alias("votes"))


def layer_strength(mass: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Display strength: mass over the 97th percentile of positive mass, clipped, to the power .65.

    The percentile runs over the cells of one window, so its buffer is bounded by the grid.
    """
    m = mass.where((F.col("row") >= 0) & (F.col("mass") > 0))
    scale = F.greatest(F.percentile("mass", 0.97).over(W.partitionBy(*keys)), F.lit(1e-12))
    return m.withColumn("strength", F.pow(geo.clip(F.col("mass") / scale, 0, 1), F.lit(0.65)))


def check_mass(mass: DataFrame, keys: Sequence[str] = SCENARIO) -> DataFrame:
    """Whether each distribution is finite, non-negative and sums to one."""
    m = F.col("mass")
    fine = m.isNotNull() & ~F.isnan(m) & (F.abs(m) != float("inf")) & (m >= -1e-12)
    return mass.groupBy(*keys).agg((F.bool_and(fine) & (F.abs(F.sum("mass") - 1) <= 1e-8)).alias("ok"))


def with_previous_rank(zones: DataFrame, previous: DataFrame) -> DataFrame:
    prev = previous.select("mission_id", "zone_id", F.col("rank").alias("previous_rank"))
    return zones.join(prev, ["mission_id", "zone_id"], "left")


def with_decisions(zones: DataFrame, decisions: DataFrame) -> DataFrame:
    d = decisions.select("mission_id", "zone_id", F.col("status").alias("decision"))
    return zones.join(d, ["mission_id", "zone_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("PROPOSED")))
