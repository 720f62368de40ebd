import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import grid as G
from terrasift.operators import coverage as C
from terrasift.operators import graph as GR
from terrasift.operators import mass as M
from terrasift.operators import models as MD
from terrasift.operators import paths as P

MASS = "mission_id bigint, scenario string, row bigint, col bigint, mass double"


def block(spark, n=16, inside=0.8):
    rows = [(1, s, r, c, inside / n**2) for s in ("a", "b", "b2") for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows + [(1, s, -1, -1, 1 - inside) for s in ("a", "b", "b2")], MASS)


def test_posterior_moves_mass_away_and_conserves_it(spark):
    cov = spark.createDataFrame([(1, 0, 0, 2.0 / 15)], "mission_id bigint, row bigint, col bigint, effort double")
    prior = block(spark)
    post = {(r.row, r.col): r.mass for r in M.posterior(prior, cov).where("scenario = 'a'").collect()}
    assert post[(0, 0)] < 0.8 / 256 < post[(15, 15)] and post[(-1, -1)] > 0.2
    assert sum(post.values()) == pytest.approx(1)
    assert all(r.ok for r in M.check_mass(M.posterior(prior, cov)).collect())


def test_outside_is_not_clipped(spark):
    pts = spark.createDataFrame([(1, "a", -2.0, 0.0), (1, "a", 0.0, 0.0), (1, "a", 513.0, 500.0), (1, "a", 511.0, 511.0)], "mission_id bigint, scenario string, row double, col double")
    m = {(r.row, r.col): r.mass for r in M.histogram(pts, M.SCENARIO).collect()}
    assert m == {(-1, -1): 0.5, (0, 0): 0.25, (511, 511): 0.25}


def test_consensus_zero_veto(spark):
    vals = {"a": (0.04, 0.0, 0.01), "b": (0.01, 0.05, 0.01), "b2": (0.01, 0.05, 0.01)}
    z = spark.createDataFrame([(1, s, i, v) for s, vs in vals.items() for i, v in enumerate(vs)], "mission_id bigint, scenario string, zone_id bigint, value double")
    got = [r.consensus for r in M.consensus(z, ["mission_id", "zone_id"]).orderBy("zone_id").collect()]
    assert got == pytest.approx([4e-6 ** (1 / 3), 0, 0.01])


def test_reserve_outside(spark):
    m = spark.createDataFrame([(1, "a", 3, 3, 0.9), (1, "a", -1, -1, 0.1)], MASS)
    got = {r.row: r.mass for r in M.reserve_outside(m, 0.2).collect()}
    assert got[3] == pytest.approx(0.72) and got[-1] == pytest.approx(0.28)
    with pytest.raises(Exception, match="within 0 and .5"):
        M.reserve_outside(m, 0.51).collect()


def test_rank_counts_absent_zones(spark):
    z = spark.createDataFrame([(1, 5, 0.0), (1, 700, 0.4), (1, 900, 0.0)], "mission_id bigint, zone_id bigint, score double")
    assert {r.zone_id: r.rank for r in M.rank_zones(z).collect()} == {700: 1, 5: 7, 900: 901}


def test_spread_keeps_effort_inside_and_loses_it_at_the_edge(spark):
    e = spark.createDataFrame([(1, 100, 100, 2.0, 1.3), (2, 0, 0, 2.0, 1.3)], "mission_id bigint, row bigint, col bigint, effort double, sigma double")
    tot = {r.mission_id: r.t for r in C.spread(e, ["mission_id"]).groupBy("mission_id").agg(F.sum("effort").alias("t")).collect()}
    r = int(3 * 1.3 + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / 1.3) ** 2)
    w /= w.sum()
    assert tot[1] == pytest.approx(2) and tot[2] == pytest.approx(2 * w[r:].sum() ** 2)


def test_exposure_hand_case(spark):
    paths = spark.createDataFrame([(1, "a", i, f, 0.3, 100 + i, 100 + i, 0.0) for i in range(3) for f in range(4)],
                                  "mission_id bigint, scenario string, path_id bigint, frame_idx bigint, weight double, left_cell bigint, right_cell bigint, fraction double")
    steps = spark.createDataFrame([(1, 1, 0.0, 10.0, [100], [101]), (1, 1, 10.0, 20.0, [101], [102])], "mission_id bigint, plan_id bigint, arrive_s double, leave_s double, cells_a array<bigint>, cells_b array<bigint>")
    got = {r.path_id: r.effort for r in P.exposure(paths, steps).collect()}
    assert got == pytest.approx({0: 0.5 / 30, 1: 1 / 30, 2: 0.5 / 30})


def test_quota_water_fill(spark):
    rnd = random.Random(4)
    data = [(m, p, rnd.choice([0, 3, 50, 400])) for m in range(40) for p in range(5)]
    got = {(r.mission_id, r.pos): r.quota for r in P.quota(spark.createDataFrame(data, "mission_id bigint, pos bigint, n bigint"), 333).collect()}
    for m in range(40):
        n = [d[2] for d in data if d[0] == m]
        level = max(lv for lv in range(0, 401) if sum(min(v, lv) for v in n) <= 333)
        want = [min(v, level) for v in n]
        left = 333 - sum(want)
        for i, v in enumerate(n):
            if left and want[i] < v:
                want[i] += 1
                left -= 1
        assert [got[(m, p)] for p in range(5)] == want


def test_interval_fit_recovers_parameters(spark):
    rnd = np.random.default_rng(1)
    d = np.exp(rnd.normal(7.2, 0.9, 1500))
    df = spark.createDataFrame([(float(max(0, v - 60)), float(v + 60)) for v in d], "lower double, upper double")
    r = MD.fit_interval(df).first()
    assert r.mu == pytest.approx(7.2, abs=0.08) and r.sigma == pytest.approx(0.9, abs=0.08) and not r.at_boundary


def test_energy_hand_case(spark):
    s = spark.createDataFrame([(30, 0.0, 0.0, 0.0, 0.0)], "horizon int, x double, y double, x2 double, y2 double")
    t = spark.createDataFrame([(30, 3.0, 4.0), (30, 0.0, 0.0)], "horizon int, tx double, ty double")
    assert sorted(r.model_energy for r in MD.energy_score(t, s).collect()) == [0, 5]


def test_buffer_keeps_only_far_cases(spark):
    c = spark.createDataFrame([(1, 40.0, -119.0, "x", 900.0), (2, 40.1, -119.0, "y", 900.0), (3, 41.0, -119.0, "z", 900.0)], "case_id bigint, lat double, lon double, spatial_group string, distance_m double")
    out = sorted(r.case_id for r in MD.buffered_excluded(c).where("fold = 'x'").collect())
    assert out == [1, 2]


def test_gate(spark):
    m = spark.createDataFrame([(-0.1, 0.01), (-0.1, -0.01)], "mean double, high double")
    cond = {"improved": F.col("mean") < 0, "sure": F.col("high") < 0}
    assert [MD.gate(m.where(f"high = {h}"), cond).first().status for h in (0.01, -0.01)] == ["NOT_ADOPTED", "ADOPTED"]


def _grid(spark, water_col=4, n=9):
    return spark.createDataFrame([(0, r, c, 0.0, 80 if c == water_col else 30, 0.0, 90.0) for r in range(n) for c in range(n)], "window_id bigint, row bigint, col bigint, dem double, landcover bigint, slope double, road_distance double")


def test_barrier_blocks_travel_and_matches_dijkstra(spark):
    t = _grid(spark)
    poi = spark.createDataFrame([(0, 4.5, 2.5, "unknown"), (0, 4.5, 7.5, "private")], "window_id bigint, row double, col double, access string")
    seeds = GR.poi_eligible(poi, t).where("eligible").select("window_id", (F.col("r") * 512 + F.col("c")).alias("cell"))
    e = GR.edges8(t)
    got = {r.cell: r.seconds for r in GR.travel_time(e, seeds, 3600.0).collect()}
    assert all(c % 512 < 4 for c in got) and len(got) == 36
    import heapq

    back = {}
    for r in e.collect():
        back.setdefault(r.dst, []).append((r.src, r.seconds))
    dist, heap = {4 * 512 + 2: 0.0}, [(0.0, 4 * 512 + 2)]
    while heap:
        d, u = heapq.heappop(heap)
        for v, s in back.get(u, []) if d == dist[u] else []:
            if d + s < dist.get(v, 1e18):
                dist[v] = d + s
                heapq.heappush(heap, (d + s, v))
    assert got == pytest.approx(dist)


def test_sweep_pattern_single_row(spark):
    z = spark.createDataFrame([(33, 1)], "zone_id bigint, band_rows int")
    s = GR.sweep_pattern(z).where("direction = 'forward'").orderBy("step").collect()
    assert len(s) == 256 and s[0].cell == 16 * 512 + 16 and s[16].cell == 17 * 512 + 31
    assert all(abs(a.cell - b.cell) in (1, 512) for a, b in zip(s, s[1:]))


def test_speed_rows_are_made_once_and_dealt_evenly(spark, monkeypatch):
    """The rows that all forests learn from come from one reading of the edges, in pieces of like size."""
    data = [(t, "hasty", t % 3, 1.0 + i / 50, i / 100) for t in range(40) for i in range(1 + t)]
    rows = spark.createDataFrame(data, "track_id long, search_type string, team_id long, speed double, grade double")
    seen = []

    class Enough(Exception):
        pass

    def cut(df, purpose):
        seen.append(df)
        raise Enough

    monkeypatch.setattr(MD, "cut_lineage", cut)
    with pytest.raises(Enough):
        MD.speed_model(rows)
    x = seen[0]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    sizes = [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * len(data) / 4
    assert all(r.weight == pytest.approx(1 / (1 + r.track_id)) for r in x.collect()) and x.count() == len(data)
