"""What grows inside a row stays in its task: plans that neither shuffle nor broadcast it."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrasift.operators import exposure as EX
from terrasift.operators import foldfits as FF
from terrasift.operators import graph as GR
from terrasift.operators import models as MD
from terrasift.operators import paths


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def starts(spark, n=4):
    return spark.range(n).select(
        F.col("id").alias("mission_id"), (F.lit(1704067200) + F.col("id") * 7200).alias("start_s"), F.lit(3600.0).alias("horizon_s"), F.lit(33.4).alias("lat"), F.lit(126.3).alias("lon"), F.lit(0.6).alias("night_factor"))


def test_light_bins_are_neither_broadcast_nor_shuffled(spark):
    q = spark.createDataFrame([(0, 0.0, 30), (1, 70.0, 61), (1, 70.0, 61), (3, 9e4, 3600), (9, 5.0, 1)], "mission_id bigint, target_s double, t_s int")
    for df in (paths.finish_times(q.drop("t_s"), paths.light_bins(starts(spark))), paths.effective_seconds(q.drop("target_s"), paths.light_bins(starts(spark)))):
        text = plan(df)
        assert "Broadcast" not in text
        below = text[text.index("Window"):]  # the bins' side: the only exchange lies below what makes the bins
        assert len(re.findall(r"Exchange ", below)) == 1 and below.index("Generate") < below.index("Exchange ")
        assert sorted(r.mission_id for r in df.collect()) == [0, 1, 1, 3]


def test_every_amount_has_one_finish(spark):
    bins = spark.createDataFrame([(1, b, 60.0 * b, 60.0 * b + 60, 0.5, 30.0 * b, 30.0 * b + 30) for b in range(3)], "mission_id int, bin int, t0 double, t1 double, rate double, lo double, hi double")
    q = spark.createDataFrame([(1, -5.0), (1, None), (1, 30.0), (1, 30.0000001), (1, 90.0), (1, 100.0)], "mission_id int, target_s double")
    got = {r.target_s: r.finish_s for r in paths.finish_times(q, bins).collect()}
    assert len(got) == 6 and got[-5.0] == 0.0 and got[None] is None and got[30.0] == 60.0 and got[90.0] == 180.0 and got[100.0] == 200.0
    assert 60.0 < got[30.0000001] < 60.001


def test_cells_of_cases_stay_in_their_task(spark):
    cases = spark.range(9).select(F.col("id").alias("case_id"), (F.col("id") * 777).alias("label"))
    ids = lambda b: FF.column(b, "case_id")[:, None]
    mass = lambda b: (1.0 + (ids(b) * 31 + np.arange(5760) * 17) % 13)  # many equal densities
    one = lambda k: (1.0 + (k * 31 + np.arange(5760) * 17) % 13)
    units = 2 * (np.arange(5760) // 72) + 1
    made = {f: f(cases) for f in (lambda c: MD.area_hits(c, mass), lambda c: MD.cells_within(c, mass, {"n": 46080}), lambda c: MD.running_area(c, mass))}
    hits, within, area = ({r.case_id: r for r in df.collect()} for df in made.values())
    for df in made.values():
        assert "Generate" not in plan(df) and "Broadcast" not in plan(df) and "Window" not in plan(df)
    for k in range(9):
        order = np.lexsort((np.arange(5760), -(one(k) / units)))
        run = units[order].cumsum()
        assert area[k].cells == order.tolist() and area[k].units == run.tolist() and within[k].n == (run <= 46080).sum()
        at = run[order == k * 777]
        assert [hits[k].hit10, hits[k].hit20, hits[k].hit30] == [bool(len(at) and at[0] <= s * 460800) for s in (0.1, 0.2, 0.3)]


def test_totals_of_tilted_cells(spark):
    c = spark.createDataFrame([(0, k, 300.0 + 61 * k) for k in range(7)], "fold int, case_id bigint, distance_m double")
    radial = MD.fit_distance(c, ["fold"])
    beta = radial.select("fold", F.lit(0.4).alias("b1"), F.lit(-0.3).alias("b2"))
    made = lambda b: (np.sin(np.arange(5760) * 0.7 + FF.column(b, "case_id")[:, None]), np.cos(np.arange(5760) * 0.3) + 0 * FF.column(b, "case_id")[:, None])
    f = MD.polar_cells(c.select("fold", "case_id")).withColumn("rise", F.sin(F.col("cell_idx") * 0.7 + F.col("case_id"))).withColumn("steep", F.cos(F.col("cell_idx") * 0.3))
    want = {r.case_id: r for r in MD.tilt_mass(f, radial, beta).groupBy("case_id").agg(F.sum("mass").alias("inside"), F.max("mass").alias("top"), F.max("outside").alias("outside")).collect()}
    got = MD.tilt_totals(c.select("fold", "case_id"), made, radial, beta)
    assert "Window" not in plan(got) and got.count() == 7
    for r in got.collect():
        assert (r.inside, r.top, r.outside) == pytest.approx(tuple(want[r.case_id][n] for n in ("inside", "top", "outside")), rel=1e-12)


def test_ring_sums_of_a_grid_of_tilts():
    rng = np.random.default_rng(3)
    rise, steep = rng.normal(0, 1, 5760), rng.exponential(1, 5760)
    for scale in (1.0, 400.0):  # products of the second are lost and it is summed node by node
        tilt = np.array(FF.Box((-3.0, -2.0), (1.0, 3.0)).nodes(5)).T * scale
        score = tilt[0][:, None] * rise + tilt[1][:, None] * steep
        rings, top = FF._ring_sums(rise, steep, tilt)
        shift = score.max(1)
        want = np.exp(score - shift[:, None]).reshape(25, 80, 72).sum(2)
        at = want > 1e-200
        assert np.allclose((np.log(rings, where=at, out=np.zeros_like(rings)) + top[:, None])[at], (np.log(want, where=at, out=np.zeros_like(want)) + shift[:, None])[at], rtol=1e-12, atol=1e-12)


def test_counts_of_cropped_points(spark):
    p = spark.range(300).select((F.col("id") * 37 % 700).cast("double").alias("row"), (F.col("id") % 100 * 11 % 800).cast("double").alias("col"))
    p = p.unionByName(p)
    w = spark.range(60).select(F.col("id").alias("window_key"), (F.col("id") % 4 * 64 + 300).alias("row0"), (F.col("id") % 3 * 64).alias("col0")).unionByName(
        spark.createDataFrame([(99, 5000, 5000)], "window_key bigint, row0 bigint, col0 bigint"))
    want = {r.window_key: r["count"] for r in GR.crop(p, w, 64).groupBy("window_key").count().collect()}
    calls = []
    plain = GR.crop
    GR.crop = lambda points, windows, *rest: calls.append((points.count(), windows.count())) or plain(points, windows, *rest)
    try:
        got = {r.window_key: r.n for r in GR.crop_counts(p, w, 64).collect()}
    finally:
        GR.crop = plain
    assert got == want and len(got) == 60 and calls == [(300, 13)]


def test_memory_of_a_group_of_paths():
    n, plans = EX.POSITIONS // 4, 40
    at = [{"frame_idx": f, "left_cell": 5, "right_cell": 6, "fraction": 0.5} for f in range(4)]
    paths_ = pa.table({"path_id": np.arange(n), "at": pa.array([at] * n)})
    effort = pa.table({"plan_id": np.arange(plans), "frame_idx": np.zeros(plans, np.int64), "cell": np.full(plans, 5), "effort": np.ones(plans)})
    tracemalloc.start()
    out = EX._meet(paths_, effort, ["path_id"], pa.schema([("path_id", pa.int64()), ("plan_id", pa.int64()), ("effort", pa.float64())]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows == n * plans and peak + out.nbytes < 100 << 20
