"""Fits of all hold-out folds from shared nodes against a refit of every fold by itself."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo
from terrasift.operators import foldfits as FF
from terrasift.operators import models as MD


def newton(f, x, low, high, h=1e-4):
    """Minimum of f within bounds by differences and damped steps: slow and plain."""
    x = np.array(x, float)
    for _ in range(200):
        e = np.eye(2) * h
        g = np.array([(f(x + d) - f(x - d)) / (2 * h) for d in e])
        hess = np.array([[(f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * h * h) for b in e] for a in e])
        step = np.linalg.solve(hess, g) if np.linalg.eigvalsh(hess)[0] > 0 else g
        t = 1.0
        while t > 1e-8 and f(np.clip(x - t * step, low, high)) > f(x):
            t /= 2
        new = np.clip(x - t * step, low, high)
        if np.abs(new - x).max() < 1e-10:
            return new
        x = new
    return x


def test_interpolated_minimum_and_edges():
    box = FF.Box((-1.0, 2.0), (3.0, 5.0))
    f = lambda p: (p[:, 0] - 0.7) ** 2 + 0.5 * (p[:, 1] - 3.3) ** 2 + 0.3 * p[:, 0] * p[:, 1]
    nodes = np.array(box.nodes())
    place, value, _ = FF.minimise(np.vstack([f(nodes), -nodes[:, 0] + nodes[:, 1]]), box)
    want = newton(lambda x: f(x[None])[0], (0, 3), box.low, box.high)
    assert np.allclose(place[0], want, atol=1e-7) and np.allclose(place[1], (3, 2)) and value[1] == pytest.approx(-1)
    assert FF.at_edge(place, box, FF.Box((-9.0, -9.0), (9.0, 9.0))).tolist()[1] == [True, True]
    assert not FF.at_edge(place, box, box).any()


def test_log_tail():
    z = np.array([-60.0, -30.0, -5.0, -0.1, 0.0, 0.3, 4.0, 9.0])
    got = FF.log_ndtr(z)
    assert got[2:] == pytest.approx([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z[2:]], rel=1e-12)
    assert got[0] == pytest.approx(-1805.0135606, rel=1e-8) and got[1] == pytest.approx(-454.3212439, rel=1e-8)


@pytest.fixture(scope="module")
def intervals(spark):
    rng = np.random.default_rng(4)
    d = np.exp(rng.normal(7.0, 0.8, 60))
    u = rng.uniform(20, 400, 60)
    rows = [(i, float(max(0.0, a - b)), float(a + b)) for i, (a, b) in enumerate(zip(d, u, strict=True))] + [(60, 0.0, 90.0), (61, 30000.0, 60000.0)]
    return rows, spark.createDataFrame(rows, "case_id long, lower double, upper double").repartition(3)


def test_leave_one_out_is_the_refit(intervals):
    rows, df = intervals
    got = {r.case_id: r for r in FF.leave_one_out_intervals(df).collect()}
    a = np.array(rows)

    def loss(keep):
        def f(p):
            cdf = lambda x: np.array([0.5 * math.erfc(-(math.log(v) - p[0]) / p[1] / math.sqrt(2)) if v > 0 else 0.0 for v in x])
            return -np.log(np.maximum(cdf(a[keep, 2]) - cdf(a[keep, 1]), 1e-300)).mean()

        return f

    assert len(got) == len(rows)
    for i in (0, 1, 17, 59, 60, 61):
        f = loss(a[:, 0] != i)
        want = newton(f, (7, 1), FF.INTERVAL_BOUNDS.low, FF.INTERVAL_BOUNDS.high)
        assert (got[i].mu, got[i].sigma) == pytest.approx(want, abs=1e-5) and not got[i].at_boundary
        assert got[i].train_nll == pytest.approx(f(want), abs=1e-8)


def test_few_cases_and_boundaries(spark):
    same = spark.createDataFrame([(i, 990.0, 1010.0) for i in range(3)], "case_id long, lower double, upper double")
    assert all(r.at_boundary and r.sigma == pytest.approx(0.15) for r in FF.leave_one_out_intervals(same).collect())


def test_settled_rows_take_no_further_part(monkeypatch):
    """A row costs a few evaluations, however many rows settle to the last bit at other steps."""
    rng, box, seen = np.random.default_rng(2), FF.Box((-1.0, -1.0), (1.0, 1.0)), []
    x, y = np.array(box.nodes()).T
    px, py = rng.uniform(-0.9, 0.9, (2, 500, 1))
    vander = FF.chebyshev.chebvander
    monkeypatch.setattr(FF.chebyshev, "chebvander", lambda v, m: seen.append(np.size(v)) or vander(v, m))
    place, _, _ = FF.minimise(np.cosh(x - px) + np.cosh(2 * (y - py)) + 0.3 * x * y, box)
    assert sum(seen) < 60 * len(px)
    slope = np.sinh(place[:, :1] - px) + 0.3 * place[:, 1:]
    inside = (np.abs(place) < 1).all(1)
    assert inside.sum() > 400 and np.abs(slope[inside]).max() < 1e-4  # of a polynomial of degree 8


def test_interval_folds_are_the_refits(spark):
    rng = np.random.default_rng(5)
    d, u = np.exp(rng.normal(7.0, 0.8, 90)), rng.uniform(20, 400, 90)
    rows = [(i % 3, float(max(0.0, a - b)), float(a + b)) for i, (a, b) in enumerate(zip(d, u, strict=True))]
    df = spark.createDataFrame([*rows, (1, None, None)], "fold int, lower double, upper double")
    got = {r.fold: r for r in MD.fit_interval(df, 3).collect()}
    assert set(got) == {0, 1, 2}
    for f in got:
        rest = spark.createDataFrame([r for r in rows if r[0] != f], "fold int, lower double, upper double")
        want = MD.fit_interval(rest).first()
        assert (got[f].mu, got[f].sigma, got[f].nll) == pytest.approx((want.mu, want.sigma, want.nll), abs=1e-7)
    assert not MD.fit_interval(df.where("fold = 1"), 3).where("fold = 1").count()  # no row to learn from


@pytest.fixture(scope="module")
def tilted(spark):
    """60 cases in six groups whose end cells follow a tilt."""
    rng = np.random.default_rng(8)
    cells = np.arange(geo.POLAR_CELLS)
    rows = []
    for k in range(60):
        rise, steep = np.sin(cells * 0.7 + k), np.cos(cells * 0.3 * (1 + k % 3))
        base, _ = FF.ring_masses(7.3, 0.7)
        p = np.repeat(base, geo.SECTORS) * np.exp(0.8 * rise - 0.5 * steep)
        label = int(rng.choice(len(p), p=p / p.sum())) if k % 20 else geo.POLAR_CELLS
        distance = float((label // geo.SECTORS + 0.5) * geo.RING_M)
        rows.append((k, 40.0 + (k % 6) * 0.3, 10.0, f"g{k % 6}", distance, label, rise.tolist(), steep.tolist()))
    schema = "case_id long, lat double, lon double, spatial_group string, distance_m double, label long, rise array<double>, steep array<double>"
    return rows, spark.createDataFrame(rows, schema).repartition(4)


def plain_tilt(rows, radial):
    """(b1, b2) of the penalised mean loss of some cases."""
    base, outside = FF.ring_masses(*radial)

    def f(b):
        out = 0.0
        for _, _, _, _, _, label, rise, steep in rows:
            if label >= geo.POLAR_CELLS:
                out -= math.log(outside)
                continue
            e = np.repeat(base, geo.SECTORS) * np.exp(b[0] * np.array(rise) + b[1] * np.array(steep))
            out -= math.log(e[label] / e.sum()) + math.log1p(-outside)
        return out / len(rows) + 0.05 * (b @ b)

    return newton(f, (0, 0), -3, 3)


def radial_of(rows):
    x = np.log([r[4] for r in rows])
    return float(x.mean()), float(x.std())


def test_buffered_folds_are_the_refits(spark, tilted):
    rows, df = tilted
    folds, out = MD.buffered_folds(df)  # groups lie 33 km apart: each leaves out its neighbours
    got = {r.fold: r for r in FF.fit_tilt_folds(df, folds, out, radial_of(rows)).collect()}
    assert set(got) == {f"g{i}" for i in range(6)}
    for g in (0, 2):
        train = [r for r in rows if abs(r[0] % 6 - g) > 1]
        want = plain_tilt(train, radial_of(train))
        r = got[f"g{g}"]
        assert r.train_n == len(train) and (r.mu, r.sigma) == pytest.approx(radial_of(train), abs=1e-9)
        assert (r.b1, r.b2) == pytest.approx(want, abs=2e-5)


def test_leave_one_out_tilts_are_the_refits(spark, tilted):
    rows, df = tilted
    got = {r.fold: r for r in FF.fit_tilt_folds(df, MD.case_folds(df), None, radial_of(rows)).collect()}
    assert len(got) == 60
    for k in (0, 7):
        train = [r for r in rows if r[0] != k]
        assert (got[k].b1, got[k].b2) == pytest.approx(plain_tilt(train, radial_of(train)), abs=2e-5)


def test_leave_one_out_stores_no_values_and_deals_its_cases(spark, tilted, monkeypatch):
    rows, df = tilted
    written, cut = {}, FF.cut_lineage
    monkeypatch.setattr(FF, "cut_lineage", lambda d, purpose: written.setdefault(purpose, cut(d, purpose)))
    FF.fit_tilt_folds(df, MD.case_folds(df), None, radial_of(rows)).count()
    assert set(written) == {"tilt-folds", "tilt-fits"}
    assert len(written["tilt-folds"].inputFiles()) > 1


def test_tilt_centre_is_the_refit(spark, tilted, monkeypatch):
    rows, df = tilted
    passes, add = [], FF.sum_terms
    monkeypatch.setattr(FF, "sum_terms", lambda *a, **k: passes.append(1) or add(*a, **k))
    assert FF.tilt_centre(df, radial_of(rows), 0.1) == pytest.approx(plain_tilt(rows, radial_of(rows)), abs=1e-3)
    assert len(passes) < 8


def test_folds_with_too_few_cases_are_left_out(spark, tilted):
    _, df = tilted
    folds, out = MD.buffered_folds(df, min_train=45)
    kept = {r.fold for r in folds.collect()}
    assert kept == set() or all(f in ("g0", "g5") for f in kept)
    assert {r.fold for r in out.select("fold").distinct().collect()} <= kept


def test_held_out_scores(spark, tilted):
    rows, df = tilted
    fits = spark.createDataFrame([(f"g{i}", 7.3, 0.7, 0.8, -0.5) for i in range(5)], "fold string, mu double, sigma double, b1 double, b2 double")
    got = {r.case_id: r for r in FF.score_held_out(df, fits, "spatial_group").collect()}
    assert set(got) == {k for k in range(60) if k % 6 < 5}
    base, outside = FF.ring_masses(7.3, 0.7)
    for k in (0, 1, 20, 33):
        label, rise, steep = rows[k][5], np.array(rows[k][6]), np.array(rows[k][7])
        for e, nll, kind in ((np.repeat(base, 72), got[k].base_nll, "base"), (np.repeat(base, 72) * np.exp(0.8 * rise - 0.5 * steep), got[k].nll, "tilted")):
            if label == geo.POLAR_CELLS:
                assert nll == pytest.approx(-math.log(outside)) and not got[k][f"{kind}_hit30"]
                continue
            assert nll == pytest.approx(-math.log(e[label] / e.sum() * (1 - outside)))
            units = 2 * (np.arange(5760) // 72) + 1
            order = np.lexsort((np.arange(5760), -(e / units)))
            covered = units[order].cumsum()[np.flatnonzero(order == label)[0]]
            assert got[k][f"{kind}_hit20"] == (covered <= round(0.2 * geo.TOTAL_UNITS))


def test_one_fit_is_stationary(spark):
    c = spark.createDataFrame([(0, k, int((k * 37) % 3000), 300.0 + 61 * k) for k in range(12)], "fold int, case_id bigint, label bigint, distance_m double")
    radial = MD.fit_distance(c, ["fold"])
    f = MD.polar_cells(c.select("fold", "case_id")).withColumn("rise", F.sin(F.col("cell_idx") * 0.7 + F.col("case_id"))).withColumn("steep", F.cos(F.col("cell_idx") * 0.3))
    fit = MD.fit_tilt(f, c.select("fold", "case_id", "label"), radial)
    r, m = fit.first(), radial.first()
    j = np.arange(5760)
    rows = [(k, 0, 0, "", 300.0 + 61 * k, (k * 37) % 3000, np.sin(j * 0.7 + k), np.cos(j * 0.3)) for k in range(12)]
    assert r.train_n == 12 and (r.b1, r.b2) == pytest.approx(plain_tilt(rows, (m.mu, m.sigma)), abs=2e-5)
    total = MD.tilt_mass(f, radial, fit.select("fold", "b1", "b2")).groupBy("case_id").agg((F.sum("mass") + F.max("outside")).alias("t")).collect()
    assert all(t.t == pytest.approx(1, abs=1e-9) for t in total)
