import itertools
import random

import pytest
from pyspark.sql import functions as F

from terrasift.operators import clock, profile, proximity, tracks
from terrasift.operators.ordered import choose_block, ordered_scan
from terrasift.plans import adapters as A

M = 111194.9266  # metres per degree of latitude on the mean sphere


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def walk(spark, times, speed=1.0, start=0, label=True):
    data = [(1, 1, i, t, (speed * (t - times[0])) / M, 0.0) for i, t in enumerate(times)]
    return spark.createDataFrame(data, "person bigint, track_id bigint, seq bigint, t_s bigint, lat double, lon double")


def labels(spark, rows_):
    return spark.createDataFrame([(1, a, b, m) for a, b, m in rows_], "track_id bigint, start bigint, end bigint, mode string")


def test_labels_exactly_one_interval(spark):
    t = [-1, 0, 40, 50, 60, 61, 120, 201]
    p = spark.createDataFrame([(1, i, v) for i, v in enumerate(t)], "track_id bigint, seq bigint, t_s bigint")
    got = tracks.label_points(p, labels(spark, [(0, 100, "walk"), (50, 60, "bus"), (120, 200, "bike")])).orderBy("seq")
    assert [r.label_start for r in got.collect()] == [None, 0, 0, None, None, 0, None, None]


def chain(spark, times, labs, speed=1.0):
    p = tracks.label_points(walk(spark, times, speed), labels(spark, labs))
    return tracks.samples(tracks.resample(tracks.sessionize(p)))


def test_resample_hand_case(spark):
    got = chain(spark, list(range(0, 125, 5)), [(0, 1000, "walk")]).orderBy("utc").collect()
    assert len(got) == 3
    for r in got:
        assert (r.prev_bin, r.next_class) == (2, 18)
        assert r.pdy == pytest.approx(30, rel=1e-5) and r.ndx == pytest.approx(0, abs=1e-6)


def test_gaps_other_modes_and_speed_give_nothing(spark):
    assert chain(spark, [0, 5, 10, 100, 105, 110], [(0, 1000, "walk")]).isEmpty()
    assert chain(spark, list(range(0, 125, 5)), [(0, 40, "walk"), (41, 1000, "bus")]).isEmpty()
    assert chain(spark, list(range(0, 125, 5)), [(0, 1000, "walk")], speed=10).isEmpty()


def test_windows(spark):
    def s(broken):
        data = [(1, 1, 30 * i, 0.0, 30.0, 30.0 if i else 30.0, 0.0) for i in range(20)]
        data = [(p, t, u, 30.0 if i != broken else 29.0, 0.0, 30.0, 0.0) for i, (p, t, u, *_) in enumerate(data)]
        return spark.createDataFrame(data, "person bigint, track_id bigint, utc bigint, pdx double, pdy double, ndx double, ndy double")

    w = tracks.windows(s(-1)).orderBy("start").collect()
    assert [(r.x1, r.x4, r.x10) for r in w] == [(30, 120, 300)] * 2
    assert tracks.windows(s(12)).count() == 1
    assert rows(tracks.windows(s(12)), "start", "x10") == rows(tracks.windows(s(12), block=64), "start", "x10")


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_blocked_scan_equals_plain_windows(spark, block):
    rnd = random.Random(block)
    data = [(rnd.choice([1, 1, 1, 2, 3]), q, rnd.randint(-5, 5)) for q in rnd.sample(range(400), 150)]
    df = spark.createDataFrame(data, "k bigint, q bigint, v bigint")
    args = dict(lags={"p": "v"}, leads={"n": "v"}, sums={"s": F.col("v")}, maxes={"m": F.when(F.col("v") > 0, F.col("q"))})
    cols = ("k", "q", "p", "n", "s", "m")
    key = lambda d: sorted((tuple((x is None, x) for x in r) for r in d.select(*cols).collect()))
    assert key(ordered_scan(df, ["k"], "q", **args)) == key(ordered_scan(df, ["k"], "q", **args, block=block))


def test_plan_choice(spark):
    df = spark.range(100).select((F.col("id") % 3 == 0).cast("int").alias("k"))
    assert choose_block(df, ["k"], limit=90) is None and choose_block(df, ["k"], limit=50, block=8) == 8


def test_hot_plan_gives_the_same_track_results(spark, sf):
    f0, f1 = A.fixes(spark, sf), A.fixes(spark, sf, 100)
    cols = ("track_id", "seq", "t_s", "x_m", "y_m", "elev")
    assert rows(f0, *cols) == rows(f1, *cols)
    e0, e1 = tracks.consecutive(f0), tracks.consecutive(f1, block=100)
    assert rows(e0, "track_id", "seq", "dt", "quality_flag") == rows(e1, "track_id", "seq", "dt", "quality_flag")
    p = A.walk_points(spark, sf)
    lab = tracks.label_points(p, A.mode_labels(p))
    s0, s1 = tracks.sessionize(lab), tracks.sessionize(lab, block=100)
    assert rows(s0, "track_id", "seq", "segment") == rows(s1, "track_id", "seq", "segment")
    r = lambda d: rows(d.withColumn("median_speed", F.round("median_speed", 9)), "track_id", "accepted", "median_speed")
    assert r(tracks.responder_qa(f0)) == r(tracks.responder_qa(f0, block=100))


def brute_clock(points, e):
    lo, hi, seen = 0.0, float("inf"), False
    for (_, x0, y0), (_, x1, y1) in itertools.combinations(points, 2):
        if x1 > x0:
            seen = True
            lo, hi = max(lo, (y1 - y0 - e) / (x1 - x0)), min(hi, (y1 - y0 + e) / (x1 - x0))
    return lo, hi if seen else None


@pytest.mark.parametrize("falls", [False, True])
def test_clock_bounds_against_all_pairs(spark, falls):
    rnd = random.Random(3)
    data, want = [], {}
    for t in range(4):
        x = [float(rnd.randint(0, 400)) for _ in range(25)]
        x = x if falls else sorted(x)
        pts = [(i, v, v * 1.1 + rnd.uniform(-90, 90)) for i, v in enumerate(x)]
        want[t] = brute_clock(pts, 50.0)
        data += [(t, *p) for p in pts]
    data.append((9, 0, 1.0, 1.0))
    df = spark.createDataFrame(data, "track_id bigint, seq bigint, x double, y double")
    got = {r.track_id: r for r in clock.scale_bounds(df, "track_id", "x", "y", 50.0).collect()}
    for t, (lo, hi) in want.items():
        assert got[t].lower == pytest.approx(lo) and got[t].upper == pytest.approx(hi)
        assert got[t].compatible == (lo <= hi)
    assert got[9].upper is None and got[9].compatible


def test_clock_of_short_tracks_takes_one_step(spark, monkeypatch):
    """Tracks that fit a task cost no job a round; longer ones go through the rounds and give the same bounds."""
    rnd, data = random.Random(5), []
    for t in range(30):
        x = [float(rnd.randint(0, 300)) for _ in range(1 + 4 * t)]
        data += [(f"t{t}", i, v, v * rnd.uniform(0.8, 1.2) + rnd.uniform(-90, 90)) for i, v in enumerate(sorted(x) if t % 3 else x)]
    data += [("t1", 99, float("nan"), 0.0), (None, 0, 1.0, 1.0), (None, 1, 2.0, 2.0)]
    df = spark.createDataFrame(data, "track_id string, seq bigint, x double, y double").repartition(3)
    written, cut = [], clock.cut_lineage
    monkeypatch.setattr(clock, "cut_lineage", lambda d, purpose: written.append(purpose) or cut(d, purpose))
    take = lambda n: {r.track_id: (r.lower, r.upper, r.compatible) for r in clock.scale_bounds(df, "track_id", "x", "y", 20.0, task_rows=n).collect()}
    short = take(1000)
    assert written == ["clock-points"]
    mixed = take(60)
    assert len(written) > 6 and set(short) == set(mixed) == {f"t{t}" for t in range(30)}
    assert all(short[t] == pytest.approx(mixed[t]) for t in short)
    for t in (3, 17, 29):
        assert short[f"t{t}"][:2] == pytest.approx(brute_clock([r[1:] for r in data if r[0] == f"t{t}"], 20.0))


def test_clock_hand_cases(spark):
    mk = lambda gps: spark.createDataFrame([(1, i, o, g) for i, (o, g) in enumerate(zip((0.0, 1000.0, 2000.0), gps))], "track_id bigint, seq bigint, x double, y double")
    assert not clock.scale_bounds(mk((0.0, 1000.0, 0.0)), "track_id", "x", "y", 128.0).first().compatible
    assert clock.scale_bounds(mk((0.0, 1000.0, 2000.0)), "track_id", "x", "y", 128.0).first().compatible


def test_numeric_stats_hand_case(spark):
    df = spark.createDataFrame([(float(v),) for v in ("0", "1", "2", "100", "-1", "nan", "inf")], "v double")
    r = profile.numeric_stats(df, ["v"]).first()
    assert (r["count"], r.nonfinite, r.p50, r.zero, r.negative) == (7, 2, 1, 1, 1)


def test_exact_percentiles_match_the_buffered_ones(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(i % 3, rnd.gauss(0, 1) if i % 5 else 0.25) for i in range(3000)], "k bigint, v double")
    want = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(F.percentile("v", 0.37).alias("a"), F.median("v").alias("b")).collect()}
    got = {r.k: (r.a, r.b) for r in profile.exact_percentiles(df, ["k"], "v", {"a": 0.37, "b": 0.5}).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def brute_first_wins(data):
    seen, owner, kept = set(), {}, []
    for o, p, t, c in sorted(data):
        if (p, t) in seen or owner.get(c, p) != p:
            continue
        seen.add((p, t))
        owner[c] = p
        kept.append(o)
    return kept


def test_first_wins_follows_the_sequential_rule(spark):
    rnd = random.Random(11)
    data = [(i, rnd.randint(0, 3), rnd.randint(0, 6), float(rnd.randint(0, 8))) for i in range(120)]
    df = spark.createDataFrame(data, "ord bigint, person bigint, utc bigint, c double")
    got = sorted(r.ord for r in tracks.first_wins(df, "person", "utc", ["c"], "ord").collect())
    assert got == brute_first_wins(data)


def test_proximity_against_all_pairs(spark):
    from math import asin, cos, radians, sin, sqrt

    def d(a, b, c, e):
        q = sin(radians(c - a) / 2) ** 2 + cos(radians(a)) * cos(radians(c)) * sin(radians(e - b) / 2) ** 2
        return 2 * 6371008.8 * asin(sqrt(q))

    rnd = random.Random(2)
    spot = lambda: (rnd.uniform(59.5, 61.5), rnd.choice([rnd.uniform(178.5, 180), rnd.uniform(-180, -178.5)]))
    left = [(i, *spot()) for i in range(60)] + [(100 + i, 60.0, 179.9) for i in range(40)]
    right = [(i % 4, *spot()) for i in range(25)] + [(7, 60.0, 179.9)] * 30
    ls = spark.createDataFrame(left, "id bigint, lat double, lon double")
    rs = spark.createDataFrame(right, "g bigint, lat double, lon double")
    want = sorted({(i, g) for i, a, b in left for g, c, e in right if d(a, b, c, e) <= 40000})
    got = sorted(tuple(r) for r in proximity.near_any(ls, rs, "id", "g", [("lat", "lon")], 40000.0).collect())
    assert got == want
