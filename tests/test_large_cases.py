"""Inputs beyond the limits that operators once had."""

import hashlib

import numpy as np
import pytest

from terrasift.operators import graph, mass, models, paths, tracks
from terrasift.session import shared_dir
from terrasift.sources import sinks


def test_split_names_are_padded_and_never_cut(spark):
    people = spark.range(1500).withColumnRenamed("id", "person")
    got = {r.person: r.split for r in models.hash_split(people).collect()}
    order = sorted(range(1500), key=lambda p: hashlib.sha256(f"geolife-v1:{p:03d}".encode()).hexdigest())
    want = {p: "train" if i < 900 else "validation" if i < 1200 else "test" for i, p in enumerate(order)}
    assert got == want


def test_energy_score_of_many_samples(spark):
    n = 65_537
    samples = spark.range(n).selectExpr("1 as horizon", "cast(id % 9000 as double) as x", "0.0d as y", "cast(id % 9000 as double) as x2", "0.0d as y2")
    targets = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "horizon int, tx double, ty double")
    want = sum(i % 9000 for i in range(n)) / n
    assert [r.model_energy for r in models.energy_score(targets, samples).collect()] == pytest.approx([want, want])


def test_long_track_digest(spark):
    n = 20_001
    fixes = spark.range(n).selectExpr("id % 2 as track_id", "id as seq", "cast(id / 1000 as double) as lon", "-0.0000001d as lat")
    got = {r.track_id: r.geometry_sha for r in tracks.path_hashes(fixes).collect()}
    for k in (0, 1):
        text = ",".join(f"[{i / 1000!r},0.0]" for i in range(n) if i % 2 == k)
        assert got[k] == hashlib.sha256(f"[[{text}]]".encode()).hexdigest()


def test_dependent_rows_settle_however_many(spark):
    """A chain in which each row blocks the next one for a coordinate or a time."""
    rows = [(i, f"p{i % 2}", i // 2 * 10, float(i // 2)) for i in range(10_000)]
    got = sorted(r.ord for r in tracks.first_wins(spark.createDataFrame(rows, "ord long, person string, utc long, c double"), "person", "utc", ["c"], "ord").collect())
    assert got == list(range(0, 10_000, 2))


def test_rounds_and_the_last_task_agree_with_the_rule(spark):
    import random

    rng = random.Random(9)
    rows = [(i, f"p{rng.randrange(4)}", rng.randrange(25), float(rng.randrange(30))) for i in range(300)]
    times, owner, want = set(), {}, []
    for o, p, t, c in rows:
        if (p, t) not in times and owner.get(c, p) == p:
            times.add((p, t))
            owner[c] = p
            want.append(o)
    df = spark.createDataFrame(rows, "ord long, person string, utc long, c double").repartition(5)
    for finish in (0, 40, 1000):
        assert sorted(r.ord for r in tracks.first_wins(df, "person", "utc", ["c"], "ord", finish=finish).collect()) == want


def test_dense_spots_are_not_listed_pair_by_pair(spark):
    """Two crowds a radius apart: cells are cut until few places are compared, and the answer is the plain one."""
    from terrasift.operators import proximity

    rng = np.random.default_rng(3)
    deg = 1000 / proximity.M_PER_DEG
    a = [(i, 40.0 + float(v), 10.0 + float(w)) for i, (v, w) in enumerate(rng.normal(0, deg / 40, (400, 2)))] + [(400 + i, 40.0, 10.0) for i in range(50)]
    b = [(f"g{i % 2}", 40.0 + deg * 0.98 + float(v), 10.0 + float(w)) for i, (v, w) in enumerate(rng.normal(0, deg / 40, (300, 2)))]
    la, lb = np.array([r[1:] for r in a]), np.array([r[1:] for r in b])
    p, q = np.radians(la[:, None]), np.radians(lb[None])
    h = np.sin((q[..., 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q[..., 1] - p[..., 1]) / 2) ** 2
    near = 2 * 6371008.8 * np.arcsin(np.sqrt(h)) <= 1000
    want = sorted({(a[i][0], b[j][0]) for i, j in zip(*np.nonzero(near))})
    left, right = spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "g string, lat double, lon double")
    for few in (8, 256, 10**9):
        assert sorted(tuple(r) for r in proximity.near_any(left, right, "id", "g", [("lat", "lon")], 1000.0, few).collect()) == want


def test_ranks_over_many_ranges(spark, monkeypatch):
    from terrasift.operators import profile

    monkeypatch.setattr(profile, "RANK_BLOCK", 50)
    rng = np.random.default_rng(1)
    v = np.round(rng.exponential(3, 2000), 2)
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)] + [(9, 1.0), (9, None), (9, float("nan"))], "k int, v double")
    got = {r.k: (r.a, r.b, r.c) for r in profile.exact_percentiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.977}).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(np.quantile(v[k::3], [0.01, 0.5, 0.977]))
    assert got[9] == (1.0, 1.0, 1.0)


def test_finish_of_zero_and_repeated_amounts(spark):
    bins = spark.createDataFrame([(1, b, 60.0 * b, 60.0 * b + 60, 0.5, 30.0 * b, 30.0 * b + 30) for b in range(4)], "mission_id int, bin int, t0 double, t1 double, rate double, lo double, hi double")
    q = spark.createDataFrame([(1, 0.0), (1, 15.0), (1, 15.0), (1, 30.0), (1, 130.0)], "mission_id int, target_s double")
    got = sorted((r.target_s, r.finish_s) for r in paths.finish_times(q, bins).collect())
    assert got == [(0.0, 0.0), (15.0, 30.0), (15.0, 30.0), (30.0, 60.0), (130.0, 260.0)]


def test_steps_past_the_last_frame_meet_it(spark):
    path = [(1, "a", 1, f, 5, 5, 0.5, 1.0) for f in (0, 1)]
    p = spark.createDataFrame(path, "mission_id int, scenario string, path_id int, frame_idx long, left_cell int, right_cell int, fraction double, weight double")
    steps = spark.createDataFrame([(1, 1, 900.0, 960.0, [5], [5])], "mission_id int, plan_id int, arrive_s double, leave_s double, cells_a array<int>, cells_b array<int>")
    assert [r.effort > 0 for r in paths.exposure(p, steps).collect()] == [True]


def test_tiny_scores_keep_their_order(spark):
    z = spark.createDataFrame([(1, 3, 2e-14), (1, 5, 3e-14), (1, 7, 0.0)], "mission_id int, zone_id long, score double")
    got = {r.zone_id: r["rank"] for r in mass.rank_zones(z).collect()}
    assert got[5] == 1 and got[3] == 2 and got[7] > 2


def test_groups_over_folds(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 3)], "g string, fold int")
    assert [r.g for r in models.split_groups(rows, "g").collect()] == ["b"]


def test_half_written_tables_are_not_published(spark):
    root = shared_dir(spark, "publish-test")
    df = spark.range(10).withColumnRenamed("id", "n")
    digest = sinks.publish(df, root, "t")
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/t/digest={digest}/_SUCCESS")
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, False)
    assert sinks.publish(df, root, "t") == digest
    assert sinks.published(spark, root, "t").count() == 10


def test_quota_without_a_cap(spark):
    n = 10_000_000_000
    rows = spark.createDataFrame([(1, 0, n), (1, 1, 3)], "mission_id long, pos long, n long")
    assert {r.pos: r.quota for r in paths.quota(rows, n).collect()} == {0: n - 3, 1: 3}


def test_travel_time_without_a_cutoff(spark):

    edges = spark.createDataFrame([(1, i + 1, i, 400.0) for i in range(6)] + [(1, 9, 8, 1.0)], "window_id long, src long, dst long, seconds double")
    seeds = spark.createDataFrame([(1, 0)], "window_id long, cell long")
    assert sorted((r["cell"], r["seconds"]) for r in graph.travel_time(edges, seeds).collect()) == [(i, 400.0 * i) for i in range(7)]
    assert sorted(r["cell"] for r in graph.travel_time(edges, seeds, 600.0).collect()) == [0, 1]


def test_travel_time_over_many_tiles_is_dijkstras(spark):
    import heapq
    import random

    rng = random.Random(6)
    cells = [(r, c) for r in range(22) for c in range(30) if rng.random() < 0.85]
    arcs = [(r * 512 + c, (r + dr) * 512 + c + dc, rng.uniform(1, 9)) for r, c in cells for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0) and (r + dr, c + dc) in set(cells)]
    starts = [cells[3][0] * 512 + cells[3][1], 511 * 512 + 511]  # one cell without arcs
    out = {}
    for a, b, s in arcs:
        out.setdefault(b, []).append((a, s))
    best, todo = {}, [(0.0, s) for s in starts]
    while todo:
        t, c = heapq.heappop(todo)
        if c not in best:
            best[c] = t
            for a, s in out.get(c, []):
                heapq.heappush(todo, (t + s, a))
    edges = spark.createDataFrame([(w, *a) for w in (0, 1) for a in arcs], "window_id long, src long, dst long, seconds double")
    seeds = spark.createDataFrame([(0, s) for s in starts] + [(0, starts[0])], "window_id long, cell long")
    for side in (4, 7, 64):
        got = {(r.window_id, r.cell): r.seconds for r in graph.travel_time(edges, seeds, side=side).collect()}
        assert got == pytest.approx({(0, c): t for c, t in best.items()})
    near = {(r.window_id, r.cell) for r in graph.travel_time(edges, seeds, 20.0, side=4).collect()}
    assert near == {(0, c) for c, t in best.items() if t <= 20.0}
    assert graph.travel_time(edges, seeds.where("cell < 0")).collect() == []


def test_exposure_of_many_groups_is_the_plain_join(spark, monkeypatch):
    import random

    from terrasift.operators import exposure as X

    rng = random.Random(2)
    p = [(m, s, i, f, rng.random(), rng.randrange(12), rng.randrange(12), rng.choice([0.0, 0.25, 1.0])) for m in (0, 1) for s in ("a", "b") for i in range(40) for f in range(rng.randint(1, 5))]
    steps = [(rng.randrange(3), rng.randrange(4), float(t), t + 9.0, [rng.randrange(12), -1], [rng.randrange(12)]) for t in range(90)]
    last = {m: max(r[3] for r in p if r[0] == m) for m in (0, 1)}
    effort = {}
    for m, plan, a, b, ca, cb in steps:
        if m in last:
            frame = min(int(np.ceil((a + b) / 2 / 15 - 0.5)), last[m])
            for c in [x for x in ca + cb if x >= 0]:
                effort[m, plan, frame, c] = effort.get((m, plan, frame, c), 0) + 1 / 60
    want = {}
    for m, s, i, f, _, lo, hi, fr in p:
        for c, share in ((lo, 1 - fr), (hi, fr)):
            for plan in range(4):
                if (m, plan, f, c) in effort:
                    want[m, plan, s, i] = want.get((m, plan, s, i), 0) + share * effort[m, plan, f, c]
    pd_ = spark.createDataFrame(p, "mission_id long, scenario string, path_id long, frame_idx int, weight double, left_cell long, right_cell long, fraction double")
    sd = spark.createDataFrame(steps, "mission_id long, plan_id long, arrive_s double, leave_s double, cells_a array<long>, cells_b array<long>")
    held = spark.createDataFrame([(0, "a", 1, 2.5)], "mission_id long, scenario string, path_id long, effort double")
    monkeypatch.setattr(X, "POSITIONS", 30)
    monkeypatch.setattr(X, "CHUNK", 5)
    got = paths.exposure(pd_, sd, assigned=held).collect()
    assert {(r.mission_id, r.plan_id, r.scenario, r.path_id): r.effort for r in got} == pytest.approx(want) and len(got) == len(want)
    assert all(r.old == (2.5 if (r.mission_id, r.scenario, r.path_id) == (0, "a", 1) else 0.0) for r in got)
