import json

import pytest
from pyspark.sql import functions as F

from terrasift.operators import state as ST
from terrasift.session import shared_dir
from terrasift.sources import readers as RD
from terrasift.sources import sinks as SK
from terrasift.streaming import streams as SM

GPX = '<?xml version="1.0"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk>{}</trk></gpx>'


def seg(*pts):
    return "<trkseg>" + "".join(f'<trkpt lat="{a}" lon="{o}">{"<time>" + t + "</time>" if t else ""}</trkpt>' for a, o, t in pts) + "</trkseg>"


def test_gpx_rules(spark, tmp_path):
    t = "2024-01-01T00:00:{:02d}Z"
    good = [(33.4, 126.2, t.format(0)), (33.41, 126.21, "2024-01-01T09:00:10+09:00")]
    files = {
        "good": seg(*good) + seg((33.0, 126.0, t.format(5))),
        "naive": seg(good[0], (33.4, 126.2, "2024-01-01T00:00:20")),
        "missing": seg(good[0], (33.4, 126.2, "")),
        "back": seg(good[0], (33.4, 126.2, t.format(0))),
        "single": seg(good[0]),
        "range": seg(good[0], (95, 126.2, t.format(9))),
    }
    for n, body in files.items():
        (tmp_path / f"{n}.gpx").write_text(GPX.format(body))
    (tmp_path / "broken.gpx").write_text("not xml at all")
    fixes, rejects = RD.read_gpx(spark, str(tmp_path))
    name = lambda r: r.file.rsplit("/", 1)[-1].split(".")[0]
    got = sorted((name(r), r.point_no) for r in fixes.collect())
    assert got == [("good", 0), ("good", 1)]
    assert {name(r): r.reason for r in rejects.collect()} == {
        "naive": "INVALID_POINT", "missing": "INVALID_POINT", "back": "TIME_NOT_INCREASING", "single": "POINT_COUNT", "range": "INVALID_POINT", "broken": "NOT_READABLE"}


def test_plt_and_labels(spark, tmp_path):
    d = tmp_path / "007" / "Trajectory"
    d.mkdir(parents=True)
    head = "Geolife trajectory\nWGS 84\nAltitude is in Feet\nReserved 3\n0,2,255,My Track,0,0,2,8421376\n0\n"
    (d / "a.plt").write_text(head + "39.9,116.3,0,492,39744.12,2008-10-23,02:53:04\n39.91,116.31,0,492,39744.13,2008-10-23,03:07:12\n")
    (tmp_path / "007" / "labels.txt").write_text("﻿Start Time\tEnd Time\tTransportation Mode\n2008/10/23 02:00:00\t2008/10/23 03:00:00\tWalk \n2008/10/23 05:00:00\t2008/10/23 04:00:00\tbus\n")
    labels, bad = RD.read_labels(spark, str(tmp_path))
    assert [(r.person, r.mode) for r in labels.collect()] == [("007", "walk")] and bad.count() == 1
    pts, rejects = RD.read_plt(spark, str(tmp_path), labels.where("mode = 'walk'"))
    assert [(p.person, p.line_no, p.lat, p.lon, p.excel_days) for p in pts.orderBy("lat").collect()] == [("007", 7, 39.9, 116.3, 39744.12), ("007", 8, 39.91, 116.31, 39744.13)]
    assert rejects.collect() == []


def test_broken_lines_of_a_split_file_keep_their_numbers(spark, tmp_path):
    d = tmp_path / "008" / "Trajectory"
    d.mkdir(parents=True)
    good = "39.9,116.3,0,492,39744.12,2008-10-23,02:53:04"
    lines = ["a,b,c,d,e,f,g"] * 6 + [good if i % 7 else ["39.9,116.3", "x,116.3,0,492,39744.12,2008-10-23,02:53:04"][i % 2] for i in range(900)]
    (d / "a.plt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        pts, rejects = RD.read_plt(spark, str(tmp_path))
        assert sorted(r.line_no for r in rejects.collect()) == [7 + i for i in range(0, 900, 7)]
        assert sorted(r.line_no for r in pts.collect()) == [7 + i for i in range(900) if i % 7]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_beyond_the_row_limit_have_a_row(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"y" * 11)
    got = {r.path[-5:]: (r.bytes, r.sha256, r.problem) for r in RD.fingerprint(spark, str(tmp_path), max_bytes=10).collect()}
    assert got == {"a.bin": (10, hashlib.sha256(b"x" * 10).hexdigest(), None), "b.bin": (11, None, "TOO_LARGE")}


def test_point_text_is_latitude_first(spark):
    df = spark.createDataFrame([("POINT (34.9 33.6)",), ("nothing",)], "geom string")
    assert [(r.latitude, r.longitude) for r in RD.parse_point(df).collect()] == [(34.9, 33.6), (None, None)]


def test_osm_and_links(spark, tmp_path):
    el = [{"type": "node", "id": 1, "lat": 33.4, "lon": 126.3, "tags": {"amenity": "cafe", "name": "A"}}, {"type": "way", "id": 2, "center": {"lat": 33.5, "lon": 126.4}, "tags": {"tourism": "hotel"}, "geometry": [{"lat": 1, "lon": 2}, {"lat": 1, "lon": 3}]},
          {"type": "node", "id": 3, "lat": 33.4, "lon": 126.3, "tags": {"office": "yes"}}, {"type": "way", "id": 4, "tags": {"shop": "supermarket"}}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": el}))
    poi, ways = RD.read_osm(spark, str(tmp_path / "o.json"))
    assert sorted((r.osm_id, r.category, r.coordinate_kind) for r in poi.collect()) == [("node/1", "food", "node"), ("way/2", "shelter", "geometry_center")]
    assert [r.id for r in ways.collect()] == [2]
    f = [{"attributes": {"OBJECTID": 1, "Lat": 37.0}, "geometry": {"paths": [[[0, 0], [1, 1]]]}}, {"attributes": {"OBJECTID": 1}}]
    (tmp_path / "l.json").write_text(json.dumps({"features": f}))
    links, dup = RD.read_feature_links(spark, str(tmp_path / "l.json"))
    assert sorted((r.n_paths, r.n_vertices) for r in links.collect()) == [(0, 0), (1, 2)] and dup.first().copies == 2


def test_terrain_scan_prunes_tiles(spark, tmp_path):
    c = spark.range(64 * 64).select(F.floor(F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), F.lit(1.0).cast("float").alias("dem"), F.lit(10).cast("smallint").alias("landcover"),
                                    F.lit(0.0).cast("float").alias("slope"), F.lit(0.0).cast("float").alias("road_distance"), F.lit(True).alias("on_road"))
    RD.write_terrain(c, str(tmp_path / "t"), tile=16)
    w = RD.read_terrain(spark, str(tmp_path / "t"), 16, 16, size=32, tile=16)
    assert w.count() == 32 * 32 and RD.terrain_gaps(w, 32, 32).first() == (1024, 1024, 0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = RD.read_terrain(spark, str(tmp_path / "t"), 16, 16, size=32, tile=16)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(tile_r,1)" in plan and "LessThanOrEqual(tile_c,2)" in plan  # bounds that files and row groups are skipped by


def test_manifest_problems(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, sha256 string")
    m = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, sha256 string")
    assert sorted((r.path, r.problem) for r in ST.verify(a, m).collect()) == [("w", "MISSING"), ("y", "CHANGED"), ("z", "EXTRA")]


def test_digest_ignores_layout_not_content(spark):
    d = spark.range(500).withColumn("v", F.col("id") * 2)
    dig = lambda x: SK.content_digest(x).first()[0]
    assert dig(d) == dig(d.orderBy(F.desc("id")).repartition(7).select("v", "id")) != dig(d.where("id <> 3"))
    assert dig(d) != dig(d.unionByName(d.limit(1)))


def test_version_chain_detects_tampering(spark):
    v = spark.createDataFrame([(1, 0, "genesis", "a"), (1, 1, "a", "b")], "mission_id bigint, number bigint, parent_hash string, hash string")
    new = spark.createDataFrame([(1, "E", "{}", "t"), (2, "E", "{}", "t")], "mission_id bigint, event string, evidence string, created_at string")
    n = SK.append_version(v, new).select("mission_id", "number", "parent_hash", "hash")
    both = v.unionByName(n)
    assert {r.mission_id: r.ok for r in ST.chain_ok(both).collect()} == {1: True, 2: True}
    bad = both.withColumn("hash", F.when((F.col("mission_id") == 1) & (F.col("number") == 1), "z").otherwise(F.col("hash")))
    assert {r.mission_id: r.broken for r in ST.chain_ok(bad).collect()} == {1: 1, 2: 0}


def test_evidence_bins_close_at_their_end(spark):
    t = [1, 31, 61, 91, 121]
    df = spark.createDataFrame([(v,) for v in t[1:]], "t bigint")
    assert sorted({r[0] for r in df.select(ST.bin_end(F.col("t"), F.lit(0))).collect()}) == [60, 120, 180]
    assert df.sparkSession.range(1).select(ST.bin_end(F.lit(60), F.lit(0))).first()[0] == 60


def source(spark, parts, schema):
    out = shared_dir(spark, "src")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(out)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(out)


def test_live_edges_carry_state_between_batches(spark):
    pts = [(1, i, 60 * i, 30 * i, 0) for i in range(6)]
    for cut in (1, 3):  # the result does not depend on how fixes fall into micro-batches
        e = SM.run_available(SM.live_edges(source(spark, [pts[:cut], pts[cut:]], "track_id bigint, seq bigint, t_s bigint, x_m bigint, y_m bigint")), "t")
        assert sorted((r.seq, r.dt, r.length, r.status) for r in e.collect()) == [(i, 60, 30, "admitted") for i in range(1, 6)]


def test_handed_over_is_final(spark):
    log = [[(1, 1, "PAUSED"), (1, 2, "PAUSED")], [(1, 3, "HANDED_OVER")], [(1, 4, "ACTIVE")]]
    s = SM.run_available(SM.mission_status(source(spark, log, "mission_id bigint, seq bigint, status string")), "t")
    assert sorted((r.seq, r.status) for r in s.collect()) == [(1, "PAUSED"), (3, "HANDED_OVER")]


def test_track_is_settled_once_across_batches(spark):
    schema = "mission_id bigint, track_id bigint, seq bigint, kind string, expected_version bigint"
    log = [[(1, 5, 1, "APPLY", 0), (1, 5, 2, "UPLOAD", 0)], [(1, 5, 3, "APPLY", 1), (1, 5, 4, "APPLY", 0)], [(1, 0, 5, "VERSION", 0), (1, 5, 6, "REJECT", 0)]]
    r = SM.run_available(SM.track_lifecycle(source(spark, log, schema)), "t")
    got = [(x.seq, x.outcome) for x in r.orderBy("seq").collect()]
    assert got == [(1, "UNKNOWN_TRACK"), (3, "VERSION_CONFLICT"), (4, "APPLIED"), (6, "ALREADY_PROCESSED")]
    flat = spark.createDataFrame(sum(log, []), schema)
    assert [(x.seq, x.outcome) for x in ST.track_lifecycle_batch(flat).orderBy("seq").collect()] == got
    assert [(x.seq, x.outcome) for x in ST.track_lifecycle_batch(flat, block=2).orderBy("seq").collect()] == got


def test_overdue_fires_without_new_checkins(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    log = [[(1, at(0), 300, False), (2, at(0), 300, True)], [(3, at(3600), 300, False)], [(3, at(3700), 300, False)]]
    r = SM.run_available(SM.overdue(source(spark, log, "member_id bigint, ts timestamp, interval_s int, revoked boolean")), "t")
    assert [x.member_id for x in r.collect()] == [1]


def test_effort_sum_is_independent_of_batch_order(spark):
    schema = "mission_id bigint, prev_row double, prev_col double, row double, col double, length double, status string, team_size bigint, spacing_m double"
    e = [(1, 100.0 + i, 100.0, 101.0 + i, 100.4, 32.3, "admitted", 1 + i % 2, 15.0) for i in range(6)]
    tot = []
    for parts in ([e[:2], e[2:]], [e[2:], e[:2]]):
        out, ck = shared_dir(spark, "o"), shared_dir(spark, "c")
        SM.running_coverage(source(spark, parts, schema), out, ck).awaitTermination()
        tot.append({(r.row, r.col): r.effort for r in SM.coverage_total(spark, out).collect()})
    assert tot[0].keys() == tot[1].keys() and all(tot[0][k] == pytest.approx(tot[1][k]) for k in tot[0])


def test_an_early_fix_refuses_its_track_in_every_batch(spark, tmp_path):
    parts = [[(1, 1, 50, 0), (2, 1, 50, 60)], [(1, 2, 90, 0), (2, 2, 70, 60), (3, 1, 5000, 0)], [(2, 3, 40, 60), (1, 3, 95, 0)], [(2, 4, 99, 60)]]
    src = source(spark, parts, "track_id bigint, seq bigint, t_s bigint, base_s bigint")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    SM.screen_late(src, good, bad, str(tmp_path / "ck"), horizon=1800).awaitTermination()
    used, refused = SM.screened(spark, good, bad)
    assert sorted((r.track_id, r.seq) for r in used.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert sorted((r.track_id, r.seq, r.reason) for r in refused.collect()) == [(2, k, "BEFORE_BASE_TIME") for k in (1, 2, 3, 4)]


class _Held:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.value, self.map, self.timers, self.calls = None, {}, set(), 0

    def _counted(self, result=None):
        self.calls += 1
        return result

    def get(self):
        return self._counted(self.value)

    def update(self, value):
        self.value = self._counted(value)

    def exists(self):
        return self._counted(self.value is not None)

    def getValue(self, key):
        return self._counted(self.map.get(key))

    def containsKey(self, key):
        return self._counted(key in self.map)

    def updateValue(self, key, value):
        self.map[key] = self._counted(value)

    def listTimers(self):
        return self._counted(sorted(self.timers))

    def registerTimer(self, ms):
        self._counted(self.timers.add(ms))

    def deleteTimer(self, ms):
        self._counted(self.timers.discard(ms))

    def getCurrentWatermarkInMs(self):
        return self.value


def test_lifecycle_reads_a_track_once_a_batch():
    import pandas as pd

    p = SM._Lifecycle()
    p.version, p.tracks = _Held(), _Held()
    n = 500
    rows = pd.DataFrame({"seq": range(2 * n), "track_id": [k % 4 for k in range(2 * n)], "kind": ["UPLOAD"] * n + ["REJECT"] * n, "expected_version": [0] * (2 * n)})
    out = pd.concat(p.handleInputRows((1,), iter([rows[:n]]), None))
    assert out.empty and p.tracks.map == {(k,): ("UPLOADED",) for k in range(4)}
    out = pd.concat(p.handleInputRows((1,), iter([rows[n:]]), None))
    assert out["outcome"].tolist() == ["REJECTED"] * 4 + ["ALREADY_PROCESSED"] * (n - 4)
    assert p.tracks.calls + p.version.calls <= 2 * (2 * 4 + 2)


def test_overdue_timer_moves_only_when_it_fires():
    import pandas as pd

    p, state, clock = SM._Overdue(), _Held(), _Held()
    p.handle, p.last = state, state
    rows = lambda *s: pd.DataFrame({"ts": pd.to_datetime(list(s), unit="s"), "interval_s": 10, "revoked": False})
    for s in ((5, 1), (7,), (9, 30)):
        assert sum(len(d) for d in p.handleInputRows((4,), iter([rows(*s)]), None)) == 0
    assert state.timers == {15001} and state.calls == 7

    def fire(now):
        clock.value, due = now, state.timers.pop()
        assert due <= now
        return [tuple(r) for d in p.handleExpiredTimer((4,), clock, None) for r in d.itertuples(index=False)]

    assert fire(20000) == [] and state.timers == {40001}
    assert fire(40001) == [(4, 30000, 40000)] and not state.timers
    list(p.handleInputRows((4,), iter([rows(50)]), None))
    assert state.timers == {60001}
