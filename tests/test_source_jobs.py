"""Registered source queries do their whole job: every row, spread over tasks."""

import json

import pytest
from pyspark.sql import functions as F

from terrasift.plans import adapters as A
from terrasift.plans import catalog
from terrasift.sources import readers as RD
from terrasift.sources import sinks as SK


def test_every_facility_is_scanned(spark, sf):
    got = {r.category: r.n for r in catalog.QUERIES["s6_osm_scan"](spark, sf).collect()}
    kinds = [k for k, _, _ in A.POI_TAGS]
    assert len(got) == 5 and sum(got.values()) == spark.read.parquet(f"{sf}/part.parquet").where(f"p_type in {tuple(kinds)}").count()


def test_off_grid_facilities_are_dropped_on_request(spark, tmp_path):
    nodes = [{"type": "node", "id": i, "lat": lat, "lon": 126.3, "tags": {"amenity": "cafe"}} for i, lat in enumerate((33.4, 35.1))]
    (tmp_path / "o.json").write_text(json.dumps({"elements": nodes}))
    path = str(tmp_path / "o.json")
    assert RD.read_osm(spark, path)[0].count() == 2
    assert [r.osm_id for r in RD.read_osm(spark, path, on_grid=lambda lon, lat: lat.between(33.0, 33.67))[0].collect()] == ["node/0"]


def test_small_files_are_dealt_over_tasks(spark, tmp_path):
    rows = spark.range(120).select((F.col("id") % 40).alias("k"), (-F.col("id")).alias("at"), F.col("id").cast("string").alias("value"))
    out = str(tmp_path / "files")
    SK.write_files(rows, out, "k", "at")
    parts = sorted((tmp_path / "files").glob("k=*/part-*.txt"))
    assert len(parts) == 40 and len({p.name.split("-")[1] for p in parts}) == 4  # a file a key, from every task
    assert [p.read_text() for p in parts if p.parent.name == "k=7"] == ["87\n47\n7\n"]


def test_a_key_has_one_file_when_lines_come_from_a_union_of_joined_rows(spark, tmp_path):
    """A join that turns into a broadcast one while it runs must not spread a document over tasks."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.shuffle.partitions": "24"}
    old = {c: spark.conf.get(c, None) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        pts = spark.range(60_000).select((F.col("id") % 97).alias("k"), F.col("id").alias("at"))
        n = pts.groupBy("k").agg(F.max("at").alias("last"))
        body = pts.join(n, "k").select("k", "at", F.col("at").cast("string").alias("value"))
        first = n.select("k", F.lit(-1).cast("bigint").alias("at"), F.lit("first").alias("value"))
        end = n.select("k", (F.col("last") + 1).alias("at"), F.lit("last").alias("value"))
        SK.write_files(body.unionByName(first).unionByName(end), str(tmp_path / "files"), "k", "at")
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    parts = sorted((tmp_path / "files").glob("k=*/part-*.txt"))
    assert len(parts) == 97 and [p.read_text().split() for p in parts if p.parent.name == "k=5"] == [["first", *map(str, range(5, 60_000, 97)), "last"]]


def test_files_are_written_as_spark_writes_them(spark, tmp_path, monkeypatch):
    keys = [None, "", "a=b/c", "x y", "50%", "é[1]", *map(str, range(30))]
    rows = [(k, i, None if i % 7 == 3 else f"{i} ü" * (i % 4)) for k in keys for i in range(50)]
    df = spark.createDataFrame(rows, "k string, at int, value string")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "64")  # a document runs over batches
    try:
        SK.write_files(df, str(tmp_path / "here"), "k", "at")
    finally:
        spark.conf.set(conf, old)
    with pytest.raises(Exception):
        SK.write_files(df, str(tmp_path / "here"), "k", "at")
    monkeypatch.setattr(SK, "_local_folder", lambda spark, path: None)
    SK.write_files(df, str(tmp_path / "there"), "k", "at")
    content = lambda d: {p.parent.name: (p.read_bytes()) for p in (tmp_path / d).glob("k=*/*") if not p.name.startswith(".")}
    assert content("here") and content("here") == content("there")
    assert not [p for p in (tmp_path / "here").glob("k=*/.*")]


def test_many_files_are_listed_in_few_tasks(spark, tmp_path):
    t = "2024-01-01T00:00:{:02d}Z"
    for i in range(60):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "t.gpx").write_text("<gpx><trk><trkseg>" + "".join(f'<trkpt lat="33.{j}" lon="126.2"><time>{t.format(j)}</time></trkpt>' for j in range(3)) + "</trkseg></trk></gpx>")
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("gpx-listing", "")
    try:
        fixes, rejects = RD.read_gpx(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [s.numTasks for j in tracker.getJobIdsForGroup("gpx-listing") for i in tracker.getJobInfo(j).stageIds if (s := tracker.getStageInfo(i)) and "load" in s.name]
    assert tasks and max(tasks) <= 4
    assert fixes.count() == 180 and rejects.count() == 0
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
