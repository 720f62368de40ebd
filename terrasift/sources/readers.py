"""Typed scans. Every schema is explicit; bad input is set aside with a reason, not guessed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, timefn
from ..session import cut_lineage

MIN_POINTS = 2

GPX_SCHEMA = (
    "trk array<struct<trkseg:array<struct<trkpt:array<struct<_lat:double,_lon:double,time:string>>>>>>"
)


ROW_BYTES = (1 << 31) - (1 << 20)  # what one binary value can hold


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders of a load are listed in no more tasks than a shuffle has; Spark's default is a task for each of 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fingerprint(spark: SparkSession, path: str, max_bytes: int = ROW_BYTES) -> DataFrame:
    """Size, SHA-256 and MD5 of every file below a path; the bytes stay on the executors.

    A file beyond ``max_bytes`` is not read: its row has its size, no hashes and ``TOO_LARGE`` as its problem.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= max_bytes)  # a filter of the scan: other files are not opened
    none = F.lit(None).cast("string")
    out = small.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), none.alias("problem"))
    large = files.select("path", "length").where(F.col("length") > max_bytes)
    return out.unionByName(large.select("path", F.col("length").alias("bytes"), none.alias("sha256"), none.alias("md5"), F.lit("TOO_LARGE").alias("problem")))


def row_fingerprint(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Bytes, SHA-256 and MD5 of a text column by row; a missing text has no hashes."""
    return df.select(*keys, F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"))


def numbered_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """value, file and line_no (from 1) of text files; a long file is read and numbered in several tasks.

    Lines are numbered inside the piece of a file that one task reads; the pieces before it add their counts.
    """
    t = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    t = t.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    inner = t.withColumn("__n", F.row_number().over(W.partitionBy("file", "__at").orderBy("__id")))
    pieces = t.groupBy("file", "__at").agg(F.count(F.lit(1)).alias("__lines"))
    before = F.coalesce(F.sum("__lines").over(W.partitionBy("file").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per piece
    return inner.join(pieces.select("file", "__at", before.alias("__off")), ["file", "__at"]).select("value", "file", (F.col("__n") + F.col("__off")).cast("bigint").alias("line_no"))


def read_gpx(spark: SparkSession, path: str, glob: str = "*.gpx", max_bytes: int | None = None, max_points: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(fixes, rejects) of GPX files.

    A file is refused as a whole when it is not readable, has a point without a valid position or an
    instant with an offset, has times that do not increase inside a segment, or has fewer than 2 points.
    Segments of one point are dropped before counting. An upload rule may set ``max_bytes`` and
    ``max_points``: files beyond them are refused with a reason too. Without, a file may be of any size
    that one row can hold.
    """
    files = lambda fmt: spark.read.format(fmt).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    with few_listing_tasks(spark):  # files are listed as they are loaded, before any scan
        raw = files("xml").option("rowTag", "gpx").option("mode", "PERMISSIVE").schema(GPX_SCHEMA).load(path)
        listing = files("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    if max_bytes is not None:  # refused below and never unfolded
        raw = raw.where(F.col("_metadata.file_size") <= max_bytes)
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    segs = raw.select("file", F.posexplode("trk").alias("trk_no", "t")).select("file", "trk_no", F.posexplode("t.trkseg").alias("seg_no", "s"))
    segs = segs.where(F.size("s.trkpt") > 0).withColumn("many", F.size("s.trkpt") > 1)
    pts = segs.select("file", "many", (F.col("trk_no") * 1_000_000 + F.col("seg_no")).cast("bigint").alias("segment_no"), F.posexplode("s.trkpt").alias("point_no", "p"))
    ts = timefn.parse_aware("p.time")
    pts = pts.select("file", "many", "segment_no", "point_no", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), ts.alias("ts"))
    bad = F.col("lon").isNull() | F.col("lat").isNull() | F.isnan("lon") | F.isnan("lat") | ~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90) | F.col("ts").isNull()
    from pyspark.sql import Window as W

    prev = F.lag("ts").over(W.partitionBy("file", "segment_no").orderBy("point_no"))
    pts = pts.withColumn("bad", bad).withColumn("back", F.col("many") & F.coalesce(F.col("ts") <= prev, F.lit(False)))
    pts = cut_lineage(pts, "gpx-points")  # files are opened and parsed once
    kept = F.count_if("many")
    per = pts.groupBy("file").agg(kept.alias("points"), F.bool_or("bad").alias("bad"), F.bool_or("back").alias("back"))
    key = lambda c: F.regexp_replace(c, r"^file:/+", "/")  # the two scans write local paths differently
    verdict = listing.withColumn("k", key("file")).join(per.withColumn("k", key("file")).drop("file"), "k", "left")
    above = lambda c, most: F.lit(False) if most is None else F.col(c) > most
    reason = (
        F.when(above("length", max_bytes), "TOO_LARGE").when(F.col("points").isNull(), "NOT_READABLE").when(F.col("bad"), "INVALID_POINT")
        .when(F.col("back"), "TIME_NOT_INCREASING").when((F.col("points") < MIN_POINTS) | above("points", max_points), "POINT_COUNT"))
    verdict = cut_lineage(verdict.select("file", "k", reason.alias("reason")), "gpx-verdicts")  # for fixes and rejects
    good = verdict.where(F.col("reason").isNull()).select("k")
    fixes = pts.where("many").withColumn("k", key("file")).join(good, "k", "left_semi").select("file", "segment_no", "point_no", "lon", "lat", "ts")
    return fixes, verdict.where(F.col("reason").isNotNull()).select("file", "reason")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("sep", sep).option("enforceSchema", "false").csv(path)


SEARCHER_TRACKS = "search_type string, team_id bigint, searcher_id bigint, track_id string, time_s string, time_sec double, latitude double, longitude double, elevation_m bigint"
INCIDENT_ENDPOINTS = "incident_index bigint, IPP_lat double, IPP_lon double, find_lat double, find_lon double, straight_line_distance_m double, source_file string, row_kind string"


PLT_HEADER = 6


def read_plt(spark: SparkSession, path: str, eligible: DataFrame | None = None, glob: str = "*.plt", person: str = r"/([^/]+)/Trajectory/[^/]+$") -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of trajectory text files: six header lines, then lat, lon, _, altitude, day number, date, time.

    Lines are read as lines, so a long file splits over tasks; ``line_no`` is the line's place in its file.
    A data line without seven fields or without numbers for position and day is a reject (person, file,
    line_no, value). ``eligible`` keeps only the listed people.
    """
    t = numbered_lines(spark, path, glob).where((F.col("line_no") > PLT_HEADER) & (F.trim("value") != ""))
    t = t.withColumn("person", F.regexp_extract("file", person, 1))
    if eligible is not None:
        t = t.join(eligible.select("person"), "person", "left_semi")
    c = F.split("value", ",")
    num = lambda i: F.get(c, F.lit(i)).try_cast("double")
    points = t.select(
        "person", "file", "line_no", num(0).alias("lat"), num(1).alias("lon"), num(4).alias("excel_days"), F.concat_ws(" ", F.get(c, F.lit(5)), F.get(c, F.lit(6))).alias("text_time"), "value",
        (F.size(c) == 7).alias("__seven"))
    ok = F.col("__seven") & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("excel_days").isNotNull()
    return points.where(ok).drop("value", "__seven"), points.where(~ok).select("person", "file", "line_no", "value")


def read_labels(spark: SparkSession, path: str, glob: str = "labels.txt") -> tuple[DataFrame, DataFrame]:
    """(labels, rejects) of tab-separated start, end, mode files; a byte-order mark is tolerated."""
    t = spark.read.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    t = t.select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    c = F.split("value", "\t")
    t = t.where((F.trim("value") != "") & ~F.lower("value").startswith("start")).select(
        F.regexp_extract("file", r"/([^/]+)/labels\.txt$", 1).alias("person"), timefn.parse_label_stamp(c[0]).alias("start"), timefn.parse_label_stamp(F.get(c, F.lit(1))).alias("end"),
        F.lower(F.trim(F.get(c, F.lit(2)))).alias("mode"), "value")
    ok = F.coalesce(F.col("start") < F.col("end"), F.lit(False)) & F.col("mode").isNotNull()
    return t.where(ok).drop("value"), t.where(~ok).select("person", "value")


LINK_FIELDS = (
    "OBJECTID bigint, CaseNumb string, CaseNumb_1 string, Type string, Type_1 string, Lat double, Long double, Lat_1 double, Long_1 double, "
    "Georef_U double, Georef_U_1 double, DateTime bigint, DateTime_1 bigint, DateTime_2 bigint, DateTIme_3 bigint, TotalTim double, TotalSea double"
)


def read_feature_links(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links, duplicate object ids) of a feature-service response."""
    fields = ",".join(f"{n}:{t}" for n, t in (f.split() for f in LINK_FIELDS.split(", ")))
    schema = f"features array<struct<attributes:struct<{fields}>,geometry:struct<paths:array<array<array<double>>>>>>"
    j = spark.read.schema(schema).option("multiLine", multiline).json(path)
    f = j.select(F.explode("features").alias("f"))
    paths = F.coalesce(F.col("f.geometry.paths"), F.array().cast("array<array<array<double>>>"))
    links = f.select("f.attributes.*", F.size(paths).alias("n_paths"), F.size(F.flatten(paths)).alias("n_vertices"))
    dup = links.groupBy("OBJECTID").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return links, dup


OSM_SCHEMA = (
    "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
)


def read_osm(spark: SparkSession, path: str, multiline: bool = True, on_grid: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facilities, ways): classified points with a position, and ways with more than one vertex.

    ``on_grid`` tells from longitude and latitude whether a point lies on the master grid; others are dropped.
    """
    e = spark.read.schema(OSM_SCHEMA).option("multiLine", multiline).json(path).select(F.explode("elements").alias("e")).select("e.*")
    lon, lat = F.coalesce("center.lon", "lon"), F.coalesce("center.lat", "lat")
    poi = e.select(
        F.concat_ws("/", "type", "id").alias("osm_id"), geo.poi_category("tags").alias("category"), geo.poi_name("tags").alias("name"), F.coalesce(F.col("tags")["opening_hours"], F.lit("")).alias("opening_hours"),
        F.coalesce(F.col("tags")["access"], F.lit("unknown")).alias("access"), F.when(F.col("type") == "node", "node").otherwise("geometry_center").alias("coordinate_kind"), lon.alias("lon"), lat.alias("lat"),
    ).where(F.col("category").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    if on_grid is not None:
        poi = poi.where(F.coalesce(on_grid(F.col("lon"), F.col("lat")), F.lit(False)))
    ways = e.where((F.col("type") == "way") & (F.size("geometry") > 1)).select("id", "geometry", "tags").dropDuplicates(["id"])
    return poi, ways


TERRAIN_SCHEMA = "row int, col int, dem float, landcover smallint, slope float, road_distance float, on_road boolean, tile_r int, tile_c int"


def write_terrain(cells: DataFrame, path: str, tile: int = 64) -> None:
    """Terrain cells in the order of their tiles, so that a window reads the files and row groups of its own tiles only.

    Tiles are dealt by range; files hold many tiles each and carry the bounds of theirs.
    """
    t = cells.withColumn("tile_r", F.floor(F.col("row") / tile).cast("int")).withColumn("tile_c", F.floor(F.col("col") / tile).cast("int"))
    t.repartitionByRange("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "row", "col").write.mode("errorifexists").parquet(path)


def read_terrain(spark: SparkSession, path: str, row0: int | None = None, col0: int | None = None, size: int = 512, tile: int = 64) -> DataFrame:
    """Terrain cells; with an origin the tile bounds are filters of the scan, so other files and row groups are skipped."""
    t = spark.read.schema(TERRAIN_SCHEMA).parquet(path)
    if row0 is None:
        return t
    rng = lambda c, o: F.col(c).between(o // tile, (o + size - 1) // tile)
    return t.where(rng("tile_r", row0) & rng("tile_c", col0) & F.col("row").between(row0, row0 + size - 1) & F.col("col").between(col0, col0 + size - 1))


def terrain_gaps(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Shape check: expected cells, present cells, and cells that miss a layer."""
    layers = ["dem", "landcover", "slope", "road_distance"]
    missing = F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in layers]) == 1)
    return cells.agg(F.lit(rows * cols).cast("bigint").alias("expected"), F.count(F.lit(1)).alias("present"), missing.alias("incomplete"))


def parse_point(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Publisher text ``POINT (lat lon)``: latitude first. Rows that do not parse keep NULL coordinates."""
    pat = r"POINT\s*\(\s*([-\d.]+)\s+([-\d.]+)\s*\)"
    part = lambda i: F.nullif(F.regexp_extract(geom, pat, i), F.lit("")).try_cast("double")
    return df.withColumn("latitude", part(1)).withColumn("longitude", part(2)).withColumn("timezone_status", F.lit("NOT_SPECIFIED_IN_WORKBOOK"))


def read_model(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Distance models with valid parameters only: s > 0, loc = 0, scale > 0."""
    j = spark.read.schema("kind string, models map<string,struct<params:array<double>>>").option("multiLine", multiline).json(path)
    m = j.select(F.explode("models").alias("model", "m")).select("model", F.get("m.params", F.lit(0)).alias("s"), F.get("m.params", F.lit(1)).alias("loc"), F.get("m.params", F.lit(2)).alias("scale"))
    return m.where((F.col("s") > 0) & (F.col("loc") == 0) & (F.col("scale") > 0))
