"""Queries that write the given tables in a source format, read them back through a scan and check every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, textfn
from ..operators import state as ST
from ..session import fan_out, shared_dir
from ..sources import readers as RD
from ..sources import sinks as SK
from . import adapters as A
from . import q_mass as QM
from . import q_state as QS
from .registry import query, table

BIG = "bigint"


@query("s1_gpx_scan", """SELECT file_key, CASE WHEN file_key%13=0 THEN 'INVALID_POINT' WHEN file_key%11=0 THEN 'TIME_NOT_INCREASING' ELSE 'OK' END AS verdict, CASE WHEN file_key%11=0 OR file_key%13=0 THEN 0 ELSE n END AS points FROM (SELECT user_id AS file_key, count(*) AS n FROM events GROUP BY 1)""")
def s1(spark, sf):
    """Tracks of the events table written as one GPX document each, then scanned."""
    e = F.col("event_id")
    pts = table(spark, sf, "events").select(F.col("user_id").alias("k"), e.alias("seq"), (F.lit(33.0) + e % 1000 / 5000.0).alias("lat"), (F.lit(126.0) + e % 700 / 5000.0).alias("lon"), (F.lit(1704067200) + e).alias("t"))
    n = pts.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))
    pts = pts.join(n, "k")
    t = F.when((F.col("k") % 11 == 0) & (F.col("seq") == F.col("last")), 1704067200).otherwise(F.col("t"))
    stamp = F.concat(F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss"), F.when((F.col("k") % 13 == 0) & (F.col("seq") == F.col("last")), "").otherwise("Z"))
    line = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('"><time>'), stamp, F.lit("</time></trkpt>"))
    # a line per point in order, between a first and a last line: no document is gathered
    first, end = n.select("k", F.lit(-1).cast(BIG).alias("seq"), F.lit("<gpx><trk><trkseg>").alias("value")), n.select("k", (F.col("last") + 1).alias("seq"), F.lit("</trkseg></trk></gpx>").alias("value"))
    doc = pts.select("k", F.col("seq").cast(BIG).alias("seq"), line.alias("value")).unionByName(first).unionByName(end)
    out = shared_dir(spark, "gpx")
    SK.write_files(doc.withColumnRenamed("k", "track"), out, "track", "seq")
    # part files have no .gpx suffix, so the scan is told to take any
    fixes, rejects = RD.read_gpx(spark, out, glob="part-*")
    key = lambda df: df.withColumn("file_key", F.regexp_extract("file", r"track=(\d+)", 1).cast(BIG))
    good = key(fixes).groupBy("file_key").agg(F.lit("OK").alias("verdict"), F.count(F.lit(1)).alias("points"))
    return good.unionByName(key(rejects).select("file_key", F.col("reason").alias("verdict"), F.lit(0).cast(BIG).alias("points")))


@query("s2_csv_scan", "SELECT count(*) AS n, round(sum(c_acctbal),2) AS total, max(c_name) AS last_name FROM customer")
def s2(spark, sf):
    out = shared_dir(spark, "csv")
    table(spark, sf, "customer").write.option("header", "true").csv(out)
    c = RD.read_csv(spark, out, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_name").alias("last_name"))


@query("s3_plt_scan", """SELECT person, count(*) FILTER (event_id%101<>0) AS n, round(sum(39.0+(event_id%1000)/1000.0::DOUBLE) FILTER (event_id%101<>0),4) AS lat_sum, sum(line_no) FILTER (event_id%101<>0)::BIGINT AS line_sum,
 count(*) FILTER (event_id%101=0) AS rejects, sum(line_no) FILTER (event_id%101=0)::BIGINT AS reject_lines FROM (SELECT user_id%20 AS person, event_id, 6+row_number() OVER (PARTITION BY user_id%20 ORDER BY event_id) AS line_no FROM events) WHERE person%4<>0 GROUP BY 1""")
def s3(spark, sf):
    """A trajectory file per person with six header lines and some broken lines; only people with a walk label are kept."""
    e = F.col("event_id")
    broken = e % 101 == 0
    row = F.concat_ws(",", F.when(broken, "n/a").otherwise((F.lit(39.0) + e % 1000 / 1000.0).cast("string")), F.lit("116.3"), F.lit("0"), F.lit("100"), (F.lit(39744.0) + e / 86400.0).cast("string"), F.lit("2008-10-23"), F.when(e % 202 != 0, "02:53:04"))
    lines = table(spark, sf, "events").select((F.col("user_id") % 20).alias("person"), e.alias("at"), row.alias("value"))
    header = ("Geolife trajectory", "WGS 84", "Altitude is in Feet", "Reserved 3", "0,2,255,My Track,0,0,2,8421376", "0")
    head = lines.select("person").distinct().select("person", F.posexplode(F.array(*[F.lit(h) for h in header])).alias("at", "value")).withColumn("at", F.col("at") - 100)
    out = shared_dir(spark, "plt")
    lines.unionByName(head).repartition("person").sortWithinPartitions("person", "at").select("person", "value").write.partitionBy("person").text(out)
    eligible = lines.select("person").distinct().where("person % 4 <> 0").select(F.col("person").cast("string").alias("person"))
    points, rejects = RD.read_plt(spark, out, eligible, glob="part-*", person=r"person=(\d+)")
    p = points.groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 4).alias("lat_sum"), F.sum("line_no").alias("line_sum"))
    r = rejects.groupBy("person").agg(F.count(F.lit(1)).alias("rejects"), F.sum("line_no").alias("reject_lines"))
    return p.join(r, "person", "left").fillna(0, ["rejects"]).withColumn("person", F.col("person").cast(BIG))


@query("s4_label_scan", "SELECT mode, count(*) AS n FROM (SELECT CASE WHEN o_custkey%3=0 THEN 'walk' ELSE 'bus' END AS mode FROM orders WHERE o_orderkey%10<>0) GROUP BY 1")
def s4(spark, sf):
    o = F.col("o_orderkey")
    ts = lambda s: F.date_format(F.timestamp_seconds(F.lit(1200000000) + o * 100 + s), "yyyy/MM/dd HH:mm:ss")
    bad = o % 10 == 0
    line = F.concat_ws("\t", ts(F.when(bad, 60).otherwise(0)), ts(F.when(bad, 0).otherwise(60)), F.when(F.col("o_custkey") % 3 == 0, "Walk").otherwise("bus"))
    out = shared_dir(spark, "labels")
    lines = table(spark, sf, "orders").select(line.alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("﻿Start Time\tEnd Time\tTransportation Mode").alias("value"))).write.text(out)
    labels, _ = RD.read_labels(spark, out, glob="part-*")
    return labels.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("s5_feature_links", """SELECT count(*) AS n, count(*) FILTER (lon_a IS NULL) AS missing, round(sum(lat_a),4) AS lat_sum, 0::BIGINT AS duplicate_ids FROM endpoint_links""")
def s5(spark, sf):
    l = A.endpoint_links(spark, sf)
    attrs = F.struct(F.col("objectid").alias("OBJECTID"), F.col("case_a").cast("string").alias("CaseNumb"), F.col("lat_a").alias("Lat"), F.col("lon_a").alias("Long"), F.col("lat_b").alias("Lat_1"), F.col("lon_b").alias("Long_1"))
    out = shared_dir(spark, "links")
    l.select(F.array(F.struct(attrs.alias("attributes"))).alias("features")).write.json(out)
    links, dup = RD.read_feature_links(spark, out, multiline=False)
    s = links.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("Long").isNull()).alias("missing"), F.round(F.sum("Lat"), 4).alias("lat_sum"))
    from ..operators.models import _one_row

    return _one_row(s, dup.agg(F.count(F.lit(1)).alias("duplicate_ids")))


@query("s6_osm_scan", "SELECT category, count(*) AS n FROM poi WHERE category IS NOT NULL GROUP BY 1")
def s6(spark, sf):
    p = A.poi(spark, sf).select(
        F.lit("node").alias("type"), F.regexp_extract("osm_id", r"(\d+)$", 1).cast(BIG).alias("id"), F.lit(33.4).alias("lat"), F.when(F.col("row") < 30, F.lit(126.3)).alias("lon"),
        F.when(F.col("row") >= 30, F.struct(F.lit(33.4).alias("lat"), F.lit(126.3).alias("lon"))).alias("center"), "tags")
    out = shared_dir(spark, "osm")
    p.select(F.array(F.struct(*p.columns)).alias("elements")).write.json(out)
    poi, _ = RD.read_osm(spark, out, multiline=False)
    return poi.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("s7_terrain_window", """SELECT count(*) AS n, round(sum(dem),2) AS dem_sum, 1024::BIGINT AS expected, 0::BIGINT AS incomplete FROM terrain WHERE window_id=0 AND "row" BETWEEN 16 AND 47 AND col BETWEEN 16 AND 47""")
def s7(spark, sf):
    """Terrain written by tile; a window scan reads only its tiles."""
    t = A.terrain(spark, sf)
    cells = t.select(
        (F.col("window_id") * 64 + F.col("row")).cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("dem").cast("float").alias("dem"), F.col("landcover").cast("smallint").alias("landcover"),
        F.col("slope").cast("float").alias("slope"), F.col("road_distance").cast("float").alias("road_distance"), (F.col("road_distance") < 30).alias("on_road"))
    out = shared_dir(spark, "terrain")
    RD.write_terrain(cells, out, tile=16)
    window = RD.read_terrain(spark, out, 16, 16, size=32, tile=16)
    gaps = RD.terrain_gaps(window, 32, 32).select("expected", "incomplete")
    from ..operators.models import _one_row

    return _one_row(window.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dem"), 2).alias("dem_sum")), gaps)


@query("s8_point_text", "SELECT incident_index, round(ipp_lat,6) AS latitude, round(ipp_lon,6) AS longitude FROM incidents")
def s8(spark, sf):
    i = A.incidents(spark, sf).select("incident_index", F.concat(F.lit("POINT ("), F.round("ipp_lat", 6).cast("string"), F.lit(" "), F.round("ipp_lon", 6).cast("string"), F.lit(")")).alias("geom"))
    return RD.parse_point(i).select("incident_index", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("s9_fingerprint", """SELECT s_suppkey AS k, octet_length(encode(t))::BIGINT AS bytes, sha256(t) AS sha256, md5(t) AS md5 FROM (SELECT s_suppkey, s_name||'|'||s_nationkey||chr(10) AS t FROM supplier)""")
def s9(spark, sf):
    """Size and hashes of files, one written for each supplier."""
    s = table(spark, sf, "supplier")
    out = shared_dir(spark, "fingerprint")
    SK.write_files(s.select(F.col("s_suppkey").alias("k"), F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")).alias("value")), out, "k")
    files = RD.fingerprint(spark, out).where(F.col("path").contains("/k="))
    return files.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast(BIG).alias("k"), "bytes", "sha256", "md5")


@query("s9_text_fingerprint", "SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def s9t(spark, sf):
    """Size and hashes of every whole document text."""
    return RD.row_fingerprint(table(spark, sf, "documents"), ["doc_id"], "text")


@query("s10_model_scan", "SELECT c_custkey::VARCHAR AS model, (c_custkey%9)::DOUBLE AS s, 1000.0::DOUBLE+c_custkey AS scale FROM customer WHERE c_custkey%9>0 AND c_custkey%7<>0")
def s10(spark, sf):
    k = F.col("c_custkey")
    params = F.array((k % 9).cast("double"), F.when(k % 7 == 0, 1.0).otherwise(0.0), 1000.0 + k)
    out = shared_dir(spark, "models")
    table(spark, sf, "customer").select(F.lit("endpoint_distance").alias("kind"), F.create_map(k.cast("string"), F.struct(params.alias("params"))).alias("models")).write.json(out)
    return RD.read_model(spark, out, multiline=False).select("model", "s", "scale")


@query("k1_zones_geojson", "SELECT mission_id, zone_id, label, access FROM zones")
def k1(spark, sf):
    out = shared_dir(spark, "geojson")
    z = QM.zones(spark, sf).select("mission_id", "zone_id", "label", "access", "rank")
    SK.write_zones_geojson(z, out, 240000.0, 3700000.0)
    back = spark.read.text(out)
    get = lambda p: F.get_json_object("value", "$.properties." + p)
    return back.select(F.col("mission_id").cast(BIG).alias("mission_id"), get("zone_id").cast(BIG).alias("zone_id"), get("label").alias("label"), get("access").alias("access"))


@query("k2_zones_csv", 'SELECT mission_id, label AS zone, round(poa1,8) AS "POA", access FROM zones')
def k2(spark, sf):
    out = shared_dir(spark, "zones-csv")
    SK.write_zones_csv(QM.zones(spark, sf), out)
    back = spark.read.schema("zone string, POA double, POD_low_assumption double, POD_high_assumption double, POS double, access string, mission_id bigint").option("header", "true").csv(out)
    return back.select("mission_id", "zone", F.round("POA", 8).alias("POA"), "access")


@query("k3_prepared_table", "SELECT count(*) AS n, count(*) FILTER (dt=0) AS no_speed, round(sum(dist),3) AS dist_m FROM pairs")
def k3(spark, sf):
    from . import q_tracks as Q

    out = shared_dir(spark, "prepared")
    e = Q.edges(spark, sf).select("track_id", "seq", "dt", "dist", F.when(F.col("dt") == 0, float("inf")).otherwise(F.col("speed")).alias("speed"))
    SK.write_prepared(e, out)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("speed").isNull()).alias("no_speed"), F.round(F.sum("dist"), 3).alias("dist_m"))


@query("k4_publish", "SELECT count(*) AS n, true AS same_digest, false AS changed_digest_equal FROM part")
def k4(spark, sf):
    """Publishing the same rows in another layout gives the same digest; a changed row gives another."""
    from ..operators.models import _one_row

    out = shared_dir(spark, "publish")
    p = table(spark, sf, "part")
    a = SK.publish(p, out, "part")
    b = SK.publish(fan_out(p, "p_name"), out, "part")
    c = SK.content_digest(p.withColumn("p_size", F.when(F.col("p_partkey") == 1, -1).otherwise(F.col("p_size")))).first()[0]
    n = SK.published(spark, out, "part").agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.lit(a == b).alias("same_digest"), F.lit(a == c).alias("changed_digest_equal"))


@query("k5_append_version", "SELECT mission_id, max(number)::BIGINT+1 AS number, arg_max(hash, number) AS parent_hash, true AS chained FROM log_versions GROUP BY 1")
def k5(spark, sf):
    v = QS.versions(spark, sf, QS.mission_block(spark, sf))
    new = v.select("mission_id").distinct().select("mission_id", F.lit("COMPLETED_NO_FIND").alias("event"), F.lit("{}").alias("evidence"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    return SK.append_version(v, new).select("mission_id", "number", "parent_hash", (F.length("hash") == 64).alias("chained"))


@query("k6_manifest", """SELECT s_suppkey AS k, CASE WHEN s_suppkey%7=0 THEN 'MISSING' ELSE 'CHANGED' END AS problem FROM supplier WHERE s_suppkey%7=0 OR s_suppkey%5=0 UNION ALL SELECT s_suppkey+1000000000, 'EXTRA' FROM supplier WHERE s_suppkey%11=0""")
def k6(spark, sf):
    """A manifest is written with its files; another copy of the files has missing, changed and further ones."""
    out, record, other = (shared_dir(spark, p) for p in ("package", "manifest", "copy"))
    k = F.col("s_suppkey")
    files = table(spark, sf, "supplier").select(k.alias("k"), F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")).alias("value"))
    SK.write_files(files, out, "k")
    SK.write_manifest(spark, out, record, r"/(k=\d+)/")
    copy = files.where("k % 7 <> 0").withColumn("value", F.when(F.col("k") % 5 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    more = files.where("k % 11 = 0").withColumn("k", F.col("k") + 1_000_000_000)
    SK.write_files(copy.unionByName(more), other, "k")
    found = ST.verify(SK.manifest(spark, other, r"/(k=\d+)/").where("name <> ''"), SK.read_manifest(spark, record).where("name <> ''"), "name")
    return found.select(F.regexp_extract("name", r"k=(\d+)", 1).cast(BIG).alias("k"), "problem")
