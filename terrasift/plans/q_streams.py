"""Streaming queries run to completion over the given tables, checked against the batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import streams as SM
from . import adapters as A
from . import q_mass as QM
from . import q_state as QS
from .registry import query, table

R6 = lambda c: F.round(c, 6)
BIG = "bigint"


def stream_table(spark, sf, name):
    """A given table as a file stream; the schema comes from the table itself."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 1).parquet(sf)


def stream_of(spark, df, purpose, *keys, batches=3):
    """A derived table written in the session's partitions (whole ``keys`` in one file), read back in about three micro-batches."""
    out = shared_dir(spark, purpose)
    df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).write.parquet(out)
    return batches_of(spark, out, df.schema, batches)


def batches_of(spark, out, schema, batches=3):
    """The files below ``out`` as a stream of about so many micro-batches, whatever their number."""
    files = len(spark.read.schema(schema).parquet(out).inputFiles())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(out)


@query("t9_live_edges_stream", "SELECT status, count(*) AS n, round(sum(length),3) AS length_m FROM sweep_edges GROUP BY 1")
def t9(spark, sf):
    f = A.fixes(spark, sf, A.track_block(spark, sf)).select("track_id", "seq", "t_s", "x_m", "y_m")
    out = shared_dir(spark, "fixes-in")
    f.withColumn("part", F.floor(F.col("seq") / 4000 % 1000).cast("int")).write.parquet(out)
    src = spark.readStream.schema(f.schema).parquet(out)
    e = SM.run_available(SM.live_edges(src), "live-edges")
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 3).alias("length_m"))


@query("t6_mission_status_stream", "SELECT mission_id, CASE WHEN bool_or(status='HANDED_OVER') THEN 'HANDED_OVER' ELSE arg_max(status, seq) END AS status FROM (SELECT o_custkey//10 AS mission_id, o_orderkey AS seq, CASE WHEN o_orderkey%37=0 THEN 'HANDED_OVER' WHEN o_orderkey%2=0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status FROM orders) GROUP BY 1")
def t6(spark, sf):
    o = stream_table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 10).cast(BIG).alias("mission_id"), F.col("o_orderkey").alias("seq"), F.expr(QS._STAT).alias("status"))
    return SM.run_available(SM.mission_status(o), "status").groupBy("mission_id").agg(F.max_by("status", "seq").alias("status"))


@query("t5_track_lifecycle_stream", "SELECT outcome, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM (SELECT seq, CASE WHEN NOT known THEN 'UNKNOWN_TRACK' WHEN first<seq THEN 'ALREADY_PROCESSED' WHEN NOT valid THEN 'VERSION_CONFLICT' WHEN kind='APPLY' THEN 'APPLIED' ELSE 'REJECTED' END AS outcome FROM (SELECT *, min(CASE WHEN valid THEN seq END) OVER (PARTITION BY mission_id, track_id) AS first FROM track_attempts)) GROUP BY 1")
def t5(spark, sf):
    log = stream_table(spark, sf, "orders").select(
        F.floor(F.col("o_custkey") / 10).cast(BIG).alias("mission_id"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 7).alias("track_id"), F.expr(QS._KIND).alias("kind"), (F.col("o_custkey") % 4).alias("expected_version"))
    r = SM.run_available(SM.track_lifecycle(log), "lifecycle")
    return r.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq_sum"))


@query("t10_idempotent_stream", """SELECT outcome, count(*) AS n, count(*) FILTER (expired) AS expired FROM (SELECT CASE WHEN seq=f THEN 'CREATED' WHEN h=fh THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome, seq*2>f*2+120 AS expired FROM (SELECT *, min(seq) OVER w AS f, arg_min(h,seq) OVER w AS fh FROM
 (SELECT o_custkey%25 AS mission_id, o_custkey%400 AS request_key, o_orderkey AS seq, o_orderstatus AS h FROM orders) WINDOW w AS (PARTITION BY mission_id, request_key))) GROUP BY 1""")
def t10(spark, sf):
    r = stream_table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("mission_id"), (F.col("o_custkey") % 400).alias("request_key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("input_hash"), (F.col("o_orderkey") * 2).alias("t_s"))
    return SM.run_available(SM.idempotent(r), "idempotent").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("expired").alias("expired"))


@query("t4_dedupe_tracks_stream", "SELECT count(DISTINCT (o_custkey%25, o_custkey%200)) AS kept FROM orders")
def t4(spark, sf):
    u = stream_table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("mission_id"), F.sha2((F.col("o_custkey") % 200).cast("string"), 256).alias("geometry_sha"), F.col("o_orderkey").alias("upload_seq"))
    return SM.run_available(SM.dedupe_tracks(u), "dedupe").agg(F.count(F.lit(1)).alias("kept"))


@query("t1_evidence_stream", """SELECT mission_id, bin_end_s, count(*) AS cells, round(sum(effort)*15,6) AS intensity FROM (SELECT mission_id, bin_end_s, "row", col+k AS col, sum(effort*w) AS effort FROM bin_rows JOIN kernel_ USING (team_size) WHERE col+k BETWEEN 0 AND 511 GROUP BY 1,2,3,4) WHERE effort>0 GROUP BY 1,2""")
def t1(spark, sf):
    base = F.timestamp_seconds(F.lit(1704067200))
    e = QM.mission_edges(spark, sf).select(
        "mission_id", base.alias("base"), F.timestamp_seconds(F.lit(1704067200) + F.col("t_s")).alias("ts"), "prev_row", "prev_col", "row", "col", "length", "status", "team_size", "spacing_m")
    src = stream_of(spark, e, "edges-in")
    ev = SM.run_complete(SM.stream_evidence(src), "evidence").where("intensity > 0")
    return ev.groupBy("mission_id", "bin_end_s").agg(F.count(F.lit(1)).alias("cells"), R6(F.sum("intensity")).alias("intensity"))


@query("t2_screen_late_stream", "SELECT count(*) FILTER (early) AS quarantined, count(*) FILTER (NOT early AND ceil(age/60.0)*60<=1800) AS used FROM (SELECT *, bool_or(track_id%3=0 AND t_s<200) OVER (PARTITION BY track_id) AS early, t_s-CASE WHEN track_id%3=0 THEN 200 ELSE 0 END AS age FROM fixes)")
def t2(spark, sf):
    """Every third track starts before its base time and is refused whole, though its fixes come in several batches."""
    f = A.fixes(spark, sf, A.track_block(spark, sf)).select("track_id", "seq", "t_s", F.when(F.col("track_id") % 3 == 0, 200).otherwise(0).alias("base_s"))
    good, bad, ck = (shared_dir(spark, p) for p in ("good", "bad", "ck"))
    SM.screen_late(stream_of(spark, f, "late-in", "seq"), good, bad, ck, horizon=1800).awaitTermination()
    from ..operators.models import _one_row

    used, refused = SM.screened(spark, good, bad)
    return _one_row(refused.agg(F.count(F.lit(1)).alias("quarantined")), used.agg(F.count(F.lit(1)).alias("used")))


@query("t11_running_coverage_stream", """SELECT mission_id, count(*) AS cells, round(sum(effort),6) AS effort FROM effort GROUP BY 1""")
def t11(spark, sf):
    src = stream_of(spark, QM.mission_edges(spark, sf), "coverage-in")
    out, ck = shared_dir(spark, "coverage"), shared_dir(spark, "coverage-ck")
    SM.running_coverage(src, out, ck).awaitTermination()
    return SM.coverage_total(spark, out).groupBy("mission_id").agg(F.count(F.lit(1)).alias("cells"), R6(F.sum("effort")).alias("effort"))


@query("t3_shuffled_batches", """SELECT mission_id, count(*) AS cells, round(sum(effort),6) AS effort, true AS same_cells FROM effort GROUP BY 1""")
def t3(spark, sf):
    """Running coverage of the same edges in batches dealt in another way: the same cells and sums."""
    totals = []
    for k, keys in enumerate((["row"], ["col", "t_s"])):
        src = stream_of(spark, QM.mission_edges(spark, sf), f"shuffled-in-{k}", *keys)
        out, ck = shared_dir(spark, "shuffled"), shared_dir(spark, "shuffled-ck")
        SM.running_coverage(src, out, ck).awaitTermination()
        totals.append(SM.coverage_total(spark, out))
    a, b = totals[0], totals[1].withColumnRenamed("effort", "other")
    both = a.join(b, ["mission_id", "row", "col"], "full")
    same = F.coalesce(F.abs(F.col("effort") - F.col("other")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("effort")), F.lit(False))
    return both.groupBy("mission_id").agg(F.count(F.lit(1)).alias("cells"), R6(F.sum("effort")).alias("effort"), F.bool_and(same).alias("same_cells"))


@query("t7_overdue_stream", "SELECT user_id AS member_id, 1704067200000+max(event_id)*60000 AS last_ms, 1704067500000+max(event_id)*60000 AS due_ms FROM events WHERE user_id%9<>0 GROUP BY 1")
def t7(spark, sf):
    """Overdue members as event time passes; the last events of the table move the clock."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("member_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 60).alias("ts"), F.lit(300).alias("interval_s"), (F.col("user_id") % 9 == 0).alias("revoked"))
    late = e.agg(F.max("ts").alias("m")).select(F.lit(-1).cast(BIG).alias("member_id"), (F.col("m") + F.expr("interval 1 day")).alias("ts"), F.lit(300).alias("interval_s"), F.lit(True).alias("revoked"))
    out = shared_dir(spark, "checkins-in")
    for part in (e, late):  # the file of the late row is the newest and comes last
        part.write.mode("append").parquet(out)
    src = batches_of(spark, out, e.schema)
    return SM.run_available(SM.overdue(src), "overdue")
