"""Queries over tracks: edges, flags, sessions, samples, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PR
from ..operators import tracks as T
from . import adapters as A
from .registry import cte, query, table

R4 = lambda c: F.round(c, 4)
R6 = lambda c: F.round(c, 6)


def edges(spark, sf):
    b = A.track_block(spark, sf)
    return T.consecutive(A.fixes(spark, sf, b), block=b)


def labelled(spark, sf, block=None):
    p = A.walk_points(spark, sf, block)
    return T.label_points(p, A.mode_labels(p))


@query("w1_consecutive", "SELECT track_id, seq, dt, round(dist,4) AS dist_m, round(speed,6) AS speed, round(grade,6) AS grade FROM pairs")
def w1(spark, sf):
    return edges(spark, sf).select("track_id", "seq", "dt", R4("dist").alias("dist_m"), R6("speed").alias("speed"), R6("grade").alias("grade"))


@query("w2_ordinal", "SELECT track_id, seq, rn FROM (SELECT track_id, seq, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS rn FROM fixes) WHERE rn>1")
def w2(spark, sf):
    b = A.track_block(spark, sf)
    return T.ordinal(A.fixes(spark, sf, b), "track_id", "seq", "rn", b).where("rn > 1").select("track_id", "seq", "rn")


@query("f1_segment_flags", "SELECT search_type, quality_flag, count(*) AS n FROM pairs GROUP BY ALL")
def f1(spark, sf):
    return PR.count_by(edges(spark, sf), ["search_type", "quality_flag"])


cte("sweep_edges", """SELECT *, CASE WHEN dt>120 THEN 'gap' WHEN dt=0 OR length/nullif(dt,0)<0.08 OR length/nullif(dt,0)>3 OR length>250 THEN 'excluded' ELSE 'admitted' END AS status
 FROM (SELECT *, sqrt(pow(x_m-p_x,2)+pow(y_m-p_y,2)) AS length FROM pairs)""")


@query("f2_edge_admission", "SELECT status, count(*) AS n, round(sum(length),3) AS length_m FROM sweep_edges GROUP BY 1")
def f2(spark, sf):
    return T.admit_edges(edges(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 3).alias("length_m"))


@query("f3_exclusion_reasons", """SELECT objectid, concat_ws(',', CASE WHEN case_a<>case_b THEN 'CROSS_CASE_JOIN' END, CASE WHEN n<>1 THEN 'MULTIPLE_ENDPOINTS_UNRESOLVED' END,
 CASE WHEN type_a<>'IPP' OR type_b<>'Found' THEN 'NON_PRIMARY_ENDPOINT' END, CASE WHEN lon_a IS NULL OR abs(lon_a)>180 OR abs(lon_b)>180 THEN 'INVALID_COORDINATE' END,
 CASE WHEN err_a<=0 OR err_b<=0 THEN 'INVALID_UNCERTAINTY' END, CASE WHEN lon_a=lon_b AND lat_a=lat_b AND abs(lon_b)<=180 THEN 'ZERO_DISTANCE' END, CASE WHEN n_paths<>1 OR n_vertices<>2 THEN 'UNEXPECTED_GEOMETRY' END) AS reasons FROM (SELECT *, count(*) OVER (PARTITION BY case_a) AS n FROM endpoint_links)""")
def f3(spark, sf):
    return T.exclusion_reasons(A.endpoint_links(spark, sf)).select("objectid", F.concat_ws(",", "reasons").alias("reasons"))


cte("point_labels", """SELECT p.track_id, p.seq, CASE WHEN count(l.mode)=1 AND max(l.mode)='walk' THEN max(l."start") END AS label_start
 FROM walk_points p LEFT JOIN mode_labels l ON p.track_id=l.track_id AND p.t_s>=l."start" AND p.t_s<=l."end" GROUP BY 1,2""")


@query("j4_label_points", "SELECT track_id, seq, label_start FROM point_labels")
def j4(spark, sf):
    return labelled(spark, sf).select("track_id", "seq", "label_start")


DXY = lambda la, lo, lb, lob: (
    f"radians(({lob}-{lo}+540.0::DOUBLE)%360.0-180.0)*6371008.8::DOUBLE*cos(radians(({la}+{lb})/2))", f"radians({lb}-{la})*6371008.8::DOUBLE")
_dx, _dy = DXY("p_lat", "p_lon", "lat", "lon")
cte("walk_lag", """SELECT w.*, l.label_start, lag(w.t_s) OVER z AS p_t, lag(lat) OVER z AS p_lat, lag(lon) OVER z AS p_lon, lag(label_start) OVER z AS p_lab
 FROM walk_points w JOIN point_labels l USING (track_id, seq) WINDOW z AS (PARTITION BY w.track_id ORDER BY w.seq)""")
cte("walk_linked", f"""SELECT *, coalesce(label_start=p_lab AND t_s-p_t>0 AND t_s-p_t<=15 AND sqrt(pow({_dx},2)+pow({_dy},2))<=4*(t_s-p_t), false) AS linked FROM walk_lag""")
cte("walk_segments_all", "SELECT *, (sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY seq))::BIGINT AS segment FROM walk_linked")
cte("walk_keep", "SELECT track_id, segment FROM walk_segments_all GROUP BY 1,2 HAVING count(*)>=3 AND max(t_s)-min(t_s)>=60 AND bool_and(label_start IS NOT NULL)")
cte("walk_segments", "SELECT s.* FROM walk_segments_all s SEMI JOIN walk_keep k USING (track_id, segment)")


@query("f5_connected", "SELECT person, linked, count(*) AS n FROM walk_linked GROUP BY ALL")
def f5(spark, sf):
    b = A.track_block(spark, sf)
    return PR.count_by(T.connected(labelled(spark, sf, b), block=b), ["person", "linked"])


@query("w3_sessionize", "SELECT track_id, segment, count(*) AS points, max(t_s)-min(t_s) AS seconds FROM walk_segments GROUP BY 1,2")
def w3(spark, sf):
    b = A.track_block(spark, sf)
    return T.sessionize(labelled(spark, sf, b), block=b).groupBy("track_id", "segment").agg(F.count(F.lit(1)).alias("points"), (F.max("t_s") - F.min("t_s")).alias("seconds"))


cte("walk_grid", """SELECT person, track_id, segment, g AS grid_t, CASE WHEN linked THEN p_lat+(g-p_t)/(t_s-p_t)::DOUBLE*(lat-p_lat) ELSE lat END AS lat,
 CASE WHEN linked THEN p_lon+(g-p_t)/(t_s-p_t)::DOUBLE*(lon-p_lon) ELSE lon END AS lon
 FROM (SELECT *, unnest(generate_series(CASE WHEN linked THEN (p_t//30+1)*30 ELSE ceil(t_s/30.0)::BIGINT*30 END, t_s//30*30, 30)) AS g FROM walk_segments)""")


def grid(spark, sf, block=None):
    return T.resample(T.sessionize(labelled(spark, sf, block), block=block))


@query("w4_resample", "SELECT track_id, segment, grid_t, round(lat,7) AS lat, round(lon,7) AS lon FROM walk_grid")
def w4(spark, sf):
    return grid(spark, sf, A.track_block(spark, sf)).select("track_id", "segment", "grid_t", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


_a, _b = DXY("lat0", "lon0", "lat", "lon")
_c, _d = DXY("lat", "lon", "lat2", "lon2")
_bin = lambda v: f"CASE WHEN {v}<0.25 THEN 0 WHEN {v}<0.75 THEN 1 WHEN {v}<1.25 THEN 2 WHEN {v}<1.75 THEN 3 WHEN {v}<2.5 THEN 4 ELSE 5 END::BIGINT"
cte("walk_vectors", f"""SELECT *, sqrt(pdx*pdx+pdy*pdy)/30 AS v0, sqrt(ndx*ndx+ndy*ndy)/30 AS v1 FROM (SELECT *, {_a} AS pdx, {_b} AS pdy, {_c} AS ndx, {_d} AS ndy FROM
 (SELECT *, lag(lat) OVER z AS lat0, lag(lon) OVER z AS lon0, lead(lat) OVER z AS lat2, lead(lon) OVER z AS lon2 FROM walk_grid WINDOW z AS (PARTITION BY track_id, segment ORDER BY grid_t))
 WHERE lat0 IS NOT NULL AND lat2 IS NOT NULL)""")
cte("walk_samples", f"""SELECT person, track_id, segment, grid_t AS utc, {_bin('v0')} AS prev_bin,
 ({_bin('v1')})*9+CASE WHEN v0<0.25 OR v1<0.25 THEN 8 ELSE floor((((atan2(ndy,ndx)-atan2(pdy,pdx)+pi()/8)%(2*pi())+2*pi())%(2*pi()))/(pi()/4))::BIGINT END AS next_class,
 v0, v1, pdx, pdy, ndx, ndy, lat0, lon0, lat, lon, lat2, lon2 FROM walk_vectors WHERE v0<=4 AND v1<=4""")


def walk_samples(spark, sf, block=None):
    return T.samples(grid(spark, sf, block), block=block)


@query("w5_samples", "SELECT track_id, utc, prev_bin, next_class, round(v0,6) AS v0, round(v1,6) AS v1, round(pdx,4) AS pdx, round(ndy,4) AS ndy FROM walk_samples")
def w5(spark, sf):
    return walk_samples(spark, sf, A.track_block(spark, sf)).select("track_id", "utc", "prev_bin", "next_class", R6("v0").alias("v0"), R6("v1").alias("v1"), R4("pdx").alias("pdx"), R4("ndy").alias("ndy"))


cte("samples_first_time", "SELECT *, track_id*10000000+utc AS ord FROM walk_samples QUALIFY row_number() OVER (PARTITION BY person, utc ORDER BY track_id, utc)=1")
cte("samples_dedup", """SELECT * FROM samples_first_time QUALIFY person = first_value(person) OVER (PARTITION BY round(lat0,6),round(lon0,6),round(lat,6),round(lon,6),round(lat2,6),round(lon2,6) ORDER BY ord)""")


def deduped(spark, sf):
    s = walk_samples(spark, sf, A.track_block(spark, sf)).withColumn("ord", F.col("track_id") * 10_000_000 + F.col("utc"))
    return T.first_wins(s, "person", "utc", ["lat0", "lon0", "lat", "lon", "lat2", "lon2"], "ord")


@query("w9_first_wins", "SELECT person, track_id, utc FROM samples_dedup")
def w9(spark, sf):
    return deduped(spark, sf).select("person", "track_id", "utc")


cte("walk_runs", """SELECT *, (row_number() OVER (PARTITION BY track_id, run ORDER BY utc)-1) AS pos FROM (SELECT *, sum(brk) OVER (PARTITION BY track_id ORDER BY utc) AS run FROM
 (SELECT *, CASE WHEN utc-lag(utc) OVER z=30 AND pdx=lag(ndx) OVER z AND pdy=lag(ndy) OVER z THEN 0 ELSE 1 END AS brk FROM walk_samples WINDOW z AS (PARTITION BY track_id ORDER BY utc)))""")
cte("walk_windows", """SELECT person, track_id, min(utc) AS "start", sum(CASE WHEN pos%10<1 THEN ndx END) AS x1, sum(CASE WHEN pos%10<1 THEN ndy END) AS y1, sum(CASE WHEN pos%10<4 THEN ndx END) AS x4,
 sum(CASE WHEN pos%10<4 THEN ndy END) AS y4, sum(ndx) AS x10, sum(ndy) AS y10 FROM walk_runs GROUP BY person, track_id, run, pos//10 HAVING count(*)=10""")


@query("w13_windows", """SELECT track_id, "start", round(x1,4) AS x1, round(y4,4) AS y4, round(x10,4) AS x10 FROM walk_windows""")
def w13(spark, sf):
    b = A.track_block(spark, sf)
    return T.windows(walk_samples(spark, sf, b), block=b).select("track_id", "start", R4("x1").alias("x1"), R4("y4").alias("y4"), R4("x10").alias("x10"))


@query("w14_monotone", "SELECT track_id, sum(CASE WHEN t_s<=p_t THEN 1 ELSE 0 END)=0 AS increasing, sum(CASE WHEN t_s<=p_t THEN 1 ELSE 0 END)::BIGINT AS bad_pairs FROM fix_lag GROUP BY 1")
def w14(spark, sf):
    b = A.track_block(spark, sf)
    return T.monotone(A.fixes(spark, sf, b), block=b)


@query("a11_track_summary", """SELECT track_id, round(sum(CASE WHEN status='admitted' THEN length ELSE 0 END),1) AS distance_m, count(*)+1 AS points, count(*) FILTER (status='gap') AS gaps, count(*) FILTER (status='excluded') AS excluded FROM sweep_edges GROUP BY 1""")
def a11(spark, sf):
    return T.track_summary(T.admit_edges(edges(spark, sf)))


@query("a36_track_audit", f"""SELECT person, count(*) AS points, 0::BIGINT AS invalid_points, count(*) FILTER (label_start=p_lab) AS pairs, count(*) FILTER (label_start=p_lab AND t_s<=p_t) AS nonpositive,
 count(*) FILTER (label_start=p_lab AND t_s-p_t>15) AS gaps, count(*) FILTER (label_start=p_lab AND t_s>p_t AND sqrt(pow({_dx},2)+pow({_dy},2))>4*(t_s-p_t)) AS fast, coalesce(sum(CASE WHEN linked THEN t_s-p_t END),0)::BIGINT AS usable_s FROM walk_linked GROUP BY 1""")
def a36(spark, sf):
    b = A.track_block(spark, sf)
    return T.audit_tracks(labelled(spark, sf, b), block=b)


@query("a37_duplicate_audit", """SELECT person, count(label_start) AS walk_points, count(*) FILTER (label_start=p_lab AND t_s=p_t AND lat=p_lat AND lon=p_lon) AS same_time_same_place,
 count(*) FILTER (label_start=p_lab AND t_s=p_t AND NOT (lat=p_lat AND lon=p_lon)) AS same_time_other_place, count(*) FILTER (label_start=p_lab AND t_s<p_t) AS backwards,
 count(*) FILTER (label_start=p_lab AND r=p_r AND lat=p_lat AND lon=p_lon) AS same_raw_time, count(*) FILTER (label_start=p_lab AND t_s=p_t AND r>p_r AND NOT (lat=p_lat AND lon=p_lon)) AS within_second
 FROM (SELECT *, lag(r) OVER (PARTITION BY track_id ORDER BY seq) AS p_r FROM (SELECT *, t_s*10+seq%3 AS r FROM walk_lag)) GROUP BY 1""")
def a37(spark, sf):
    b = A.track_block(spark, sf)
    return T.audit_duplicates(labelled(spark, sf, b).withColumn("raw_t", F.col("t_s") * 10 + F.col("seq") % 3), block=b)


@query("a37_time_agreement", "SELECT person, count(*) AS checks, count(*) FILTER (seq%11 IN (2,3,4)) AS mismatches FROM walk_points GROUP BY 1")
def a37b(spark, sf):
    p = A.walk_points(spark, sf).withColumn("text_t", F.col("t_s") + F.when((F.col("seq") % 11).isin(2, 3, 4), 2).otherwise(1))
    return T.time_agreement(p, "t_s", "text_t")


@query("a38_clock_bounds", """SELECT track_id, round(greatest(coalesce(max((b.y-a.y-128)/(b.x-a.x)::DOUBLE),0),0),6) AS lower, round(min((b.y-a.y+128)/(b.x-a.x)::DOUBLE),6) AS upper,
 coalesce(max((b.y-a.y-128)/(b.x-a.x)::DOUBLE),0) <= coalesce(min((b.y-a.y+128)/(b.x-a.x)::DOUBLE),1e308) AS compatible
 FROM (SELECT track_id, seq, t_s AS x, t_s+(seq*29)%200 AS y FROM fixes) a JOIN (SELECT track_id, seq, t_s AS x, t_s+(seq*29)%200 AS y FROM fixes) b USING (track_id) WHERE a.seq<b.seq AND b.x>a.x GROUP BY 1""")
def a38(spark, sf):
    blk = A.track_block(spark, sf)
    f = A.fixes(spark, sf, blk).select("track_id", "seq", F.col("t_s").alias("x"), (F.col("t_s") + (F.col("seq") * 29) % 200).alias("y"))
    b = T.clock_bounds(f, "track_id", "x", "y", block=blk)
    return b.select("track_id", R6("lower").alias("lower"), R6("upper").alias("upper"), "compatible")


@query("a39_responder_qa", """SELECT track_id, count(*)+1 AS points, count(*) FILTER (st='ok') AS accepted, count(*) FILTER (st='time') AS nonincreasing, count(*) FILTER (st='gap') AS gaps, count(*) FILTER (st='fast') AS fast,
 round(avg(speed) FILTER (st='ok'),6) AS mean_speed, round(median(speed) FILTER (st='ok'),6) AS median_speed
 FROM (SELECT *, CASE WHEN dt<=0 THEN 'time' WHEN dt>120 THEN 'gap' WHEN speed>3 THEN 'fast' ELSE 'ok' END AS st FROM pairs) GROUP BY 1""")
def a39(spark, sf):
    b = A.track_block(spark, sf)
    return T.responder_qa(A.fixes(spark, sf, b), block=b).withColumn("mean_speed", R6("mean_speed")).withColumn("median_speed", R6("median_speed"))


@query("a42_path_lengths", """SELECT track_id, count(*) AS points, arg_min(t_s,seq) AS first_t, arg_max(t_s,seq) AS last_t, count(*) FILTER (t_s<=p_t) AS nonincreasing, round(coalesce(sum(sqrt(pow(x_m-p_x,2)+pow(y_m-p_y,2))),0),3) AS length FROM fix_lag GROUP BY 1""")
def a42(spark, sf):
    b = A.track_block(spark, sf)
    return T.path_lengths(A.fixes(spark, sf, b), block=b).withColumn("length", F.round("length", 3))


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(t, c, dtype):
    return f"""SELECT '{c}' AS "column", count(*) AS rows_, count(*)-count({c}) AS nulls, count(DISTINCT {c}) AS distinct_, round(avg({c}::DOUBLE),4) AS mean, round(stddev_samp({c}::DOUBLE),4) AS std,
 round(quantile_cont({c}::DOUBLE,0.01),4) AS p1, round(quantile_cont({c}::DOUBLE,0.5),4) AS p50, round(quantile_cont({c}::DOUBLE,0.99),4) AS p99 FROM {t}"""


def _describe_str(t, c):
    return f"""SELECT '{c}', count(*), count(*)-count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL FROM {t}"""


@query("a19_profile", " UNION ALL ".join([_describe_sql("lineitem", c, "") for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + _NUMS] + [_describe_str("lineitem", c) for c in ["l_returnflag", "l_linestatus", "l_shipdate"]]))
def a19(spark, sf):
    p = PR.profile(table(spark, sf, "lineitem"))
    return p.select(
        "column", F.col("rows").alias("rows_"), "nulls", F.col("distinct").alias("distinct_"), *[R4(c).alias(c) for c in ("mean", "std", "p1", "p50", "p99")])


@query("a19_duplicate_rows", """SELECT count(*) AS "rows", (count(*)-(SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT AS duplicate_rows FROM lineitem""")
def a19d(spark, sf):
    return PR.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _stats_sql(c):
    q = ", ".join(f"round(quantile_cont(v,{p}) FILTER (ok),4) AS {n}" for n, p in PR.PERCENTILES.items())
    return f"""SELECT '{c}' AS "column", count(*) AS "count", count(*) FILTER (NOT ok) AS nonfinite, count(DISTINCT v) FILTER (ok) AS unique_finite, count(*) FILTER (ok AND v=0) AS zero, count(*) FILTER (ok AND v<0) AS negative,
 min(v) FILTER (ok) AS min, max(v) FILTER (ok) AS max, round(avg(v) FILTER (ok),4) AS mean, round(stddev_pop(v) FILTER (ok),4) AS population_std, {q}
 FROM (SELECT v, coalesce(isfinite(v),false) AS ok FROM (SELECT CASE WHEN o_orderkey%97=0 THEN 'nan'::DOUBLE WHEN o_orderkey%89=0 THEN 'inf'::DOUBLE ELSE {c} END AS v FROM (SELECT o_orderkey, o_totalprice, (o_custkey%200-100)::DOUBLE AS o_shift FROM orders)))"""


@query("a20_numeric_stats", " UNION ALL ".join(_stats_sql(c) for c in ("o_totalprice", "o_shift")))
def a20(spark, sf):
    k = F.col("o_orderkey")
    dirty = lambda c: F.when(k % 97 == 0, float("nan")).when(k % 89 == 0, float("inf")).otherwise(c)
    o = table(spark, sf, "orders").select(dirty(F.col("o_totalprice")).alias("o_totalprice"), dirty((F.col("o_custkey") % 200 - 100).cast("double")).alias("o_shift"))
    s = PR.numeric_stats(o, ["o_totalprice", "o_shift"])
    return s.select("column", "count", "nonfinite", "unique_finite", "zero", "negative", "min", "max", *[R4(c).alias(c) for c in ("mean", "population_std", *PR.PERCENTILES)])


@query("a21_grouped_counts", """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (date_trunc('day',l_shipdate)=l_shipdate) AS at_midnight, count(*) FILTER (l_tax=0) AS zero, count(*) FILTER (l_quantity-25<0) AS negative FROM lineitem GROUP BY ALL""")
def a21(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.date_trunc("day", "l_shipdate") == F.col("l_shipdate")).alias("at_midnight"),
        F.count_if(F.col("l_tax") == 0).alias("zero"), F.count_if(F.col("l_quantity") - 25 < 0).alias("negative"))


@query("f10_min_rows", "SELECT person, count(*) AS n FROM walk_samples GROUP BY 1 HAVING count(*)>=20")
def f10(spark, sf):
    return PR.count_by(walk_samples(spark, sf, A.track_block(spark, sf)), ["person"]).where("n >= 20")
