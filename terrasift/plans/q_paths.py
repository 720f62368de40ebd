"""Queries over weighted paths, plans and light."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grid as G
from ..operators import paths as P
from ..operators.mass import significant
from . import adapters as A
from .registry import cte, query, table

R6 = lambda c: F.round(c, 6)
R9 = lambda c: F.round(c, 9)
BIG = "bigint"

# One path per order, four frames each, 15 s apart; the cells walk around the window centre.
cte("path_base", f"""SELECT o_custkey%20 AS mission_id, {A.SCENARIO} AS scenario, o_orderkey AS path_id, (1+o_custkey%7)::DOUBLE AS w, o_orderkey AS o, o_custkey AS c FROM orders""")
cte("path_weight", """SELECT mission_id, scenario, path_id, 0.9*w/sum(w) OVER (PARTITION BY mission_id, scenario) AS weight, o, c FROM path_base""")
cte("paths", """SELECT mission_id, scenario, path_id, weight, f AS frame_idx, CASE WHEN (o+f)%50=0 THEN 262144 ELSE (250+(c+f)%12)*512+250+(o+f)%12 END AS left_cell,
 CASE WHEN (o+f)%50=0 THEN 262144 ELSE (250+(c+f)%12)*512+251+(o+f)%12 END AS right_cell, (o%5)/5.0::DOUBLE AS fraction, (c%20)/10.0::DOUBLE AS speed_mps, (o%900)::DOUBLE AS distance_m
 FROM (SELECT *, unnest([0,1,2,3]) AS f FROM path_weight)""")


def path_weight(spark, sf):
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("mission_id"), F.expr(A.SCENARIO).alias("scenario"), F.col("o_orderkey").alias("path_id"),
        (1 + F.col("o_custkey") % 7).cast("double").alias("w"), F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"))
    tot = o.groupBy("mission_id", "scenario").agg(F.sum("w").alias("t"))
    return o.join(tot, ["mission_id", "scenario"]).withColumn("weight", F.lit(0.9) * F.col("w") / F.col("t")).drop("w", "t")


def paths(spark, sf):
    p = path_weight(spark, sf).withColumn("frame_idx", F.explode(F.array(*[F.lit(f).cast(BIG) for f in range(4)])))
    o, c, f = F.col("o"), F.col("c"), F.col("frame_idx")
    out = (o + f) % 50 == 0
    cell = lambda d: F.when(out, F.lit(G.OUTSIDE_CELL)).otherwise((250 + (c + f) % 12) * 512 + 250 + d + (o + f) % 12).cast(BIG)
    return p.select(
        "mission_id", "scenario", "path_id", "weight", "frame_idx", cell(0).alias("left_cell"), cell(1).alias("right_cell"), ((o % 5) / 5.0).alias("fraction"),
        ((c % 20) / 10.0).alias("speed_mps"), (o % 900).cast("double").alias("distance_m"))


def outside(spark, sf):
    return path_weight(spark, sf).select("mission_id", "scenario").distinct().withColumn("outside", F.lit(0.1))


cte("frame_mass", """SELECT mission_id, scenario, frame_idx, cell, sum(m) AS mass FROM (SELECT mission_id, scenario, frame_idx, left_cell AS cell, weight*(1-fraction) AS m FROM paths UNION ALL
 SELECT mission_id, scenario, frame_idx, right_cell, weight*fraction FROM paths) GROUP BY 1,2,3,4 HAVING sum(m)>0""")


@query("a12_frame_mass", "SELECT mission_id, scenario, frame_idx::BIGINT AS frame_idx, cell, round(mass,9) AS mass FROM frame_mass")
def a12(spark, sf):
    return P.frame_mass(paths(spark, sf)).withColumn("mass", R9("mass"))


@query("a43_check_paths", "SELECT mission_id, scenario, abs(sum(weight)+0.1-1)<=1e-8 AS ok FROM path_weight GROUP BY 1,2")
def a43p(spark, sf):
    return P.check_paths(paths(spark, sf), outside(spark, sf))


# Plans: one step per lineitem part of an order; the plan sweeps two cells at each end.
cte("plan_steps", """SELECT l_partkey%20 AS mission_id, l_suppkey%40 AS plan_id, (l_orderkey%45)::DOUBLE AS arrive_s, (l_orderkey%45+1+l_linenumber)::DOUBLE AS leave_s,
 [(250+l_partkey%12)*512+250+l_orderkey%12, CASE WHEN l_linenumber%3=0 THEN -1 ELSE (251+l_partkey%12)*512+250+l_orderkey%12 END] AS cells_a, [(250+l_partkey%12)*512+251+l_orderkey%12, -1] AS cells_b FROM lineitem""")


def plan_steps(spark, sf):
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    cell = lambda dr, dc: ((250 + dr + p % 12) * 512 + 250 + dc + o % 12).cast(BIG)
    none = F.lit(-1).cast(BIG)
    return table(spark, sf, "lineitem").select(
        (p % 20).alias("mission_id"), (F.col("l_suppkey") % 40).alias("plan_id"), (o % 45).cast("double").alias("arrive_s"), (o % 45 + 1 + n).cast("double").alias("leave_s"),
        F.array(cell(0, 0), F.when(n % 3 == 0, none).otherwise(cell(1, 0))).alias("cells_a"), F.array(cell(0, 1), none).alias("cells_b"))


cte("plan_effort", """SELECT mission_id, plan_id, frame_idx, cell, count(*)/60.0::DOUBLE*0.01 AS effort FROM (SELECT mission_id, plan_id, ceil((arrive_s+leave_s)/2/15-0.5)::BIGINT AS frame_idx, unnest(list_concat(cells_a,cells_b)) AS cell FROM plan_steps) WHERE cell>=0 GROUP BY 1,2,3,4""")
cte("plan_exposure", """SELECT mission_id, plan_id, scenario, path_id, max(weight) AS weight, sum(share*effort) AS effort FROM (SELECT mission_id, scenario, path_id, frame_idx, weight, left_cell AS cell, 1-fraction AS share FROM paths UNION ALL
 SELECT mission_id, scenario, path_id, frame_idx, weight, right_cell, fraction FROM paths) JOIN plan_effort USING (mission_id, frame_idx, cell) GROUP BY 1,2,3,4""")


def exposed(spark, sf):
    return P.exposure(paths(spark, sf), plan_steps(spark, sf), scale=0.01)


@query("a13_exposure", "SELECT mission_id, plan_id, scenario, count(*) AS paths, round(sum(effort),6) AS effort, round(sum(weight),6) AS weight FROM plan_exposure GROUP BY 1,2,3")
def a13(spark, sf):
    return exposed(spark, sf).groupBy("mission_id", "plan_id", "scenario").agg(F.count(F.lit(1)).alias("paths"), R6(F.sum("effort")).alias("effort"), R6(F.sum("weight")).alias("weight"))


cte("first_plan", "SELECT mission_id, scenario, path_id, effort AS old FROM plan_exposure WHERE plan_id=0")
cte("plan_gain", """SELECT mission_id, plan_id, scenario, width, sum(weight*exp(-width*coalesce(old,0))*(1-exp(-width*effort))) AS gain FROM plan_exposure LEFT JOIN first_plan USING (mission_id, scenario, path_id), (VALUES (8.0),(15.0),(22.0)) w(width) WHERE plan_id<>0 GROUP BY ALL""")


def gains(spark, sf):
    p, steps = paths(spark, sf), plan_steps(spark, sf)
    first = P.exposure(p, steps.where("plan_id = 0"), scale=0.01)
    return P.gain(P.exposure(p, steps.where("plan_id <> 0"), scale=0.01, assigned=first))


@query("a14_gain", """SELECT mission_id, plan_id, round(CASE WHEN count(*) FILTER (width=15)=3 THEN min(gain) FILTER (width=15) ELSE 0 END,8) AS worst, round(CASE WHEN count(*)=9 THEN min(gain) ELSE 0 END,8) AS low, round(max(gain),8) AS high FROM plan_gain GROUP BY 1,2""")
def a14(spark, sf):
    g = P.plan_gain(gains(spark, sf))
    return g.select("mission_id", "plan_id", *[F.round(c, 8).alias(c) for c in ("worst", "low", "high")])


@query("a14_accept", "SELECT mission_id, scenario, path_id, round(sum(effort),9) AS effort FROM plan_exposure GROUP BY 1,2,3")
def a14a(spark, sf):
    e = exposed(spark, sf)
    return P.accept(e.where("plan_id < 20"), e.where("plan_id >= 20")).withColumn("effort", R9("effort"))


@query("a14_swept_area", "SELECT mission_id, plan_id, count(DISTINCT cell)*900.0 AS area_m2 FROM (SELECT mission_id, plan_id, unnest(list_concat(cells_a,cells_b)) AS cell FROM plan_steps) WHERE cell>=0 GROUP BY 1,2")
def a14s(spark, sf):
    return P.swept_area(plan_steps(spark, sf))


cte("path_priority", """SELECT mission_id, zone_id, max(c) AS priority FROM (SELECT mission_id, frame_idx, zone_id, CASE WHEN count(*)=3 AND min(v)>0 THEN exp(avg(ln(v))) ELSE 0 END AS c FROM
 (SELECT mission_id, frame_idx, scenario, (cell//512//16)*32+(cell%512)//16 AS zone_id, sum(mass) AS v FROM frame_mass WHERE cell<262144 GROUP BY 1,2,3,4) GROUP BY 1,2,3) GROUP BY 1,2 HAVING max(c)>0""")


@query("a15_priority", "SELECT mission_id, zone_id, round(priority,9) AS priority FROM path_priority")
def a15(spark, sf):
    return P.priority(paths(spark, sf)).withColumn("priority", R9("priority"))


cte("path_evidence", """SELECT o_custkey%20 AS mission_id, (o_orderkey%4)*60 AS bin_end_s, (250+o_custkey%12)*512+250+o_orderkey%12 AS cell, count(*)/40.0::DOUBLE AS intensity FROM orders GROUP BY 1,2,3""")


def evidence(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").groupBy((c % 20).alias("mission_id"), (o % 4 * 60).alias("bin_end_s"), ((250 + c % 12) * 512 + 250 + o % 12).alias("cell")).agg((F.count(F.lit(1)) / 40.0).alias("intensity"))


def positions(spark, sf):
    return paths(spark, sf).withColumn("bin_end_s", F.col("frame_idx") * 60)


@query("a16_reweight", """SELECT mission_id, scenario, path_id, round(q/(sum(q) OVER (PARTITION BY mission_id, scenario)+0.1),12) AS weight FROM (SELECT p.mission_id, p.scenario, p.path_id, p.weight*exp(-coalesce(loss,0)) AS q FROM path_weight p LEFT JOIN
 (SELECT mission_id, scenario, path_id, sum(share*intensity) AS loss FROM (SELECT mission_id, scenario, path_id, frame_idx*60 AS bin_end_s, left_cell AS cell, 1-fraction AS share FROM paths UNION ALL SELECT mission_id, scenario, path_id, frame_idx*60, right_cell, fraction FROM paths)
 JOIN path_evidence USING (mission_id, bin_end_s, cell) GROUP BY 1,2,3) USING (mission_id, scenario, path_id))""")
def a16(spark, sf):
    w = path_weight(spark, sf).select("mission_id", "scenario", "path_id", "weight")
    return P.reweight(w, positions(spark, sf), evidence(spark, sf), outside(spark, sf)).select("mission_id", "scenario", "path_id", F.round("weight", 12).alias("weight"))


@query("a17_mean_speed", "SELECT mission_id, scenario, round(sum(weight*speed_mps)*3.6/sum(weight),6) AS mean_kmh, round(sum(weight*distance_m)/sum(weight),4) AS mean_m FROM paths WHERE frame_idx=0 GROUP BY 1,2")
def a17(spark, sf):
    return P.mean_speed(paths(spark, sf).where("frame_idx = 0")).select("mission_id", "scenario", R6("mean_kmh").alias("mean_kmh"), F.round("mean_m", 4).alias("mean_m"))


@query("a17_zone_speed", """SELECT mission_id, zone_id, round(sum(m*speed_mps*3.6)/greatest(sum(m),1e-12),6) AS speed_kmh FROM (SELECT mission_id, (cell//512//16)*32+(cell%512)//16 AS zone_id, speed_mps, weight*share*CASE scenario WHEN 'a' THEN 0.5 ELSE 0.25 END AS m FROM
 (SELECT *, left_cell AS cell, 1-fraction AS share FROM paths UNION ALL SELECT *, right_cell, fraction FROM paths) WHERE frame_idx=3 AND cell<262144) GROUP BY 1,2""")
def a17z(spark, sf):
    return P.zone_speed(paths(spark, sf).where("frame_idx = 3")).select("mission_id", "zone_id", R6("speed_kmh").alias("speed_kmh"))


@query("a18_effective_sample", "SELECT mission_id, scenario, round(pow(sum(weight),2)/sum(weight*weight),4) AS effective, pow(sum(weight),2)/sum(weight*weight)<256 AS low_support FROM path_weight GROUP BY 1,2")
def a18(spark, sf):
    return P.ess(path_weight(spark, sf)).withColumn("effective", F.round("effective", 4))


_TVZ = "SELECT mission_id, scenario, (cell//512//16)*32+(cell%512)//16 AS zone_id, sum(mass) AS v FROM frame_mass WHERE cell<262144 AND frame_idx={} GROUP BY 1,2,3"


@query("a40_total_variation", f"SELECT mission_id, scenario, round(0.5*sum(abs(coalesce(a.v,0)-coalesce(b.v,0))),8) AS total_variation FROM ({_TVZ.format(0)}) a FULL JOIN ({_TVZ.format(3)}) b USING (mission_id, scenario, zone_id) GROUP BY 1,2")
def a40(spark, sf):
    f = P.frame_mass(paths(spark, sf)).where(f"cell < {G.OUTSIDE_CELL}")
    z = f.groupBy("mission_id", "scenario", "frame_idx", P._cell_zone().alias("zone_id")).agg(F.sum("mass").alias("value"))
    return P.total_variation(z.where("frame_idx = 0"), z.where("frame_idx = 3"), ["mission_id", "scenario"]).withColumn("total_variation", F.round("total_variation", 8))


@query("a40_same_assignments", "SELECT o_custkey%300 AS run_id, bool_and(o_orderkey%41<>0) AS same FROM orders GROUP BY 1")
def a40s(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("run_id"), F.col("o_orderkey").alias("team_id"), (F.col("o_orderkey") % 1024).alias("zone_id"))
    return P.same_assignments(o, o.withColumn("zone_id", F.when(F.col("team_id") % 41 == 0, F.col("zone_id") + 1).otherwise(F.col("zone_id"))))


cte("visits", "SELECT l_partkey%20 AS mission_id, l_orderkey AS visit_o, l_partkey AS visit_p, l_suppkey AS visit_s, l_linenumber AS visit_n, (l_orderkey%600)::DOUBLE AS arrive_s, (l_orderkey%600+l_linenumber*2)::DOUBLE AS leave_s FROM lineitem")
cte("frames", "SELECT DISTINCT o_custkey%20 AS mission_id, o_orderkey%97 AS frame_idx, (o_orderkey%97)*7+(o_orderkey%97)%3 AS t_s FROM orders")


@query("j9_nearest_frame", """SELECT frame_idx, count(*) AS n FROM (SELECT CASE WHEN a.t_s IS NULL OR mid-b.t_s<=a.t_s-mid THEN b.frame_idx ELSE a.frame_idx END AS frame_idx FROM (SELECT *, (arrive_s+leave_s)/2 AS mid FROM visits) v
 ASOF LEFT JOIN frames b ON v.mission_id=b.mission_id AND v.mid>=b.t_s ASOF LEFT JOIN frames a ON v.mission_id=a.mission_id AND v.mid<=a.t_s) GROUP BY 1""")
def j9(spark, sf):
    n = F.col("l_linenumber")
    v = table(spark, sf, "lineitem").select((F.col("l_partkey") % 20).alias("mission_id"), (F.col("l_orderkey") % 600).cast("double").alias("arrive_s"), (F.col("l_orderkey") % 600 + n * 2).cast("double").alias("leave_s"))
    k = F.col("o_orderkey") % 97
    fr = table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("mission_id"), k.alias("frame_idx"), (k * 7 + k % 3).alias("t_s")).distinct()
    return P.nearest_frame(v, fr).groupBy("frame_idx").agg(F.count(F.lit(1)).alias("n"))


@query("j10_lookup_evidence", """SELECT mission_id, bin_end_s, count(*) AS n, count(*) FILTER (intensity=0) AS missing, round(sum(intensity),6) AS total FROM (SELECT p.mission_id, frame_idx*60 AS bin_end_s, coalesce(intensity,0) AS intensity FROM paths p LEFT JOIN path_evidence e ON e.mission_id=p.mission_id AND e.bin_end_s=frame_idx*60 AND e.cell=left_cell) GROUP BY 1,2""")
def j10(spark, sf):
    p = positions(spark, sf).withColumn("cell", F.col("left_cell"))
    return P.lookup_evidence(p, evidence(spark, sf)).groupBy("mission_id", "bin_end_s").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("intensity") == 0).alias("missing"), R6(F.sum("intensity")).alias("total"))


@query("f9_evidence_cutoff", "SELECT mission_id, count(*) AS n, max(bin_end_s) AS last_s FROM path_evidence WHERE bin_end_s<=(mission_id%4)*60 AND bin_end_s<=21600 GROUP BY 1")
def f9(spark, sf):
    return P.evidence_upto(evidence(spark, sf), F.col("mission_id") % 4 * 60).groupBy("mission_id").agg(F.count(F.lit(1)).alias("n"), F.max("bin_end_s").alias("last_s"))


@query("w12_stratified_sample", """WITH c AS (SELECT mission_id, scenario, path_id, weight, sum(weight) OVER (PARTITION BY mission_id, scenario) AS t, sum(weight) OVER (PARTITION BY mission_id, scenario ORDER BY path_id)/sum(weight) OVER (PARTITION BY mission_id, scenario) AS hi,
 row_number() OVER (PARTITION BY mission_id, scenario ORDER BY path_id DESC) AS r FROM path_weight), d AS (SELECT *, CASE WHEN r=1 THEN 1.0 ELSE hi END AS h FROM c), e AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY mission_id, scenario ORDER BY path_id),0) AS lo FROM d),
 u AS (SELECT i, (i+xor(z::BIGINT,z::BIGINT>>16)/4294967296.0::DOUBLE)/64 AS u FROM (SELECT i, ((xor(y::BIGINT,y::BIGINT>>13))::HUGEINT*3266489917)%4294967296 AS z FROM (SELECT i, ((xor(x::BIGINT,x::BIGINT>>16))::HUGEINT*2246822519)%4294967296 AS y FROM
 (SELECT i, (i::HUGEINT*747796405+42::HUGEINT*277803737+5::HUGEINT*1597334677)%4294967296 AS x FROM (SELECT unnest(generate_series(0,63)) AS i)))))
 SELECT mission_id, scenario, path_id, count(*) AS draws, round(any_value(t)*count(*)/64,9) AS weight FROM e JOIN u ON u.u>=lo AND u.u<h GROUP BY 1,2,3""")
def w12(spark, sf):
    w = path_weight(spark, sf).select("mission_id", "scenario", "path_id", "weight")
    return P.stratified_sample(w, 64).withColumn("weight", R9("weight"))


@query("w17_quota", """WITH n AS (SELECT c_custkey//5 AS mission_id, c_custkey%5 AS pos, (c_custkey*37)%500 AS n FROM customer), l AS (SELECT mission_id, max(lv) AS level FROM (SELECT mission_id, lv, sum(least(n,lv)) AS used FROM n, (SELECT unnest(generate_series(0,600)) AS lv) GROUP BY 1,2) WHERE used<=700 GROUP BY 1),
 b AS (SELECT n.*, least(n,level) AS base, 700-sum(least(n,level)) OVER (PARTITION BY mission_id) AS spare FROM n JOIN l USING (mission_id)),
 t AS (SELECT *, sum((base<n)::INT) OVER (PARTITION BY mission_id ORDER BY pos) AS turn FROM b) SELECT mission_id, pos, n, (base+CASE WHEN base<n AND turn<=spare THEN 1 ELSE 0 END)::BIGINT AS quota FROM t""")
def w17(spark, sf):
    k = F.col("c_custkey")
    n = table(spark, sf, "customer").select(F.floor(k / 5).cast(BIG).alias("mission_id"), (k % 5).alias("pos"), (k * 37 % 500).alias("n"))
    return P.quota(n, 700)


cte("team_reach", "SELECT mission_id, zone_id, priority, t AS team_id, (zone_id*37+t*91)%1500 AS reach_s, 1200+t*300 AS budget_s, (zone_id+mission_id)%7=0 AS excluded FROM path_priority, (VALUES (1),(2),(3)) x(t)")


@query("l2_candidates", "SELECT mission_id, team_id::BIGINT AS team_id, zone_id, position FROM (SELECT *, row_number() OVER (PARTITION BY mission_id, team_id ORDER BY printf('%.11e', priority)::DOUBLE DESC, zone_id) AS position FROM team_reach WHERE 2*reach_s<budget_s AND NOT excluded) WHERE position<=32")
def l2(spark, sf):
    z = P.priority(paths(spark, sf)).withColumn("priority", significant("priority")).withColumn("team_id", F.explode(F.array(*[F.lit(t).cast(BIG) for t in (1, 2, 3)])))
    z = z.withColumn("reach_s", (F.col("zone_id") * 37 + F.col("team_id") * 91) % 1500).withColumn("excluded", (F.col("zone_id") + F.col("mission_id")) % 7 == 0)
    teams = z.select("mission_id", "team_id", (1200 + F.col("team_id") * 300).alias("budget_s")).distinct()
    return P.candidates(z, teams).select("mission_id", "team_id", "zone_id", F.col("position").cast(BIG).alias("position"))


@query("l5_best_plan", "SELECT mission_id, team_id, arg_max(plan_id, (v, -plan_id)) AS plan_id, round(max(v),9) AS value FROM (SELECT o_custkey%50 AS mission_id, o_custkey%4 AS team_id, o_orderkey AS plan_id, (o_orderkey%97)/greatest((o_custkey%89)*10,1.0)::DOUBLE AS v FROM orders) GROUP BY 1,2")
def l5(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    p = table(spark, sf, "orders").select((c % 50).alias("mission_id"), (c % 4).alias("team_id"), o.alias("plan_id"), (o % 97).cast("double").alias("gain"), (c % 89 * 10).cast("double").alias("total_s"))
    return P.best_plan(p).withColumn("value", R9("value"))


# ---- light: one mission per customer block
cte("light_starts", "SELECT c_custkey AS mission_id, 1704067200+c_custkey*7200 AS start_s, 3600.0::DOUBLE+(c_custkey%5)*600 AS horizon_s, 33.4::DOUBLE AS lat, 126.3::DOUBLE AS lon, 0.6::DOUBLE AS night_factor FROM customer")
cte("light_alt", """SELECT *, degrees(asin(least(greatest(sin(radians(lat))*sin(dec)+cos(radians(lat))*cos(dec)*cos(radians(((((h*60+eq+4*lon)%1440.0)+1440.0)%1440.0)/4-180)),-1.0),1.0))) AS alt FROM (SELECT *, 229.18::DOUBLE*(0.000075::DOUBLE+0.001868::DOUBLE*cos(g)-0.032077::DOUBLE*sin(g)-0.014615::DOUBLE*cos(2*g)-0.040849::DOUBLE*sin(2*g)) AS eq,
 0.006918::DOUBLE-0.399912::DOUBLE*cos(g)+0.070257::DOUBLE*sin(g)-0.006758::DOUBLE*cos(2*g)+0.000907::DOUBLE*sin(2*g)-0.002697::DOUBLE*cos(3*g)+0.00148::DOUBLE*sin(3*g) AS dec FROM
 (SELECT *, 2*pi()/CASE WHEN year(ts)%4=0 AND (year(ts)%100<>0 OR year(ts)%400=0) THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END*(dayofyear(ts)-1+(h-12)/24) AS g FROM
 (SELECT *, epoch_ms((start_s+b*60+30)*1000) AS ts, ((start_s+b*60+30)%86400)/3600.0::DOUBLE AS h FROM (SELECT *, unnest(generate_series(0, ceil(horizon_s/60)::BIGINT)) AS b FROM light_starts))))""")
cte("light_bins", "SELECT *, sum(rate*60) OVER (PARTITION BY mission_id ORDER BY b) AS hi FROM (SELECT *, 0.6+0.4*least(greatest((alt+6)/6,0.0),1.0) AS rate FROM light_alt)")


def light(spark, sf):
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select(
        k.alias("mission_id"), (F.lit(1704067200) + k * 7200).alias("start_s"), (3600.0 + k % 5 * 600).alias("horizon_s"), F.lit(33.4).alias("lat"), F.lit(126.3).alias("lon"), F.lit(0.6).alias("night_factor"))
    return P.light_bins(s)


@query("w11_light_integral", """SELECT q.mission_id, q.t_s, round(b.hi-b.rate*60+b.rate*(q.t_s-b.b*60),5) AS effective_s, round(b.rate,6) AS factor FROM (SELECT c_custkey AS mission_id, (c_custkey*53)%3600 AS t_s FROM customer) q JOIN light_bins b ON b.mission_id=q.mission_id AND b.b=q.t_s//60""")
def w11(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("mission_id"), (F.col("c_custkey") * 53 % 3600).alias("t_s"))
    return P.effective_seconds(q, light(spark, sf)).select("mission_id", "t_s", F.round("effective_s", 5).alias("effective_s"), R6("factor").alias("factor"))


@query("w11_finish_times", """WITH q AS (SELECT c_custkey AS mission_id, ((c_custkey*71)%4000+1)::DOUBLE AS target FROM customer), l AS (SELECT mission_id, max(hi) AS top, (max(b)+1)*60 AS e, arg_max(rate,b) AS r FROM light_bins GROUP BY 1)
 SELECT q.mission_id, target AS target_s, round(CASE WHEN target>top THEN e+(target-top)/r ELSE (SELECT b*60+(target-(hi-rate*60))/rate FROM light_bins x WHERE x.mission_id=q.mission_id AND target>hi-rate*60 AND target<=hi) END,3) AS finish_s FROM q JOIN l USING (mission_id)""")
def w11f(spark, sf):
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("mission_id"), (F.col("c_custkey") * 71 % 4000 + 1).cast("double").alias("target_s"))
    return P.finish_times(q, light(spark, sf)).withColumn("finish_s", F.round("finish_s", 3))


@query("w11_phase_minutes", """SELECT mission_id, round(coalesce(sum(w) FILTER (alt>=0),0),4) AS day_minutes, round(coalesce(sum(w) FILTER (alt<0 AND alt>-6),0),4) AS twilight_minutes, round(coalesce(sum(w) FILTER (alt<=-6),0),4) AS night_minutes, round(min(rate) FILTER (b*60<=horizon_s),6) AS worst_factor
 FROM (SELECT *, greatest(0,least((b+1)*60,horizon_s)-b*60)/60 AS w FROM light_bins) GROUP BY 1""")
def w11p(spark, sf):
    p = P.phase_minutes(light(spark, sf))
    return p.select("mission_id", *[F.round(c, 4).alias(c) for c in ("day_minutes", "twilight_minutes", "night_minutes")], R6("worst_factor").alias("worst_factor"))
