"""Queries over effort, mass and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import coverage as C
from ..operators import mass as M
from ..operators import tracks as T
from ..session import cut_lineage
from . import adapters as A
from .registry import cte, query, table

R6 = lambda c: F.round(c, 6)
R9 = lambda c: F.round(c, 9)


def mission_edges(spark, sf):
    """Sweep edges with grid positions and the team that walked them."""
    b = A.track_block(spark, sf)
    e = T.admit_edges(T.consecutive(A.fixes(spark, sf, b), block=b))
    return e.select(
        (F.col("track_id") % 25).alias("mission_id"), "track_id", "seq", "t_s", "prev_t_s", "length", "dt", "status", "row", "col",
        (F.lit(256.0) - F.col("prev_y_m") / 30.0).alias("prev_row"), (F.lit(256.0) + F.col("prev_x_m") / 30.0).alias("prev_col"),
        (F.col("track_id") % 4 + 1).alias("team_size"), F.lit(15.0).alias("spacing_m"))


def coverage(spark, sf):
    return C.team_coverage(mission_edges(spark, sf), ["mission_id"])


def prior(spark, sf):
    return M.histogram(A.draws(spark, sf), M.SCENARIO)


cte("steps_", """SELECT track_id%25 AS mission_id, track_id%4+1 AS team_size, t_s, length, steps, unnest(generate_series(0, steps-1)) AS i, 256.0::DOUBLE-p_y/30.0::DOUBLE AS p_row, 256.0::DOUBLE+p_x/30.0::DOUBLE AS p_col, "row", col
 FROM (SELECT *, greatest(1,ceil(length/5.0))::BIGINT AS steps FROM sweep_edges WHERE status='admitted')""")
cte("step_points", """SELECT mission_id, team_size, t_s, length/steps/900.0 AS unit, p_row+(i+0.5)/steps*("row"-p_row)-0.5 AS rr, p_col+(i+0.5)/steps*(col-p_col)-0.5 AS cc FROM steps_""")
cte("step_cells", """SELECT mission_id, team_size, t_s, floor(rr)::BIGINT+dr AS "row", floor(cc)::BIGINT+dc AS col, (1-abs(rr-(floor(rr)+dr)))*(1-abs(cc-(floor(cc)+dc)))*unit AS effort
 FROM step_points, (VALUES (0,0),(0,1),(1,0),(1,1)) q(dr,dc)""")
cte("effort_raw", """SELECT mission_id, team_size, "row", col, sum(effort) AS effort FROM step_cells WHERE "row" BETWEEN 0 AND 511 AND col BETWEEN 0 AND 511 GROUP BY 1,2,3,4""")
_W = "(SELECT team_size, sigma, k, exp(-0.5*pow(k/sigma,2))/sum(exp(-0.5*pow(k/sigma,2))) OVER (PARTITION BY team_size) AS w FROM (SELECT team_size, sigma, unnest(generate_series(-floor(3*sigma+0.5)::BIGINT, floor(3*sigma+0.5)::BIGINT)) AS k FROM (SELECT n AS team_size, greatest(0.4::DOUBLE, sqrt(100.0+pow((n-1)*15.0,2)/12)/30) AS sigma FROM (VALUES (1),(2),(3),(4)) t(n))))"
cte("kernel_", _W)
cte("effort_rows", """SELECT mission_id, e.team_size, "row"+k AS "row", col, sum(effort*e.team_size*w) AS effort FROM effort_raw e JOIN kernel_ USING (team_size) WHERE "row"+k BETWEEN 0 AND 511 GROUP BY ALL""")
cte("effort", """SELECT mission_id, "row", col+k AS col, sum(effort*w) AS effort FROM effort_rows e JOIN kernel_ USING (team_size) WHERE col+k BETWEEN 0 AND 511 GROUP BY 1, 2, 3""")


@query("a9_sweep_effort", """SELECT mission_id, team_size, "row", col, round(effort,9) AS effort FROM effort_raw WHERE effort>0""")
def a9(spark, sf):
    e = C.sweep_effort(mission_edges(spark, sf), ["mission_id", "team_size"]).where("effort > 0")
    return e.select("mission_id", "team_size", "row", "col", R9("effort").alias("effort"))


@query("a10_spread", """SELECT mission_id, width, count(*) AS cells, round(sum(effort*width),6) AS total, round(max(effort*width),6) AS peak FROM effort, (VALUES (8.0),(15.0),(22.0)) w(width) GROUP BY ALL""")
def a10(spark, sf):
    c = coverage(spark, sf).withColumn("width", F.explode(F.array(F.lit(8.0), F.lit(15.0), F.lit(22.0))))
    return c.groupBy("mission_id", "width").agg(
        F.count(F.lit(1)).alias("cells"), R6(F.sum(F.col("effort") * F.col("width"))).alias("total"), R6(F.max(F.col("effort") * F.col("width"))).alias("peak"))


@query("a2_histogram", """SELECT mission_id, scenario, "row", col, round(mass,9) AS mass FROM mass""")
def a2(spark, sf):
    return prior(spark, sf).select(*M.SCENARIO, "row", "col", R9("mass").alias("mass"))


@query("a2_planar_bins", """SELECT g, "row", col, round(n/sum(n) OVER (PARTITION BY g)::DOUBLE,9) AS mass FROM (SELECT track_id%10 AS g, floor(x_m/40.0)::BIGINT AS "row", floor(y_m/40.0)::BIGINT AS col, count(*) AS n FROM fixes GROUP BY ALL)""")
def a2b(spark, sf):
    f = A.fixes(spark, sf, A.track_block(spark, sf)).select((F.col("track_id") % 10).alias("g"), F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    return M.histogram(f, ["g"], 40.0).withColumn("mass", R9("mass"))


SW = "CASE scenario WHEN 'a' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END"


@query("a3_mixture", f"""SELECT mission_id, "row", col, round(sum({SW}*mass),9) AS mass FROM mass GROUP BY ALL""")
def a3(spark, sf):
    return M.mixture(prior(spark, sf)).withColumn("mass", R9("mass"))


@query("p16_reserve_outside", """SELECT mission_id, scenario, "row", col, round(CASE WHEN "row"=-1 THEN r+(1-r)*mass ELSE mass*(1-r) END,9) AS mass FROM (SELECT *, (mission_id%6)/10.0::DOUBLE AS r FROM
 (SELECT * FROM mass UNION ALL SELECT mission_id, scenario, -1, -1, 0 FROM mass GROUP BY 1,2 HAVING min("row")>=0))""")
def p16(spark, sf):
    return M.reserve_outside(prior(spark, sf), (F.col("mission_id") % 6) / 10.0).withColumn("mass", R9("mass"))


cte("mass_cov", """SELECT m.*, coalesce(e.effort,0) AS effort FROM mass m LEFT JOIN effort e USING (mission_id, "row", col)""")
cte("post", """SELECT *, p_raw0/sum(p_raw0) OVER w AS p0, p_raw1/sum(p_raw1) OVER w AS p1, p_raw2/sum(p_raw2) OVER w AS p2 FROM
 (SELECT *, mass*exp(-effort*8) AS p_raw0, mass*exp(-effort*15) AS p_raw1, mass*exp(-effort*22) AS p_raw2 FROM mass_cov) WINDOW w AS (PARTITION BY mission_id, scenario)""")


@query("j1_attach_coverage", """SELECT mission_id, scenario, "row", col, round(effort,9) AS effort FROM mass_cov""")
def j1(spark, sf):
    return M.attach_coverage(prior(spark, sf), coverage(spark, sf)).select(*M.SCENARIO, "row", "col", R9("effort").alias("effort"))


@query("a4_posterior", """SELECT mission_id, scenario, "row", col, round(p1,9) AS mass FROM post""")
def a4(spark, sf):
    return M.posterior(prior(spark, sf), coverage(spark, sf)).withColumn("mass", R9("mass"))


ZONE_SQL = """("row"//16)*32+col//16"""
cte("post_zones", f"""SELECT mission_id, scenario, {ZONE_SQL} AS zone_id, sum(p1) AS value FROM post WHERE "row">=0 GROUP BY ALL""")


def post_zones(spark, sf):
    return M.zone_sum(M.posterior(prior(spark, sf), coverage(spark, sf)), M.SCENARIO)


@query("a1_zone_sum", "SELECT mission_id, scenario, zone_id, round(value,9) AS value FROM post_zones")
def a1(spark, sf):
    return post_zones(spark, sf).withColumn("value", R9("value"))


@query("a5_consensus", "SELECT mission_id, zone_id, round(CASE WHEN count(*)=3 AND min(value)>0 THEN exp(avg(ln(value))) ELSE 0 END*0.35,9) AS score FROM post_zones GROUP BY ALL")
def a5(spark, sf):
    return M.consensus(post_zones(spark, sf), ["mission_id", "zone_id"]).select("mission_id", "zone_id", R9(F.col("consensus") * 0.35).alias("score"))


@query("a6_agreement", "SELECT mission_id, zone_id, round(CASE WHEN count(*)=3 THEN min(value)/max(value) ELSE 0 END,9) AS agreement FROM post_zones GROUP BY ALL")
def a6(spark, sf):
    return M.agreement(post_zones(spark, sf), ["mission_id", "zone_id"]).withColumn("agreement", R9("agreement"))


cte("cell_keys", """SELECT mission_id, "row", col FROM mass WHERE "row">=0 UNION SELECT mission_id, "row", col FROM effort""")
cte("cell_terrain", f"""SELECT mission_id, "row", col, {A.TERRAIN_SQL} FROM cell_keys""")


def mission_terrain(mass, cov):
    keys = mass.where("row >= 0").select("mission_id", "row", "col").union(cov.select("mission_id", "row", "col")).distinct()
    return A.cell_terrain(keys)


cte("zone_hazard", f"""SELECT mission_id, {ZONE_SQL} AS zone_id, count(*) FILTER (landcover IN (80,0) OR slope>30)/256.0::DOUBLE AS hazard_share FROM cell_terrain GROUP BY ALL""")
cte("zone_track", f"""SELECT mission_id, {ZONE_SQL} AS zone_id, max(effort*15)>0.05 AS has_track FROM effort GROUP BY ALL""")
cte("zone_mass", f"""SELECT mission_id, {ZONE_SQL} AS zone_id, sum(sw*mass) AS prior_poa, sum(sw*p0) AS poa0, sum(sw*p1) AS poa1, sum(sw*p2) AS poa2, sum(sw*mass*(1-exp(-effort*8))) AS pos0,
 sum(sw*mass*(1-exp(-effort*15))) AS pos1, sum(sw*mass*(1-exp(-effort*22))) AS pos2, sum(CASE WHEN scenario='a' THEN p1 ELSE 0 END) AS sa, sum(CASE WHEN scenario='b' THEN p1 ELSE 0 END) AS sb,
 sum(CASE WHEN scenario='b2' THEN p1 ELSE 0 END) AS sc FROM (SELECT *, {SW} AS sw FROM post WHERE "row">=0) GROUP BY ALL""")
cte("zone_all", """SELECT m.mission_id, z.zone_id FROM (SELECT DISTINCT mission_id FROM cell_keys) m, (SELECT unnest(generate_series(0,1023)) AS zone_id) z""")
cte("zone_scored", """SELECT a.mission_id, a.zone_id, coalesce(prior_poa,0) AS prior_poa, coalesce(poa0,0) AS poa0, coalesce(poa1,0) AS poa1, coalesce(poa2,0) AS poa2, coalesce(pos0,0) AS pos0, coalesce(pos1,0) AS pos1, coalesce(pos2,0) AS pos2,
 coalesce(hazard_share,0) AS hazard_share, coalesce(has_track,false) AS has_track, coalesce(sa,0) AS sa, coalesce(sb,0) AS sb, coalesce(sc,0) AS sc,
 CASE WHEN coalesce(hazard_share,0)<0.02 AND least(sa,sb,sc)>0 THEN exp((ln(sa)+ln(sb)+ln(sc))/3)*0.35 ELSE 0 END AS score
 FROM zone_all a LEFT JOIN zone_mass USING (mission_id, zone_id) LEFT JOIN zone_hazard USING (mission_id, zone_id) LEFT JOIN zone_track USING (mission_id, zone_id)""")
cte("zones", """SELECT *, CASE WHEN hazard_share<0.02 THEN 'REVIEW_REQUIRED' ELSE 'AGENCY_ONLY' END AS access,
 chr((65+(zone_id//32)//26)::INT)||lpad(((zone_id//32)%26+1)::VARCHAR,2,'0')||'-'||lpad((zone_id%32+1)::VARCHAR,2,'0') AS label FROM
 (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY printf('%.11e', score)::DOUBLE DESC, zone_id) AS rank FROM zone_scored) WHERE prior_poa>=1e-7 OR has_track""")


def zones(spark, sf):
    # the coverage table has three readers; it is stored, as a mission version stores it
    m, c = prior(spark, sf), cut_lineage(coverage(spark, sf), "coverage")
    return M.zone_cards(m, c, mission_terrain(m, c))


CARD = """SELECT mission_id, zone_id, label, round(poa1,8) AS poa, round(least(poa0,poa1,poa2),8) AS poa_min, round(greatest(poa0,poa1,poa2),8) AS poa_max, round(prior_poa,8) AS prior_poa,
 round(CASE WHEN prior_poa>0 THEN pos0/prior_poa ELSE 0 END,6) AS pod_low, round(CASE WHEN prior_poa>0 THEN pos2/prior_poa ELSE 0 END,6) AS pod_high, round(pos1,8) AS pos, round(sa,8) AS scenario_a,
 round(score,8) AS score, rank, access, has_track FROM zones"""


def card(z):
    r = lambda c: F.round(c, 8).alias(c)
    return z.select(
        "mission_id", "zone_id", "label", r("poa"), r("poa_min"), r("poa_max"), r("prior_poa"), R6("pod_low").alias("pod_low"), R6("pod_high").alias("pod_high"), r("pos"),
        F.round(F.col("scenarios")[0], 8).alias("scenario_a"), r("score"), "rank", "access", "has_track")


@query("a7_zone_cards", CARD)
def a7(spark, sf):
    return card(zones(spark, sf))


@query("zone_board", CARD + " WHERE rank<=30")
def board(spark, sf):
    """Tracks to ranked zones, end to end; the board lists thirty zones per mission."""
    return card(M.top_zones(zones(spark, sf), 30))


@query("w6_rank_zones", "SELECT mission_id, zone_id, rank FROM zones")
def w6(spark, sf):
    return zones(spark, sf).select("mission_id", "zone_id", "rank")


@query("f6_eligible_zones", "SELECT mission_id, access, count(*) AS n, count(*) FILTER (score>0) AS scored FROM zones GROUP BY ALL")
def f6(spark, sf):
    return zones(spark, sf).groupBy("mission_id", "access").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("scored"))


@query("f7_kept_zones", "SELECT mission_id, has_track, count(*) AS n FROM zones GROUP BY ALL")
def f7(spark, sf):
    return zones(spark, sf).groupBy("mission_id", "has_track").agg(F.count(F.lit(1)).alias("n"))


@query("f8_listed_zones", "SELECT mission_id, label, rank FROM zones WHERE (rank<=100 OR has_track) AND contains(label,'A1') AND access<>'AGENCY_ONLY'")
def f8(spark, sf):
    return M.listed_zones(zones(spark, sf), "a1").select("mission_id", "label", "rank")


@query("l1_top_zones", "SELECT mission_id, rank, label FROM zones WHERE rank<=8")
def l1(spark, sf):
    return M.top_zones(zones(spark, sf), 8).select("mission_id", "rank", "label")


@query("a8_mission_totals", f"""WITH t AS (SELECT p.*, {SW} AS sw, landcover=80 AS water FROM post p LEFT JOIN cell_terrain USING (mission_id, "row", col)), c AS (SELECT mission_id, count(*) FILTER (effort*15>0.01)*900/1e6 AS coverage_km2,
 count(DISTINCT CASE WHEN effort*15>0.05 THEN {ZONE_SQL} END) AS searched_zones FROM effort GROUP BY 1)
 SELECT mission_id, round(sum(p1) FILTER ("row"=-1 AND scenario='a'),8) AS outside_a, round(sum(sw*p1) FILTER ("row"=-1),8) AS outside_mixed, round(coalesce(sum(sw*p1) FILTER (water),0),8) AS water_mass, round(sum(sw*p1) FILTER ("row">=0),8) AS inside_mass,
 round(coalesce(any_value(coverage_km2),0),4) AS coverage_km2, coalesce(any_value(searched_zones),0) AS searched_zones FROM t LEFT JOIN c USING (mission_id) GROUP BY mission_id""")
def a8(spark, sf):
    m, c = prior(spark, sf), coverage(spark, sf)
    t = M.mission_totals(m, c, mission_terrain(m, c))
    r = lambda n: F.round(n, 8).alias(n)
    return t.select("mission_id", r("outside_a"), r("outside_mixed"), r("water_mass"), r("inside_mass"), F.round("coverage_km2", 4).alias("coverage_km2"), "searched_zones")


@query("w7_mass_region", """SELECT mission_id, "row", col, count(*) AS votes FROM (SELECT *, sum(mass) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(mass) OVER (PARTITION BY mission_id, scenario) AS total FROM mass WHERE "row">=0
 WINDOW w AS (PARTITION BY mission_id, scenario ORDER BY mass DESC, "row", col)) WHERE coalesce(before,0) < total*0.5-1e-12 GROUP BY ALL""")
def w7(spark, sf):
    # sums of equal counts meet the target exactly, so both sides allow for the last digit
    m = prior(spark, sf)
    return M.region_votes(m, 0.5 - 1e-12)


@query("l6_layer_strength", f"""WITH x AS (SELECT mission_id, "row", col, sum({SW}*mass) AS m FROM mass WHERE "row">=0 GROUP BY ALL) SELECT mission_id, "row", col, round(pow(least(m/greatest(q,1e-12),1),0.65),6) AS strength FROM x JOIN (SELECT mission_id, quantile_cont(m,0.97) AS q FROM x GROUP BY 1) USING (mission_id)""")
def l6(spark, sf):
    return M.layer_strength(M.mixture(prior(spark, sf)), ["mission_id"]).select("mission_id", "row", "col", R6("strength").alias("strength"))


@query("a43_check_mass", "SELECT mission_id, scenario, bool_and(isfinite(mass) AND mass>=-1e-12) AND abs(sum(mass)-1)<=1e-8 AS ok FROM mass GROUP BY ALL")
def a43(spark, sf):
    return M.check_mass(prior(spark, sf))


cte("prior_zones", f"""SELECT mission_id, zone_id, row_number() OVER (PARTITION BY mission_id ORDER BY v DESC, zone_id) AS rank FROM (SELECT mission_id, {ZONE_SQL} AS zone_id, round(sum({SW}*mass),9) AS v FROM mass WHERE "row">=0 GROUP BY ALL)""")


@query("j7_previous_rank", "SELECT z.mission_id, z.zone_id, z.rank, p.rank AS previous_rank FROM zones z LEFT JOIN prior_zones p USING (mission_id, zone_id)")
def j7(spark, sf):
    from pyspark.sql import Window as W

    p = M.zone_sum(M.mixture(prior(spark, sf)), ["mission_id"]).withColumn("v", R9("value"))
    p = p.withColumn("rank", F.row_number().over(W.partitionBy("mission_id").orderBy(F.desc("v"), "zone_id")))
    return M.with_previous_rank(zones(spark, sf), p).select("mission_id", "zone_id", "rank", F.col("previous_rank").cast("bigint").alias("previous_rank"))


cte("decisions", """SELECT mission_id, zone_id, arg_max(status, k) AS status FROM (SELECT o_custkey%25 AS mission_id, (14+o_orderkey%5)*32+14+o_custkey%5 AS zone_id, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'HELD' ELSE 'PROPOSED' END AS status, o_orderkey AS k FROM orders) GROUP BY ALL""")


@query("j8_decisions", "SELECT mission_id, zone_id, coalesce(status,'PROPOSED') AS decision FROM zones LEFT JOIN decisions USING (mission_id, zone_id)")
def j8(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    d = table(spark, sf, "orders").select(
        (c % 25).alias("mission_id"), ((o % 5 + 14) * 32 + 14 + c % 5).alias("zone_id"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "HELD").otherwise("PROPOSED").alias("status"), o.alias("k"))
    d = d.groupBy("mission_id", "zone_id").agg(F.max_by("status", "k").alias("status"))
    return M.with_decisions(zones(spark, sf), d).select("mission_id", "zone_id", "decision")
