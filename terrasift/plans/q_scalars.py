"""Queries for the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, movement, textfn, timefn
from . import adapters as A
from .registry import query, table

R6 = lambda c: F.round(c, 6)
X0, Y0 = 240000.0, 3700000.0


# ---- UTM in SQL, from the same published series ----
_BA, _E, _AL, _BE, _DE = geo._krueger()


def utm_fwd_sql(lon, lat):
    phi, lam = f"radians({lat})", f"radians(({lon})-129.0)"
    t = f"sinh(atanh(sin({phi}))-{_E!r}*atanh({_E!r}*sin({phi})))"
    xi, eta = f"atan2({t},cos({lam}))", f"atanh(sin({lam})/sqrt(1+({t})*({t})))"
    return xi, eta


def utm_inv_cte(src, x, y, keep):
    """A chain of two subqueries giving lon and lat."""
    sc = 0.9996 * _BA
    u = "xi" + "".join(f"-{b!r}::DOUBLE*sin(xi*{2*j})*cosh(eta*{2*j})" for j, b in enumerate(_BE, 1))
    v = "eta" + "".join(f"-{b!r}::DOUBLE*cos(xi*{2*j})*sinh(eta*{2*j})" for j, b in enumerate(_BE, 1))
    phi = "chi" + "".join(f"+{d!r}::DOUBLE*sin(chi*{2*j})" for j, d in enumerate(_DE, 1))
    return f"""(SELECT {keep}, 129.0::DOUBLE + degrees(atan2(sinh(v),cos(u))) AS lon, degrees({phi}) AS lat FROM
 (SELECT *, asin(sin(u)/cosh(v)) AS chi FROM (SELECT *, {u} AS u, {v} AS v FROM
 (SELECT *, ({y})/{sc!r}::DOUBLE AS xi, (({x})-500000.0)/{sc!r}::DOUBLE AS eta FROM {src}))))"""


@query("p1_haversine", f"""SELECT incident_index, round({A.HAV('ipp_lat','ipp_lon','find_lat','find_lon')},4) AS dist_m FROM incidents""")
def p1(spark, sf):
    return A.incidents(spark, sf).select("incident_index", F.round(geo.haversine("ipp_lat", "ipp_lon", "find_lat", "find_lon"), 4).alias("dist_m"))


@query("p2_displacement", """SELECT incident_index,
 round(radians((((find_lon*3-ipp_lon*3+180.0)%360.0+360.0)%360.0)-180.0)*6371008.8::DOUBLE*cos(radians((ipp_lat+find_lat)/2)),4) AS dx,
 round(radians(find_lat-ipp_lat)*6371008.8::DOUBLE,4) AS dy FROM incidents""")
def p2(spark, sf):
    d = geo.displacement("ipp_lat", F.col("ipp_lon") * 3, "find_lat", F.col("find_lon") * 3)
    return A.incidents(spark, sf).select("incident_index", d.alias("d")).select(
        "incident_index", F.round("d.dx", 4).alias("dx"), F.round("d.dy", 4).alias("dy"))


def _vincenty_sql(steps=10):
    a, f = geo.ELLIPSOIDS["WGS84"]
    b = a * (1 - f)
    base = f"""v0 AS (SELECT incident_index, ipp_lat, ipp_lon, find_lat, find_lon, atan({1-f!r}*tan(radians(ipp_lat))) AS u1, atan({1-f!r}*tan(radians(find_lat))) AS u2,
 radians(find_lon-ipp_lon) AS ell, radians(find_lon-ipp_lon) AS lam FROM incidents)"""
    parts = [base]
    for i in range(steps):
        parts.append(f"""t{i} AS (SELECT *, sqrt(pow(cos(u2)*sin(lam),2)+pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(lam),2)) AS ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(lam) AS cs FROM v{i})""")
        parts.append(f"""w{i} AS (SELECT *, atan2(ss,cs) AS sig, cos(u1)*cos(u2)*sin(lam)/ss AS sa FROM t{i})""")
        parts.append(f"""x{i} AS (SELECT *, 1-sa*sa AS c2a, cs-2*sin(u1)*sin(u2)/(1-sa*sa) AS c2m, {f/16!r}*(1-sa*sa)*(4+{f!r}*(4-3*(1-sa*sa))) AS cc FROM w{i})""")
        last = i == steps - 1
        if not last:
            parts.append(f"""v{i+1} AS (SELECT incident_index, ipp_lat, ipp_lon, find_lat, find_lon, u1, u2, ell, ell+(1-cc)*{f!r}*sa*(sig+cc*ss*(c2m+cc*cs*(2*c2m*c2m-1))) AS lam FROM x{i})""")
    e2 = (a * a - b * b) / (b * b)
    parts.append(f"""y AS (SELECT *, c2a*{e2!r} AS uu FROM x{steps-1})""")
    parts.append("""z AS (SELECT *, 1+uu/16384*(4096+uu*(-768+uu*(320-175*uu))) AS ba, uu/1024*(256+uu*(-128+uu*(74-47*uu))) AS bb FROM y)""")
    return "WITH " + ",\n".join(parts) + f""" SELECT incident_index, round({b!r}*ba*(sig-bb*ss*(c2m+bb/4*(cs*(2*c2m*c2m-1)-bb/6*c2m*(4*ss*ss-3)*(4*c2m*c2m-3)))),3) AS dist_m,
 round(find_lat,7) AS lat_back, round(find_lon,7) AS lon_back FROM z"""


@query("p3_geodesic", _vincenty_sql())
def p3(spark, sf):
    i = A.incidents(spark, sf)
    g = i.withColumn("g", geo.geodesic_inverse("ipp_lat", "ipp_lon", "find_lat", "find_lon"))
    back = geo.geodesic_direct("ipp_lat", "ipp_lon", F.col("g.bearing"), F.col("g.dist_m"))
    return g.withColumn("b", back).select(
        "incident_index", F.round("g.dist_m", 3).alias("dist_m"), F.round("b.lat", 7).alias("lat_back"), F.round("b.lon", 7).alias("lon_back"))


_XI, _ETA = utm_fwd_sql("lon", "lat")
_FX = "eta" + "".join(f"+{a!r}::DOUBLE*cos(xi*{2*j})*sinh(eta*{2*j})" for j, a in enumerate(_AL, 1))
_FY = "xi" + "".join(f"+{a!r}::DOUBLE*sin(xi*{2*j})*cosh(eta*{2*j})" for j, a in enumerate(_AL, 1))


@query("p4_utm", f"""SELECT track_id, seq, round(500000.0+({_FX})*{0.9996*_BA!r}::DOUBLE,4) AS x, round(({_FY})*{0.9996*_BA!r}::DOUBLE,4) AS y,
 round(lon,7) AS lon_back, round(lat,7) AS lat_back FROM (SELECT track_id, seq, lon, lat, {_XI} AS xi, {_ETA} AS eta FROM fixes)""")
def p4(spark, sf):
    f = A.fixes(spark, sf).withColumn("u", geo.utm_fwd("lon", "lat"))
    return f.withColumn("b", geo.utm_inv("u.x", "u.y")).select(
        "track_id", "seq", F.round("u.x", 4).alias("x"), F.round("u.y", 4).alias("y"),
        F.round("b.lon", 7).alias("lon_back"), F.round("b.lat", 7).alias("lat_back"))


@query("p5_cell", """SELECT mission_id, scenario, CASE WHEN "row">=0 AND "row"<512 AND col>=0 AND col<512 THEN floor("row")::BIGINT*512+floor(col)::BIGINT ELSE 262144 END AS cell, count(*) AS n FROM draws GROUP BY ALL""")
def p5(spark, sf):
    return A.draws(spark, sf).withColumn("cell", geo.cell_of("row", "col")).groupBy("mission_id", "scenario", "cell").agg(F.count(F.lit(1)).alias("n"))


@query("p6_zone", """WITH z AS (SELECT mission_id, scenario, "row", col, (floor("row")::BIGINT//16)*32+floor(col)::BIGINT//16 AS zone_id FROM draws WHERE "row">=0)
 SELECT zone_id, chr((65+(zone_id//32)//26)::INT)||lpad(((zone_id//32)%26+1)::VARCHAR,2,'0')||'-'||lpad((zone_id%32+1)::VARCHAR,2,'0') AS label, count(*) AS n FROM z GROUP BY ALL""")
def p6(spark, sf):
    d = A.draws(spark, sf).where(geo.inside("row", "col")).withColumn("zone_id", geo.zone_of("row", "col"))
    return d.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n")).withColumn("label", geo.zone_label("zone_id"))


@query("p7_window_origin", """SELECT k, CASE WHEN ok THEN least(greatest(round_even((r-256)/64.0,0)*64,0),2688)::BIGINT END AS row0, CASE WHEN ok THEN least(greatest(round_even((c-256)/64.0,0)*64,0),1856)::BIGINT END AS col0,
 floor((126.0+c/1000.0::DOUBLE)*100)/100 AS lo, ceil((126.0+c/1000.0::DOUBLE)*100)/100 AS hi
 FROM (SELECT *, r>=0 AND r<3200 AND c>=0 AND c<2368 AS ok FROM (SELECT o_orderkey AS k, ((o_custkey*32)%3456-64)::DOUBLE AS r, ((o_orderkey*13)%2500-50)::DOUBLE AS c FROM orders))""")
def p7(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), ((F.col("o_custkey") * 32) % 3456 - 64).cast("double").alias("r"), ((F.col("o_orderkey") * 13) % 2500 - 50).cast("double").alias("c"))
    v = F.lit(126.0) + F.col("c") / 1000.0
    return o.withColumn("w", geo.window_origin("r", "c")).withColumn("b", geo.outward_box(v, v)).select(
        "k", "w.row0", "w.col0", F.col("b.lo").cast("double").alias("lo"), F.col("b.hi").cast("double").alias("hi"))


def _corner(alias, dr, dc):
    return f"{alias} AS (SELECT zone_id, round(lon,7) AS lon, round(lat,7) AS lat FROM {utm_inv_cte('zs', f'240000.0+((zone_id%32)*16+{dc})*30.0', f'3700000.0-((zone_id//32)*16+{dr})*30.0', 'zone_id')})"


@query("p8_zone_ring", f"""WITH zs AS (SELECT DISTINCT (floor("row")::BIGINT//16)*32+floor(col)::BIGINT//16 AS zone_id FROM draws WHERE "row">=0),
 {_corner('ca',0,0)}, {_corner('cb',16,16)} SELECT zone_id, 5::BIGINT AS n, ca.lon AS nw_lon, ca.lat AS nw_lat, cb.lon AS se_lon, cb.lat AS se_lat, true AS closed FROM ca JOIN cb USING (zone_id)""")
def p8(spark, sf):
    z = A.draws(spark, sf).where(geo.inside("row", "col")).select(geo.zone_of("row", "col").alias("zone_id")).distinct()
    r = z.withColumn("ring", geo.zone_ring("zone_id", F.lit(X0), F.lit(Y0)))
    return r.select(
        "zone_id", F.size("ring").cast("bigint").alias("n"), F.round(F.col("ring")[0]["lon"], 7).alias("nw_lon"), F.round(F.col("ring")[0]["lat"], 7).alias("nw_lat"),
        F.round(F.col("ring")[2]["lon"], 7).alias("se_lon"), F.round(F.col("ring")[2]["lat"], 7).alias("se_lat"), (F.col("ring")[0] == F.col("ring")[4]).alias("closed"))


FACTOR_SQL = "CASE WHEN road_distance<30 THEN 1.05::DOUBLE WHEN landcover=10 THEN 0.48::DOUBLE WHEN landcover=20 THEN 0.65::DOUBLE WHEN landcover=40 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"
HAZ_SQL = "(landcover=80 OR slope>30 OR landcover=0)"


@query("p9_ground", f"""SELECT window_id, {FACTOR_SQL} AS factor, landcover=80 AS water, {HAZ_SQL} AS hazard, count(*) AS n FROM terrain GROUP BY ALL""")
def p9(spark, sf):
    return A.terrain(spark, sf).select(
        "window_id", geo.ground_factor("landcover", "road_distance").alias("factor"), geo.is_water("landcover").alias("water"), geo.is_hazard("landcover", "slope").alias("hazard")
    ).groupBy("window_id", "factor", "water", "hazard").agg(F.count(F.lit(1)).alias("n"))


@query("p10_walk_speed", f"""SELECT window_id, "row", col, round(least(greatest(1.667::DOUBLE*exp(-3.5::DOUBLE*abs((dem-20)/30.0::DOUBLE+0.05::DOUBLE))*({FACTOR_SQL})*0.42::DOUBLE,0.025::DOUBLE),2.0::DOUBLE),6) AS speed FROM terrain""")
def p10(spark, sf):
    return A.terrain(spark, sf).select(
        "window_id", "row", "col", R6(geo.walk_speed(F.col("dem") - 20, F.lit(30.0), geo.ground_factor("landcover", "road_distance"))).alias("speed"))


@query("p11_solar", f"""SELECT k, round(alt,6) AS alt, CASE WHEN alt>=0 THEN 'DAY' WHEN alt>-6 THEN 'TWILIGHT' ELSE 'NIGHT' END AS phase, round(0.6+0.4*least(greatest((alt+6)/6,0.0),1.0),6) AS factor FROM
 (SELECT k, 229.18::DOUBLE*(0.000075::DOUBLE+0.001868::DOUBLE*cos(g)-0.032077::DOUBLE*sin(g)-0.014615::DOUBLE*cos(2*g)-0.040849::DOUBLE*sin(2*g)) AS eq,
  0.006918::DOUBLE-0.399912::DOUBLE*cos(g)+0.070257::DOUBLE*sin(g)-0.006758::DOUBLE*cos(2*g)+0.000907::DOUBLE*sin(2*g)-0.002697::DOUBLE*cos(3*g)+0.00148::DOUBLE*sin(3*g) AS dec,
  degrees(asin(least(greatest(sin(radians(lat))*sin(dec)+cos(radians(lat))*cos(dec)*cos(radians(((((h*60+eq+4*126.3::DOUBLE)%1440.0)+1440.0)%1440.0)/4-180)),-1.0),1.0))) AS alt FROM
  (SELECT o_orderkey AS k, (o_orderkey%1440)/60.0::DOUBLE AS h, (o_custkey%120-60)::DOUBLE AS lat, 2*pi()/CASE WHEN year(o_orderdate)%4=0 AND (year(o_orderdate)%100<>0 OR year(o_orderdate)%400=0) THEN 366.0::DOUBLE ELSE 365.0::DOUBLE END
   *(dayofyear(o_orderdate)-1+((o_orderkey%1440)/60.0::DOUBLE-12)/24) AS g FROM orders))""")
def p11(spark, sf):
    o = table(spark, sf, "orders")
    alt = timefn.solar_elevation_at(
        F.year("o_orderdate"), F.dayofyear("o_orderdate"), (F.col("o_orderkey") % 1440) / 60.0, (F.col("o_custkey") % 120 - 60).cast("double"), F.lit(126.3))
    return o.select(F.col("o_orderkey").alias("k"), alt.alias("a")).select(
        "k", R6(F.col("a")).alias("alt"), timefn.light_phase("a").alias("phase"), R6(timefn.light_factor("a", 0.6)).alias("factor"))


@query("p12_poi_category", "SELECT osm_id, category, name FROM poi")
def p12(spark, sf):
    return A.poi(spark, sf).select("osm_id", geo.poi_category("tags").alias("category"), geo.poi_name("tags").alias("name"))


@query("p14_attraction", """SELECT o_orderkey AS k, round(CASE WHEN o_custkey%9<>0 THEN least(greatest(8.0::DOUBLE*0.6::DOUBLE*((o_orderkey%100)/100.0::DOUBLE-(o_custkey%100)/100.0::DOUBLE),-0.7::DOUBLE),0.7::DOUBLE) ELSE 0.0::DOUBLE END,6) AS bias FROM orders""")
def p14(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(o.alias("k"), R6(geo.attraction((c % 100) / 100.0, (o % 100) / 100.0, 0.6, c % 9 != 0)).alias("bias"))


@query("p15_detection", """SELECT o_orderkey AS k, round(1-exp(-o_totalprice/100000.0::DOUBLE),6) AS pod, round(exp(-o_totalprice/100000.0::DOUBLE),6) AS survive FROM orders""")
def p15(spark, sf):
    c = F.col("o_totalprice") / 100000.0
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), R6(movement.detect(c)).alias("pod"), R6(movement.survive(c)).alias("survive"))


@query("p17_team_band", """SELECT k, CASE WHEN ok THEN (n-1)*s END AS width, CASE WHEN ok THEN CASE WHEN n>1 THEN greatest(1,round_even((n-1)*s/30.0::DOUBLE,0))::BIGINT ELSE 1 END END AS rows_, CASE WHEN ok THEN n END AS mult
 FROM (SELECT *, n BETWEEN 1 AND 12 AND s BETWEEN 3 AND 60 AS ok FROM (SELECT o_orderkey AS k, o_custkey%15 AS n, (o_orderkey%70)::DOUBLE AS s FROM orders))""")
def p17(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), movement.team_band(F.col("o_custkey") % 15, (F.col("o_orderkey") % 70).cast("double")).alias("b")
    ).select("k", "b.width", F.col("b.rows").alias("rows_"), "b.mult")


_VEC = """(SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey%121-60)::DOUBLE AS dx0, (l_suppkey%97-48)::DOUBLE AS dy0, ((l_quantity-25)*3)::DOUBLE AS dx1, ((l_linenumber-4)*9)::DOUBLE AS dy1 FROM lineitem)"""


@query("p18_speed_bin", f"""SELECT CASE WHEN v<0.25 THEN 0 WHEN v<0.75 THEN 1 WHEN v<1.25 THEN 2 WHEN v<1.75 THEN 3 WHEN v<2.5 THEN 4 ELSE 5 END::BIGINT AS bin, count(*) AS n FROM (SELECT sqrt(dx0*dx0+dy0*dy0)/30 AS v FROM {_VEC}) GROUP BY 1""")
def p18(spark, sf):
    v = F.sqrt(F.pow((F.col("l_partkey") % 121 - 60).cast("double"), 2) + F.pow((F.col("l_suppkey") % 97 - 48).cast("double"), 2)) / 30
    return table(spark, sf, "lineitem").select(movement.speed_bin(v).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("p19_turn_class", f"""SELECT bin*9+turn AS joint, count(*) AS n FROM (SELECT CASE WHEN v1<0.25 THEN 0 WHEN v1<0.75 THEN 1 WHEN v1<1.25 THEN 2 WHEN v1<1.75 THEN 3 WHEN v1<2.5 THEN 4 ELSE 5 END::BIGINT AS bin,
 CASE WHEN v0<0.25 OR v1<0.25 THEN 8 ELSE floor((((atan2(dy1,dx1)-atan2(dy0,dx0)+pi()/8)%(2*pi())+2*pi())%(2*pi()))/(pi()/4))::BIGINT END AS turn
 FROM (SELECT *, sqrt(dx0*dx0+dy0*dy0)/30 AS v0, sqrt(dx1*dx1+dy1*dy1)/30 AS v1 FROM {_VEC})) GROUP BY 1""")
def p19(spark, sf):
    d = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 121 - 60).cast("double").alias("dx0"), (F.col("l_suppkey") % 97 - 48).cast("double").alias("dy0"),
        ((F.col("l_quantity") - 25) * 3).alias("dx1"), ((F.col("l_linenumber") - 4) * 9).cast("double").alias("dy1"))
    d = d.withColumn("v0", F.sqrt(F.col("dx0") ** 2 + F.col("dy0") ** 2) / 30).withColumn("v1", F.sqrt(F.col("dx1") ** 2 + F.col("dy1") ** 2) / 30)
    turn = movement.turn_class(movement.heading("dx0", "dy0"), movement.heading("dx1", "dy1"), "v0", "v1")
    return d.select(movement.joint_class(movement.speed_bin("v1"), turn).alias("joint")).groupBy("joint").agg(F.count(F.lit(1)).alias("n"))


@query("p20_dates", """SELECT event_id, 1704067200+event_id*61 AS from_days, CASE event_id%3 WHEN 0 THEN 1704067200+event_id*61 WHEN 1 THEN 1704067200+event_id*61-32400 END AS from_iso, 1704067200+event_id*61 AS from_label FROM events""")
def p20(spark, sf):
    e = F.col("event_id")
    ts = F.timestamp_seconds(F.lit(1704067200) + e * 61)
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(e % 3 == 0, "Z").when(e % 3 == 1, "+09:00").otherwise(""))
    days = (F.lit(1704067200) + e * 61) / 86400.0 + 25569
    return table(spark, sf, "events").select(
        "event_id", timefn.excel_to_epoch(days).alias("from_days"), F.unix_seconds(timefn.parse_aware(iso)).alias("from_iso"),
        F.unix_seconds(timefn.parse_label_stamp(F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))).alias("from_label"))


@query("p21_korean_time", """SELECT event_id, 1704067200+event_id*61-32400 AS utc_s, 1704067200+event_id*61+32400 AS kst_s, round(((event_id%4000)*36+5)/3600.0::DOUBLE,2) AS hours FROM events""")
def p21(spark, sf):
    e = F.col("event_id")
    ts = F.timestamp_seconds(F.lit(1704067200) + e * 61)
    later = F.timestamp_seconds(F.lit(1704067200) + e * 61 + (e % 4000) * 36 + 5)
    return table(spark, sf, "events").select(
        "event_id", F.unix_seconds(timefn.kst_to_utc(ts)).alias("utc_s"), F.unix_seconds(timefn.utc_to_kst(ts)).alias("kst_s"), F.round(timefn.elapsed_hours(ts, later), 2).alias("hours"))


@query("p22_elapsed_hours", """SELECT event_id, CASE WHEN event_id%7<>0 THEN round((event_id%700)*61/3600.0::DOUBLE,6) END AS hours,
 CASE WHEN event_id%7=0 THEN 'MISSING_START' WHEN (event_id%700)*61/3600.0::DOUBLE NOT BETWEEN 0.25 AND 8 THEN 'OUT_OF_RANGE' END AS reason FROM events""")
def p22(spark, sf):
    e = F.col("event_id")
    start = F.when(e % 7 != 0, F.timestamp_seconds(F.lit(1704067200) + e))
    end = F.timestamp_seconds(F.lit(1704067200) + e + (e % 700) * 61)
    return table(spark, sf, "events").select("event_id", R6(timefn.elapsed_hours(start, end)).alias("hours"), timefn.elapsed_check(start, end).alias("reason"))


@query("p23_case_key", "SELECT c_custkey, substr(sha256('CASE:'||c_custkey),1,20) AS case_key FROM customer")
def p23(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", textfn.case_key("CASE", "c_custkey").alias("case_key"))


@query("p24_block_keys", """SELECT incident_index, floor(ipp_lat)::BIGINT||':'||floor(ipp_lon)::BIGINT AS degree_block, floor(find_lon*10)::BIGINT||':'||floor(find_lat*10)::BIGINT AS tenth_block FROM incidents""")
def p24(spark, sf):
    return A.incidents(spark, sf).select(
        "incident_index", textfn.block_key("ipp_lon", "ipp_lat", 1).alias("degree_block"), textfn.block_key("find_lon", "find_lat", 0.1).alias("tenth_block"))


@query("p25_interval", """SELECT incident_index, s AS scale, round(greatest(0.0,d-u*s),4) AS lower_m, round(d+u*s,4) AS upper_m FROM
 (SELECT incident_index, round(%s,4) AS d, (5+incident_index%%120)::DOUBLE*20 AS u FROM incidents), (VALUES (0.5::DOUBLE),(1.0::DOUBLE),(2.0::DOUBLE)) t(s)""" % A.HAV('ipp_lat','ipp_lon','find_lat','find_lon'))
def p25(spark, sf):
    i = A.incidents(spark, sf).select("incident_index", F.round(geo.haversine("ipp_lat", "ipp_lon", "find_lat", "find_lon"), 4).alias("d"), ((5 + F.col("incident_index") % 120) * 20.0).alias("u"))
    i = i.withColumn("scale", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)))).withColumn("b", movement.interval("d", "u", F.col("scale")))
    return i.select("incident_index", "scale", F.round("b.lower", 4).alias("lower_m"), F.round("b.upper", 4).alias("upper_m"))


@query("p26_speed_features", """SELECT track_id, seq, round(abs(grade),6) AS abs_grade, (search_type='hasty')::INT::DOUBLE AS is_hasty, (search_type='sweep')::INT::DOUBLE AS is_sweep, (search_type='paired')::INT::DOUBLE AS is_paired
 FROM pairs WHERE grade IS NOT NULL AND abs(grade)<=1""")
def p26(spark, sf):
    from ..operators import tracks

    s = tracks.consecutive(A.fixes(spark, sf)).withColumn("f", movement.speed_features("grade", "search_type"))
    return s.where("f IS NOT NULL").select("track_id", "seq", R6(F.col("f.abs_grade")).alias("abs_grade"), "f.is_hasty", "f.is_sweep", "f.is_paired")


@query("p27_hash_uniform", """WITH a AS (SELECT l_orderkey AS token, l_partkey AS step, l_suppkey AS salt, l_linenumber, (l_orderkey::HUGEINT*747796405+l_partkey::HUGEINT*2891336453+42::HUGEINT*277803737+l_suppkey::HUGEINT*1597334677)%4294967296 AS x FROM lineitem),
 b AS (SELECT *, ((xor(x::BIGINT,x::BIGINT>>16))::HUGEINT*2246822519)%4294967296 AS y FROM a), c AS (SELECT *, ((xor(y::BIGINT,y::BIGINT>>13))::HUGEINT*3266489917)%4294967296 AS z FROM b)
 SELECT token, step, salt, round(xor(z::BIGINT,z::BIGINT>>16)/4294967296.0::DOUBLE,9) AS u FROM c""")
def p27(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("token"), F.col("l_partkey").alias("step"), F.col("l_suppkey").alias("salt"),
        F.round(textfn.hash_uniform("l_orderkey", "l_partkey", F.lit(42), "l_suppkey"), 9).alias("u"))


TILE_NAME = """'Copernicus_DSM_COG_30_'||CASE WHEN tlat>=0 THEN 'N' ELSE 'S' END||lpad(abs(tlat)::VARCHAR,2,'0')||'_00_'||CASE WHEN tlon>=0 THEN 'E' ELSE 'W' END||lpad(abs(tlon)::VARCHAR,3,'0')||'_00_DEM'"""


@query("p28_tile_key", f"""SELECT incident_index, {TILE_NAME} AS tile FROM (SELECT incident_index, floor(round(ipp_lat,3)-1/2400.0::DOUBLE)::BIGINT AS tlat, floor(round(ipp_lon,3)+1/2400.0::DOUBLE)::BIGINT AS tlon FROM incidents)""")
def p28(spark, sf):
    i = A.incidents(spark, sf).withColumn("k", geo.tile_key(F.round("ipp_lon", 3), F.round("ipp_lat", 3)))
    return i.select("incident_index", geo.tile_name("k.tlat", "k.tlon").alias("tile"))


POLAR_SQL = f"""(SELECT incident_index, ipp_lat, ipp_lon, find_lat, find_lon, d, CASE WHEN d>=20000 THEN 5760 ELSE floor(d/250)::BIGINT*72+floor(b/5)::BIGINT END AS cell FROM (SELECT *, {A.HAV('ipp_lat','ipp_lon','find_lat','find_lon')} AS d,
 ((degrees(atan2((find_lon-ipp_lon)*cos(radians((ipp_lat+find_lat)/2)),find_lat-ipp_lat))%360.0)+360.0)%360.0 AS b FROM incidents))"""


@query("p29_polar_cell", f"""SELECT incident_index, cell, CASE WHEN cell<5760 THEN round(pi()*62500.0/72*(2*(cell//72)+1),4) END AS area FROM {POLAR_SQL}""")
def p29(spark, sf):
    return polar_labels(A.incidents(spark, sf)).select(
        "incident_index", "cell", F.when(F.col("cell") < geo.POLAR_CELLS, F.round(geo.polar_area("cell"), 4)).alias("area"))


def polar_labels(inc):
    """Target cell of each incident, on the sphere."""
    d = geo.haversine("ipp_lat", "ipp_lon", "find_lat", "find_lon")
    b = F.degrees(F.atan2((F.col("find_lon") - F.col("ipp_lon")) * F.cos(F.radians((F.col("ipp_lat") + F.col("find_lat")) / 2)), F.col("find_lat") - F.col("ipp_lat")))
    return inc.withColumn("d", d).withColumn("cell", geo.polar_cell("d", b))


@query("p30_terrain_features", """SELECT o_orderkey AS k, round(least(greatest((o_custkey-o_orderkey%3000)/500.0::DOUBLE,-4.0),4.0),6) AS rise,
 round(least(greatest(degrees(atan(sqrt(pow((o_custkey%70-o_orderkey%50)/180.0::DOUBLE,2)+pow((o_custkey%90-o_orderkey%40)/180.0::DOUBLE,2))))/30,0.0),3.0),6) AS steep FROM orders""")
def p30(spark, sf):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(o.alias("k"), geo.terrain_features(c, o % 3000, c % 70, o % 50, c % 90, o % 40).alias("f")).select(
        "k", R6(F.col("f.rise")).alias("rise"), R6(F.col("f.steep")).alias("steep"))


@query("p31_geometry_hash", """SELECT track_id, sha256('[['||string_agg('['||round(lon,6)||','||round(lat,6)||']', ',' ORDER BY seq)||']]') AS geometry_sha FROM fixes GROUP BY track_id""")
def p31(spark, sf):
    from ..operators import tracks

    return tracks.path_hashes(A.fixes(spark, sf))


@query("p32_filename_tokens", """WITH n AS (SELECT doc_id, 't'||doc_id%40||CASE WHEN doc_id%3=0 THEN 'a' ELSE '' END||chr((65+doc_id%26)::INT)||'_'||CASE doc_id%5 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'up' WHEN 3 THEN 'flat' ELSE 'down' END||'.las.las' AS name FROM documents)
 SELECT doc_id, nullif(regexp_extract(name,'^t(\\d+[a-z]?)([A-Z])_(up|down)\\.las\\.las$',1),'') AS course, nullif(regexp_extract(name,'^t(\\d+[a-z]?)([A-Z])_(up|down)\\.las\\.las$',2),'') AS letter,
 nullif(regexp_extract(name,'^t(\\d+[a-z]?)([A-Z])_(up|down)\\.las\\.las$',3),'') AS direction FROM n""")
def p32(spark, sf):
    d = F.col("doc_id")
    name = F.concat(
        F.lit("archive/t"), (d % 40).cast("string"), F.when(d % 3 == 0, "a").otherwise(""), F.char(65 + d % 26), F.lit("_"),
        F.element_at(F.array(*[F.lit(x) for x in ("up", "down", "up", "flat", "down")]), (d % 5 + 1).cast("int")), F.lit(".las.las"))
    return table(spark, sf, "documents").select("doc_id", textfn.filename_tokens(name).alias("t")).select("doc_id", "t.course", "t.letter", "t.direction")


@query("p33_code_lookup", """SELECT c_custkey AS asked, c_custkey AS found FROM customer WHERE c_custkey%3<>0""")
def p33(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    stored = c.select(F.col("c_custkey").alias("found"), F.sha2(textfn.normalize_code("c_name"), 256).alias("code_hash"))
    typed = F.concat(F.lower("c_name"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(" - "))
    asked = c.select(F.col("c_custkey").alias("asked"), F.sha2(textfn.normalize_code(typed), 256).alias("code_hash"))
    return asked.join(stored, "code_hash").select("asked", "found")


@query("p34_decay", "SELECT o_orderkey AS k, round(exp(-(o_totalprice/100.0::DOUBLE)/900.0::DOUBLE),6) AS decay FROM orders")
def p34(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), R6(geo.decay(F.col("o_totalprice") / 100.0)).alias("decay"))


@query("p35_distance_density", f"""SELECT incident_index, round(-ln(d)-ln(0.7)-0.5*ln(2*pi())-pow((ln(d)-ln(2436.9))/0.7,2)/2,6) AS log_lognorm, round(ln(d)-2*ln(2705.8)-pow(d/2705.8,2)/2,6) AS log_rayleigh,
 round(2436.9*exp(0.7*1.6448536269514722),4) AS r95, round(2705.8*sqrt(-2*ln(0.05)),4) AS ray95 FROM (SELECT incident_index, {A.HAV('ipp_lat','ipp_lon','find_lat','find_lon')} AS d FROM incidents)""")
def p35(spark, sf):
    import math

    d = A.incidents(spark, sf).select("incident_index", geo.haversine("ipp_lat", "ipp_lon", "find_lat", "find_lon").alias("d"))
    mu, s, scale = F.lit(math.log(2436.9)), F.lit(0.7), F.lit(2705.8)
    return d.select(
        "incident_index", R6(movement.lognormal_logpdf("d", mu, s)).alias("log_lognorm"), R6(movement.rayleigh_logpdf("d", scale)).alias("log_rayleigh"),
        F.round(movement.lognormal_radius(mu, s, 1.6448536269514722), 4).alias("r95"), F.round(movement.rayleigh_radius(scale, 0.95), 4).alias("ray95"))


def _poly_sql(cs, x):
    out = f"{cs[0]!r}::DOUBLE"
    for c in cs[1:]:
        out = f"({out}*{x}+{c!r}::DOUBLE)"
    return out


def log_ndtr_sql(z):
    y, y2 = f"(abs({z})/{2**0.5!r})", f"(abs({z})*abs({z})/2)"
    inv = f"(1/greatest({y2},1e-300))"
    small = f"ln((1+sign({z})*{y}*{_poly_sql(movement.ERF_NUM, y2)}/{_poly_sql(movement.ERF_DEN, y2)})/2)"
    mid = f"{_poly_sql(movement.MID_NUM, y)}/{_poly_sql(movement.MID_DEN, y)}"
    far = f"({(1/3.141592653589793**0.5)!r}-{inv}*{_poly_sql(movement.FAR_NUM, inv)}/{_poly_sql(movement.FAR_DEN, inv)})/greatest({y},1e-150)"
    sc = f"(CASE WHEN {y}<=4 THEN {mid} ELSE {far} END)"
    return f"(CASE WHEN {y}<=0.46875 THEN {small} WHEN ({z})<0 THEN ln({sc}/2)-{y2} ELSE ln(1-exp(-{y2})*{sc}/2) END)"


def interval_logprob_sql(mu, sigma, lo, hi):
    zl, zu = f"((ln(greatest({lo},1e-9))-{mu})/{sigma})", f"((ln({hi})-{mu})/{sigma})"
    return (f"(CASE WHEN {lo}<=0 THEN {log_ndtr_sql(zu)} WHEN {zl}>0 THEN {log_ndtr_sql('(-'+zl+')')}+ln(1-exp({log_ndtr_sql('(-'+zu+')')}-{log_ndtr_sql('(-'+zl+')')}))"
            f" ELSE {log_ndtr_sql(zu)}+ln(1-exp({log_ndtr_sql(zl)}-{log_ndtr_sql(zu)})) END)")


@query("p36_interval_logprob", f"""SELECT incident_index, round({interval_logprob_sql('ln(1200.0::DOUBLE)','1.2::DOUBLE','lo','hi')},6) AS logp FROM
 (SELECT incident_index, greatest(0.0,round(d,4)-u) AS lo, round(d,4)+u AS hi FROM (SELECT incident_index, {A.HAV('ipp_lat','ipp_lon','find_lat','find_lon')} AS d, (5+incident_index%120)::DOUBLE*20 AS u FROM incidents))""")
def p36(spark, sf):
    import math

    i = A.incidents(spark, sf).select("incident_index", F.round(geo.haversine("ipp_lat", "ipp_lon", "find_lat", "find_lon"), 4).alias("d"), ((5 + F.col("incident_index") % 120) * 20.0).alias("u"))
    b = i.withColumn("b", movement.interval("d", "u"))
    return b.select("incident_index", R6(movement.interval_logprob(F.lit(math.log(1200.0)), F.lit(1.2), "b.lower", "b.upper")).alias("logp"))


@query("p37_source_role", """WITH f AS (SELECT page_id, CASE page_id%6 WHEN 0 THEN 'x/MOESM1_ESM.csv' WHEN 1 THEN 'x/MOESM2_ESM.csv' WHEN 2 THEN 'x/MOESM3_ESM.csv' WHEN 3 THEN 'y/SARsearchertracks.csv' ELSE url END AS path,
 CASE WHEN page_id%7=0 THEN 'cyprus_exercise_2022' ELSE 'other' END AS ds FROM pages)
 SELECT role, count(*) AS n FROM (SELECT CASE WHEN contains(path,'MOESM1') THEN 'EXCLUDED_SYNTHETIC_NOT_REAL_TRAJECTORY' WHEN contains(path,'MOESM2') THEN 'EXCLUDED_FITTED_ON_TARGET_LEAKAGE'
 WHEN ds='cyprus_exercise_2022' THEN 'EXTERNAL_EXERCISE_QA_NOT_LOST_PERSON_TRAINING' WHEN contains(path,'MOESM3') THEN 'REAL_ENDPOINT_TRAINING' WHEN suffix(path,'SARsearchertracks.csv') THEN 'SEARCHER_SPEED_TRAINING'
 ELSE 'PROVENANCE_AND_DOCUMENTATION' END AS role FROM f) GROUP BY role""")
def p37(spark, sf):
    p = F.col("page_id")
    path = F.when(p % 6 == 0, "x/MOESM1_ESM.csv").when(p % 6 == 1, "x/MOESM2_ESM.csv").when(p % 6 == 2, "x/MOESM3_ESM.csv").when(p % 6 == 3, "y/SARsearchertracks.csv").otherwise(F.col("url"))
    ds = F.when(p % 7 == 0, "cyprus_exercise_2022").otherwise("other")
    return table(spark, sf, "pages").select(textfn.source_role(ds, path).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


_REG = ",".join(f"({i},'{n}',{o!r}::DOUBLE,{a!r}::DOUBLE)" for i, (n, o, a) in enumerate(geo.REGIONS))


@query("p38_nearest_region", f"""SELECT region, count(*) AS n FROM (SELECT track_id, seq, arg_min(name, (sqrt(pow((o-lon)*92.6::DOUBLE,2)+pow((a-lat)*111.2::DOUBLE,2)), i)) AS region FROM
 (SELECT track_id, seq, 126.1::DOUBLE+(seq%97)/100.0::DOUBLE AS lon, 33.2::DOUBLE+(seq%41)/100.0::DOUBLE AS lat FROM fixes), (VALUES {_REG}) r(i,name,o,a) GROUP BY track_id, seq) GROUP BY region""")
def p38(spark, sf):
    s = F.col("event_id")
    lon, lat = F.lit(126.1) + (s % 97) / 100.0, F.lit(33.2) + (s % 41) / 100.0
    return table(spark, sf, "events").select(geo.nearest_region(lon, lat).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n"))
