"""Shape the given tables into tracks, incidents, terrain cells and mission logs.

Every adapter is integer arithmetic on a table's own keys, written once for Spark and once as a SQL CTE,
so both sides of a check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.ordered import choose_block, ordered_scan
from .registry import cte, table

BIG = "bigint"


def track_block(spark: SparkSession, sf: str) -> int | None:
    """Scan plan for the tracks of this table: plain windows unless one track is very large."""
    return choose_block(table(spark, sf, "events"), ["user_id"])


# ---------------------------------------------------------------- searcher fixes
def fixes(spark: SparkSession, sf: str, block: int | None = None) -> DataFrame:
    e = F.col("event_id")
    steps = table(spark, sf, "events").select(
        F.col("user_id").alias("track_id"),
        e.alias("seq"),
        F.when(e % 53 == 0, 0).when(e % 37 == 0, 200).otherwise(15 + (e * 7) % 46).cast(BIG).alias("dt"),
        F.when(e % 61 == 0, 400).otherwise((e * 31) % 81 - 40).cast(BIG).alias("dx"),
        ((e * 17) % 81 - 40).cast(BIG).alias("dy"),
        ((e * 13) % 9 - 4).cast(BIG).alias("dz"),
    )
    run = ordered_scan(
        steps, ["track_id"], "seq",
        sums={"t_s": F.col("dt"), "x_m": F.col("dx"), "y_m": F.col("dy"), "climb": F.col("dz")}, block=block,
    )
    return run.select(
        "track_id", "seq", F.col("t_s").cast(BIG).alias("t_s"), F.col("x_m").cast(BIG).alias("x_m"),
        F.col("y_m").cast(BIG).alias("y_m"), (F.col("climb") + 100).cast(BIG).alias("elev"),
        (F.lit(33.4) + F.col("y_m") / 111200.0).alias("lat"), (F.lit(126.3) + F.col("x_m") / 92600.0).alias("lon"),
        (F.lit(256.0) - F.col("y_m") / 30.0).alias("row"), (F.lit(256.0) + F.col("x_m") / 30.0).alias("col"),
        (F.col("track_id") % 12).alias("team_id"),
        F.element_at(F.array(*[F.lit(t) for t in ("hasty", "sweep", "paired")]), (F.col("track_id") % 3 + 1).cast("int")).alias("search_type"),
    )


cte("fix_steps", """SELECT user_id AS track_id, event_id AS seq,
 CASE WHEN event_id%53=0 THEN 0 WHEN event_id%37=0 THEN 200 ELSE 15+(event_id*7)%46 END AS dt,
 CASE WHEN event_id%61=0 THEN 400 ELSE (event_id*31)%81-40 END AS dx, (event_id*17)%81-40 AS dy, (event_id*13)%9-4 AS dz FROM events""")
cte("fixes", """SELECT track_id, seq, t_s, x_m, y_m, elev, 33.4::DOUBLE + y_m/111200.0::DOUBLE AS lat, 126.3::DOUBLE + x_m/92600.0::DOUBLE AS lon,
 256.0::DOUBLE - y_m/30.0::DOUBLE AS "row", 256.0::DOUBLE + x_m/30.0::DOUBLE AS col, track_id%12 AS team_id,
 CASE track_id%3 WHEN 0 THEN 'hasty' WHEN 1 THEN 'sweep' ELSE 'paired' END AS search_type
 FROM (SELECT track_id, seq, (sum(dt) OVER w)::BIGINT AS t_s, (sum(dx) OVER w)::BIGINT AS x_m, (sum(dy) OVER w)::BIGINT AS y_m,
  (100 + sum(dz) OVER w)::BIGINT AS elev FROM fix_steps WINDOW w AS (PARTITION BY track_id ORDER BY seq))""")


# ---------------------------------------------------------------- ordinary walking points
def walk_points(spark: SparkSession, sf: str, block: int | None = None) -> DataFrame:
    e = F.col("event_id")
    steps = table(spark, sf, "events").select(
        F.col("user_id").alias("track_id"),
        e.alias("seq"),
        F.when(e % 197 == 0, 0).when(e % 211 == 0, 40).otherwise(5 + (e * 7) % 9).cast(BIG).alias("dt"),
        F.when(e % 223 == 0, 90).otherwise(3 + (e * 31) % 9).cast(BIG).alias("dx"),
        ((e * 17) % 13 - 6).cast(BIG).alias("dy"),
    )
    run = ordered_scan(steps, ["track_id"], "seq", sums={"t": F.col("dt"), "x": F.col("dx"), "y": F.col("dy")}, block=block)
    t = F.col("track_id")
    return run.select(
        (t % 40).alias("person"), "track_id", "seq", (F.col("t") + (t % 60) * 700).cast(BIG).alias("t_s"),
        (F.lit(39.9) + (F.col("y") + (t % 60) * 50) / 111200.0).alias("lat"),
        (F.lit(116.3) + F.col("x") / 92600.0).alias("lon"),
    )


cte("walk_steps", """SELECT user_id AS track_id, event_id AS seq, CASE WHEN event_id%197=0 THEN 0 WHEN event_id%211=0 THEN 40 ELSE 5+(event_id*7)%9 END AS dt,
 CASE WHEN event_id%223=0 THEN 90 ELSE 3+(event_id*31)%9 END AS dx, (event_id*17)%13-6 AS dy FROM events""")
cte("walk_points", """SELECT track_id%40 AS person, track_id, seq, t + (track_id%60)*700 AS t_s,
 39.9::DOUBLE + (y + (track_id%60)*50)/111200.0::DOUBLE AS lat, 116.3::DOUBLE + x/92600.0::DOUBLE AS lon
 FROM (SELECT track_id, seq, (sum(dt) OVER w)::BIGINT AS t, (sum(dx) OVER w)::BIGINT AS x, (sum(dy) OVER w)::BIGINT AS y
  FROM walk_steps WINDOW w AS (PARTITION BY track_id ORDER BY seq))""")


def mode_labels(points: DataFrame) -> DataFrame:
    """Closed label intervals per track: hourly walk or bus, and some overlapping walks."""
    k = F.floor(F.col("t_s") / 900).cast(BIG)
    hours = points.select("track_id", k.alias("k")).distinct()
    mode = F.when((F.col("track_id") + F.col("k")) % 5 == 0, "bus").otherwise("walk")
    base = hours.select("track_id", (F.col("k") * 900).alias("start"), (F.col("k") * 900 + 899).alias("end"), mode.alias("mode"))
    extra = hours.where((F.col("track_id") + F.col("k")) % 7 == 0).select(
        "track_id", (F.col("k") * 900 + 300).alias("start"), (F.col("k") * 900 + 420).alias("end"), F.lit("walk").alias("mode")
    )
    return base.unionByName(extra)


cte("label_hours", "SELECT DISTINCT track_id, t_s//900 AS k FROM walk_points")
cte("mode_labels", """SELECT track_id, k*900 AS "start", k*900+899 AS "end", CASE WHEN (track_id+k)%5=0 THEN 'bus' ELSE 'walk' END AS mode FROM label_hours
 UNION ALL SELECT track_id, k*900+300, k*900+420, 'walk' FROM label_hours WHERE (track_id+k)%7=0""")


# ---------------------------------------------------------------- prior draws and mass
SCENARIO = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'a' WHEN o_orderpriority='3-MEDIUM' THEN 'b' ELSE 'b2' END"


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted position draws per mission and scenario; some lie outside the window."""
    o = F.col("o_orderkey")
    c = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        (c % 25).alias("mission_id"),
        F.expr(SCENARIO).alias("scenario"),
        F.when(o % 10 == 0, F.lit(-5.5)).otherwise(F.lit(224.5) + c % 64).alias("row"),
        (F.lit(224.25) + o % 64).alias("col"),
    )


cte("draws", f"""SELECT o_custkey%25 AS mission_id, {SCENARIO} AS scenario,
 CASE WHEN o_orderkey%10=0 THEN -5.5::DOUBLE ELSE 224.5::DOUBLE + o_custkey%64 END AS "row", 224.25::DOUBLE + o_orderkey%64 AS col FROM orders""")
cte("draw_cells", """SELECT mission_id, scenario, CASE WHEN "row">=0 AND "row"<512 AND col>=0 AND col<512 THEN floor("row")::BIGINT ELSE -1 END AS "row",
 CASE WHEN "row">=0 AND "row"<512 AND col>=0 AND col<512 THEN floor(col)::BIGINT ELSE -1 END AS col FROM draws""")
cte("mass", """SELECT mission_id, scenario, "row", col, n::DOUBLE / sum(n) OVER (PARTITION BY mission_id, scenario) AS mass
 FROM (SELECT mission_id, scenario, "row", col, count(*) AS n FROM draw_cells GROUP BY 1,2,3,4)""")


def cell_terrain(cells: DataFrame) -> DataFrame:
    """Terrain attributes of given cells (row, col), by rule."""
    r, c = F.col("row"), F.col("col")
    k = (r * 5 + c * 3) % 401
    return cells.withColumn("landcover", F.when(k == 7, 80).when(k == 11, 0).when(k % 4 == 0, 10).when(k % 4 == 1, 20).when(k % 4 == 2, 40).otherwise(30).cast(BIG)).withColumn(
        "slope", ((r * 7 + c * 11) % 31).cast("double")
    ).withColumn("road_distance", (((r + 2 * c) % 9) * 30).cast("double"))


TERRAIN_SQL = """CASE WHEN ("row"*5+col*3)%401=7 THEN 80 WHEN ("row"*5+col*3)%401=11 THEN 0 WHEN (("row"*5+col*3)%401)%4=0 THEN 10
 WHEN (("row"*5+col*3)%401)%4=1 THEN 20 WHEN (("row"*5+col*3)%401)%4=2 THEN 40 ELSE 30 END::BIGINT AS landcover,
 (("row"*7+col*11)%31)::DOUBLE AS slope, ((("row"+2*col)%9)*30)::DOUBLE AS road_distance"""


# ---------------------------------------------------------------- terrain windows, one cell per order
SIDE = 64


def terrain(spark: SparkSession, sf: str) -> DataFrame:
    """Dense 64 x 64 windows: one cell per order key."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    row, col = F.floor(o % (SIDE * SIDE) / SIDE).cast(BIG), o % SIDE
    return table(spark, sf, "orders").select(
        F.floor(o / (SIDE * SIDE)).cast(BIG).alias("window_id"), row.alias("row"), col.alias("col"),
        ((row * 7 + col * 3) % 23 + c % 7).cast("double").alias("dem"),
        F.when(c % 61 == 0, 80).when(c % 83 == 0, 0).when(c % 4 == 0, 10).when(c % 4 == 1, 20).when(c % 4 == 2, 40).otherwise(30).cast(BIG).alias("landcover"),
        ((c % 9) * 30).cast("double").alias("road_distance"),
        F.when(c % 47 == 0, 50.0).otherwise((c % 29).cast("double")).alias("slope"),
    )


cte("terrain", """SELECT o_orderkey//4096 AS window_id, (o_orderkey%4096)//64 AS "row", o_orderkey%64 AS col,
 (((o_orderkey%4096)//64*7 + o_orderkey%64*3)%23 + o_custkey%7)::DOUBLE AS dem,
 CASE WHEN o_custkey%61=0 THEN 80 WHEN o_custkey%83=0 THEN 0 WHEN o_custkey%4=0 THEN 10 WHEN o_custkey%4=1 THEN 20 WHEN o_custkey%4=2 THEN 40 ELSE 30 END::BIGINT AS landcover,
 ((o_custkey%9)*30)::DOUBLE AS road_distance, CASE WHEN o_custkey%47=0 THEN 50.0::DOUBLE ELSE (o_custkey%29)::DOUBLE END AS slope FROM orders""")


# ---------------------------------------------------------------- facilities
POI_TAGS = [
    ("ECONOMY", "shop", "convenience"), ("LARGE", "amenity", "cafe"), ("STANDARD", "highway", "bus_stop"),
    ("MEDIUM", "amenity", "drinking_water"), ("PROMO", "tourism", "hotel"),
]


def poi(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    key, val = F.lit("office"), F.lit("yes")
    for kind, k, v in POI_TAGS:
        key, val = F.when(F.col("p_type") == kind, k).otherwise(key), F.when(F.col("p_type") == kind, v).otherwise(val)
    return table(spark, sf, "part").select(
        F.concat(F.lit("node/"), p.cast("string")).alias("osm_id"),
        F.create_map(key, val, F.lit("name"), F.col("p_name")).alias("tags"),
        F.when(F.col("p_size") % 10 == 0, "private").when(F.col("p_size") % 10 == 1, "no").otherwise("unknown").alias("access"),
        F.floor(p / 512).cast(BIG).alias("window_id"),
        (F.floor((p * 37) % 4096 / SIDE) + 0.5).alias("row"),
        ((p * 37) % SIDE + 0.25).alias("col"),
    )


cte("poi", """SELECT 'node/'||p_partkey AS osm_id, CASE p_type WHEN 'ECONOMY' THEN 'supplies' WHEN 'LARGE' THEN 'food' WHEN 'STANDARD' THEN 'transit' WHEN 'MEDIUM' THEN 'water'
 WHEN 'PROMO' THEN 'shelter' END AS category, p_name AS name, CASE WHEN p_size%10=0 THEN 'private' WHEN p_size%10=1 THEN 'no' ELSE 'unknown' END AS access,
 p_partkey//512 AS window_id, ((p_partkey*37)%4096)//64 + 0.5::DOUBLE AS "row", (p_partkey*37)%64 + 0.25::DOUBLE AS col FROM part""")


# ---------------------------------------------------------------- incidents
def incidents(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = F.lit(36.0) + (k * 7919 % 4000) / 1000.0
    lon = F.lit(-119.0) + (k * 6007 % 5000) / 1000.0
    far = F.when(k % 29 == 0, 0.25).otherwise(0.0)
    return table(spark, sf, "customer").select(
        k.alias("incident_index"), lat.alias("ipp_lat"), lon.alias("ipp_lon"),
        (lat + ((k * 31) % 401 - 200) / 10000.0 + 0.00003 + far).alias("find_lat"),
        (lon + ((k * 17) % 331 - 165) / 10000.0).alias("find_lon"),
    )


cte("incidents", """SELECT c_custkey AS incident_index, 36.0::DOUBLE + (c_custkey*7919%4000)/1000.0::DOUBLE AS ipp_lat, -119.0::DOUBLE + (c_custkey*6007%5000)/1000.0::DOUBLE AS ipp_lon,
 36.0::DOUBLE + (c_custkey*7919%4000)/1000.0::DOUBLE + ((c_custkey*31)%401-200)/10000.0::DOUBLE + 0.00003::DOUBLE + CASE WHEN c_custkey%29=0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS find_lat,
 -119.0::DOUBLE + (c_custkey*6007%5000)/1000.0::DOUBLE + ((c_custkey*17)%331-165)/10000.0::DOUBLE AS find_lon FROM customer""")


def endpoint_links(spark: SparkSession, sf: str) -> DataFrame:
    """Endpoint pairs with the faults the screening looks for."""
    k = F.col("incident_index")
    i = incidents(spark, sf)
    case = F.when(k % 19 == 1, k - 1).otherwise(k)
    return i.select(
        k.alias("objectid"), case.alias("case_a"), F.when(k % 23 == 0, k + 1).otherwise(case).alias("case_b"),
        F.when(k % 31 == 0, "LKP").otherwise("IPP").alias("type_a"), F.lit("Found").alias("type_b"),
        F.when(k % 37 == 0, F.lit(None)).otherwise(F.col("ipp_lon")).alias("lon_a"), F.col("ipp_lat").alias("lat_a"),
        F.when(k % 41 == 0, F.lit(200.0)).when(k % 59 == 0, F.col("ipp_lon")).otherwise(F.col("find_lon")).alias("lon_b"),
        F.when(k % 59 == 0, F.col("ipp_lat")).otherwise(F.col("find_lat")).alias("lat_b"),
        F.when(k % 61 == 0, 2).otherwise(1).alias("n_paths"), F.when(k % 61 == 0, 4).when(k % 67 == 0, 3).otherwise(2).alias("n_vertices"),
        F.when(k % 43 == 0, 0.0).otherwise((5 + k % 120).cast("double")).alias("err_a"), (3 + k % 60).cast("double").alias("err_b"),
    )


cte("endpoint_links", """SELECT incident_index AS objectid, CASE WHEN incident_index%19=1 THEN incident_index-1 ELSE incident_index END AS case_a,
 CASE WHEN incident_index%23=0 THEN incident_index+1 WHEN incident_index%19=1 THEN incident_index-1 ELSE incident_index END AS case_b,
 CASE WHEN incident_index%31=0 THEN 'LKP' ELSE 'IPP' END AS type_a, 'Found' AS type_b,
 CASE WHEN incident_index%37=0 THEN NULL ELSE ipp_lon END AS lon_a, ipp_lat AS lat_a, CASE WHEN incident_index%41=0 THEN 200.0::DOUBLE WHEN incident_index%59=0 THEN ipp_lon ELSE find_lon END AS lon_b, CASE WHEN incident_index%59=0 THEN ipp_lat ELSE find_lat END AS lat_b,
 CASE WHEN incident_index%61=0 THEN 2 ELSE 1 END AS n_paths, CASE WHEN incident_index%61=0 THEN 4 WHEN incident_index%67=0 THEN 3 ELSE 2 END AS n_vertices,
 CASE WHEN incident_index%43=0 THEN 0.0::DOUBLE ELSE (5+incident_index%120)::DOUBLE END AS err_a, (3+incident_index%60)::DOUBLE AS err_b FROM incidents""")

# ---------------------------------------------------------------- shared SQL expressions
HAV = lambda a, b, c, d: (
    f"(2*6371008.8::DOUBLE*asin(sqrt(least(greatest(pow(sin((radians({c})-radians({a}))/2),2)"
    f"+cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2),2),0.0),1.0))))"
)
FLAG = """CASE WHEN dt<=0 THEN 'NONINCREASING_TIME' WHEN dt>120 THEN 'GAP_OVER_120S' WHEN dist>250 THEN 'JUMP_OVER_250M'
 WHEN dist/nullif(dt,0)>3 THEN 'SPEED_OVER_3MPS' WHEN dist/nullif(dt,0) IS NULL THEN 'NONFINITE_SPEED' ELSE 'CANDIDATE' END"""
cte("fix_lag", """SELECT *, lag(t_s) OVER w AS p_t, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(elev) OVER w AS p_elev, lag(x_m) OVER w AS p_x, lag(y_m) OVER w AS p_y,
 lag(seq) OVER w AS p_seq FROM fixes WINDOW w AS (PARTITION BY track_id ORDER BY seq)""")
cte("pairs", f"""SELECT *, dist/nullif(dt,0) AS speed, CASE WHEN dist>0 THEN (elev-p_elev)/dist END AS grade, {FLAG} AS quality_flag
 FROM (SELECT *, t_s-p_t AS dt, {HAV('p_lat','p_lon','lat','lon')} AS dist FROM fix_lag WHERE p_seq IS NOT NULL)""")
