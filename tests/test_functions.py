import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo, movement, textfn, timefn


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("v")).first()[0]


def test_haversine_null_and_zero(spark):
    assert one(spark, geo.haversine(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0
    assert one(spark, geo.haversine(F.lit(None).cast("double"), F.lit(2.0), F.lit(1.0), F.lit(2.0))) is None
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371008.8)


def test_displacement_across_the_dateline(spark):
    d = one(spark, geo.displacement(F.lit(0.0), F.lit(179.9995), F.lit(0.0), F.lit(-179.9995)))
    assert d["dx"] == pytest.approx(math.radians(0.001) * 6371008.8) and d["dy"] == 0


def test_geodesic_known_line_and_round_trip(spark):
    # Flinders Peak to Buninyong, the published test line (GRS80)
    a = (-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600)
    b = (-(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600)
    g = one(spark, geo.geodesic_inverse(*[F.lit(float(v)) for v in (*a, *b)], "GRS80"))
    assert g["dist_m"] == pytest.approx(54972.271, abs=0.001)
    assert g["bearing"] == pytest.approx(306 + 52 / 60 + 5.37 / 3600, abs=1e-5)
    back = one(spark, geo.geodesic_direct(F.lit(a[0]), F.lit(a[1]), F.lit(g["bearing"]), F.lit(g["dist_m"]), "GRS80"))
    assert back["lat"] == pytest.approx(b[0], abs=1e-9) and back["lon"] == pytest.approx(b[1], abs=1e-9)


def test_utm_central_meridian_and_round_trip(spark):
    u = one(spark, geo.utm_fwd(F.lit(129.0), F.lit(0.0)))
    assert u["x"] == pytest.approx(500000) and u["y"] == pytest.approx(0, abs=1e-6)
    u = one(spark, geo.utm_fwd(F.lit(126.268), F.lit(33.397)))
    b = one(spark, geo.utm_inv(F.lit(u["x"]), F.lit(u["y"])))
    assert (b["lon"], b["lat"]) == (pytest.approx(126.268, abs=1e-10), pytest.approx(33.397, abs=1e-10))


def test_outside_points_keep_the_sentinel(spark):
    rows = [(-2.0, 0.0), (0.0, 0.0), (513.0, 500.0), (511.0, 511.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "row double, col double").select(geo.cell_of("row", "col")).collect()]
    assert got == [262144, 0, 262144, 511 * 512 + 511]


def test_team_band(spark):
    b = one(spark, movement.team_band(F.lit(6), F.lit(15.0)))
    assert (b["width"], b["rows"], b["mult"]) == (75.0, 2, 6)
    assert one(spark, movement.team_band(F.lit(4), F.lit(10.0)))["rows"] == 1
    assert one(spark, movement.team_band(F.lit(13), F.lit(15.0))) is None


def test_solar(spark):
    alt = one(spark, timefn.solar_elevation(F.to_timestamp(F.lit("2024-03-20 12:00:00")), F.lit(0.0), F.lit(0.0)))
    assert alt > 85
    ph = [one(spark, timefn.light_phase(F.lit(float(a)))) for a in (0, -3, -6)]
    assert ph == ["DAY", "TWILIGHT", "NIGHT"]


def test_aware_times(spark):
    f = lambda s: one(spark, F.unix_seconds(timefn.parse_aware(F.lit(s))))
    assert f("2024-01-01T00:00:00Z") == f("2024-01-01T09:00:00+09:00") == 1704067200
    assert f("2024-01-01T00:00:00") is None and f("nonsense") is None


def test_log_ndtr_against_erfc(spark):
    z = [-30.0, -12.0, -6.0, -3.0, -0.7, -0.2, 0.0, 0.3, 0.66, 1.0, 3.0, 5.0]
    want = [math.log(math.erfc(-v / math.sqrt(2)) / 2) for v in z]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    got = [r[0] for r in df.select(movement.log_ndtr("z")).collect()]
    hot = [r["o"] for r in movement.add_log_ndtr(df, F.col("z"), "o").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-13, atol=1e-16)
    np.testing.assert_allclose(hot, want, rtol=1e-13, atol=1e-16)


def test_interval_mass(spark):
    mu, s = math.log(1200), 1.2
    phi = lambda x: math.erfc(-(math.log(x) - mu) / s / math.sqrt(2)) / 2
    rows = [(0.0, 20.0), (100.0, 500.0), (900.0, 1500.0), (3000.0, 10000.0)]
    df = spark.createDataFrame(rows, "lo double, hi double")
    want = [math.log(phi(b) - (phi(a) if a else 0)) for a, b in rows]
    got = [r[0] for r in df.select(movement.interval_logprob(F.lit(mu), F.lit(s), "lo", "hi")).collect()]
    hot = [r["o"] for r in movement.add_interval_logprob(df, F.lit(mu), F.lit(s), "lo", "hi", "o").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-10)
    np.testing.assert_allclose(hot, want, rtol=1e-10)
    far = one(spark, movement.interval_logprob(F.lit(mu), F.lit(0.3), F.lit(1e6), F.lit(2e6)))
    assert math.isfinite(far) and far < -70


def test_hash_uniform_matches_unsigned_arithmetic(spark):
    def ref(t, k, seed, salt):
        m = 0xFFFFFFFF
        x = (t * 747796405 + k * 2891336453 + seed * 277803737 + salt * 1597334677) & m
        x = ((x ^ (x >> 16)) * 2246822519) & m
        x = ((x ^ (x >> 13)) * 3266489917) & m
        return (x ^ (x >> 16)) / 4294967296.0

    rows = [(0, 0, 42, 1), (524287, 1800, 42, 2), (123456, 7, 2**31 - 1, 3)]
    df = spark.createDataFrame(rows, "t bigint, k bigint, s bigint, a bigint")
    got = [r[0] for r in df.select(textfn.hash_uniform("t", "k", "s", "a")).collect()]
    assert got == [ref(*r) for r in rows]


def test_polar_and_tile_edges(spark):
    assert one(spark, geo.polar_cell(F.lit(1600.0), F.lit(12.0))) == 6 * 72 + 2
    assert one(spark, geo.polar_cell(F.lit(21000.0), F.lit(12.0))) == 5760
    k = one(spark, geo.tile_key(F.lit(-119.0), F.lit(36.0)))
    assert (k["tlat"], k["tlon"]) == (35, -119)
    k = one(spark, geo.tile_key(F.lit(-119.0 - 1 / 1200), F.lit(36.0 + 1 / 1200)))
    assert (k["tlat"], k["tlon"]) == (36, -120)


def test_clip_keeps_missing_values(spark):
    assert one(spark, geo.clip(F.lit(None).cast("double"), 0, 1)) is None


def test_nearest_region(spark):
    assert one(spark, geo.nearest_region(F.lit(126.27), F.lit(33.41))) == "한림읍"
    assert one(spark, geo.nearest_region(F.lit(float("nan")), F.lit(33.4))) == "제주"
