"""Keys, hashes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c


def case_key(prefix: str, key) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(prefix + ":"), _c(key).cast("string")), 256), 1, 20)


def block_key(lon, lat, deg: float) -> Column:
    """Spatial block: whole degrees as lat:lon, tenths as lon:lat (the published keys differ)."""

    def part(v):
        return F.floor(_c(v) if deg == 1 else _c(v) * round(1 / deg)).cast("bigint").cast("string")

    return F.concat_ws(":", part(lat), part(lon)) if deg == 1 else F.concat_ws(":", part(lon), part(lat))


_MASK = 2**32


def hash_uniform(token, step, seed, salt) -> Column:
    """Counter-based uniform in [0,1): the same key always gives the same draw.

    DECIMAL keeps the products exact; each is brought back below 2^32 at once.
    """

    def dec(v):
        return _c(v).cast("decimal(20,0)")

    def times(v, m):
        return (F.pmod(dec(v) * F.lit(m).cast("decimal(11,0)"), F.lit(_MASK).cast("decimal(20,0)"))).cast("bigint")

    def mix(v, shift):
        return v.bitwiseXOR(F.shiftright(v, shift))

    x = (times(token, 747796405) + times(step, 2891336453) + times(seed, 277803737) + times(salt, 1597334677)) % _MASK
    x = times(mix(x, 16), 2246822519)
    x = times(mix(x, 13), 3266489917)
    return mix(x, 16).cast("double") / float(_MASK)


def point_json(lon, lat) -> Column:
    """[lon,lat] at six decimals, without a negative zero, as JSON."""

    def number(v):
        r = F.round(v, 6)
        return F.when(r == 0, F.lit(0.0)).otherwise(r)

    return F.to_json(F.array(number(_c(lon)), number(_c(lat))))


def geometry_hash(points) -> Column:
    """SHA-256 of an array of segments, each an array of struct<lon, lat, ...>, at six decimals.

    Times do not take part, so the same path recorded twice has one hash.
    """

    def number(v):
        r = F.round(v, 6)
        return F.when(r == 0, F.lit(0.0)).otherwise(r)

    seg = lambda s: F.transform(s, lambda p: F.array(number(p["lon"]), number(p["lat"])))
    return F.sha2(F.to_json(F.transform(_c(points), seg)), 256)


def filename_tokens(name) -> Column:
    """struct<course, letter, direction>; NULL when the name does not match as a whole."""
    n = F.regexp_extract(_c(name), r"([^/]*)$", 1)
    pat = r"^t(\d+[a-z]?)([A-Z])_(up|down)\.las\.las$"
    return F.when(
        n.rlike(pat),
        F.struct(
            F.regexp_extract(n, pat, 1).alias("course"),
            F.regexp_extract(n, pat, 2).alias("letter"),
            F.regexp_extract(n, pat, 3).alias("direction"),
        ),
    )


def normalize_code(s) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(_c(s), F.lit(""))), r"[^\p{L}\p{N}]", "")


def source_role(dataset, path) -> Column:
    p = _c(path)
    return (
        F.when(p.contains("MOESM1"), "EXCLUDED_SYNTHETIC_NOT_REAL_TRAJECTORY")
        .when(p.contains("MOESM2"), "EXCLUDED_FITTED_ON_TARGET_LEAKAGE")
        .when(_c(dataset) == "cyprus_exercise_2022", "EXTERNAL_EXERCISE_QA_NOT_LOST_PERSON_TRAINING")
        .when(p.contains("MOESM3"), "REAL_ENDPOINT_TRAINING")
        .when(p.endswith("SARsearchertracks.csv"), "SEARCHER_SPEED_TRAINING")
        .otherwise("PROVENANCE_AND_DOCUMENTATION")
    )
