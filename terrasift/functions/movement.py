"""Speed, turn, detection and distance-model scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grid as G
from .geo import _c, clip


def detect(c) -> Column:
    return -F.expm1(-_c(c))


def survive(c) -> Column:
    return F.exp(-_c(c))


def team_band(n, spacing) -> Column:
    """struct<width, rows, mult> of a searcher line; NULL when size or spacing is out of range."""
    n, s = _c(n).cast("bigint"), _c(spacing).cast("double")
    width = (n - 1) * s
    rows = F.when(n > 1, F.greatest(F.lit(1), F.bround(width / G.CELL))).otherwise(F.lit(1)).cast("bigint")
    ok = n.between(1, G.MAX_TEAM) & s.between(G.MIN_SPACING, G.MAX_SPACING)
    return F.when(ok, F.struct(width.alias("width"), rows.alias("rows"), n.alias("mult")))


def band_sigma(width) -> Column:
    """Lateral standard deviation of a band in cells."""
    return F.greatest(F.lit(0.4), F.sqrt(F.lit(G.GPS_SIGMA_M**2) + F.pow(_c(width), 2) / 12) / G.CELL)


def speed_bin(v) -> Column:
    v = _c(v)
    out = F.lit(0)
    for k, edge in enumerate(G.SPEED_EDGES[1:-1], 1):
        out = F.when(v >= edge, F.lit(k)).otherwise(out)
    return out.cast("bigint")


def heading(dx, dy) -> Column:
    return F.atan2(_c(dy), _c(dx))


def turn_class(h0, h1, v0, v1) -> Column:
    """Eight turn sectors; class 8 when either vector is too slow to have a heading."""
    rel = F.pmod(_c(h1) - _c(h0) + math.pi / 8, F.lit(2 * math.pi))
    k = F.floor(rel / (math.pi / 4)).cast("bigint")
    return F.when((_c(v0) < 0.25) | (_c(v1) < 0.25), F.lit(8).cast("bigint")).otherwise(k)


def joint_class(bin_, turn) -> Column:
    return (_c(bin_) * 9 + _c(turn)).cast("bigint")


def interval(d, u, scale=1.0) -> Column:
    d, u = _c(d), _c(u) * _c(scale)
    return F.struct(F.when(d > u, d - u).when(d <= u, 0.0).alias("lower"), (d + u).alias("upper"))


def speed_features(grade, kind) -> Column:
    """struct of |grade| and one-hot type; NULL outside the grade domain or for an unknown type."""
    g, k = _c(grade), _c(kind)
    ok = k.isin(*G.SEARCH_TYPES) & g.isNotNull() & ~F.isnan(g) & (F.abs(g) <= 1)
    hot = [(k == t).cast("double").alias("is_" + t) for t in G.SEARCH_TYPES]
    return F.when(ok, F.struct(F.abs(g).alias("abs_grade"), *hot))


def lognormal_logpdf(d, mu, sigma) -> Column:
    x = F.ln(_c(d))
    return -x - F.ln(_c(sigma)) - 0.5 * math.log(2 * math.pi) - F.pow((x - _c(mu)) / _c(sigma), 2) / 2


def rayleigh_logpdf(d, scale) -> Column:
    d, s = _c(d), _c(scale)
    return F.ln(d) - 2 * F.ln(s) - F.pow(d / s, 2) / 2


def lognormal_radius(mu, sigma, z: float) -> Column:
    return F.exp(_c(mu) + F.lit(z) * _c(sigma))


def rayleigh_radius(scale, q: float) -> Column:
    return _c(scale) * F.lit(math.sqrt(-2 * math.log(1 - q)))


# --- normal tail: W. J. Cody's published rational approximations (fixed values) ---
ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03]
ERF_DEN = [1.0, 2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03]
MID_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e00, 6.61191906371416295e01, 2.98635138197400131e02,
           8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03]
MID_DEN = [1.0, 1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03,
           3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03]
FAR_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
FAR_DEN = [1.0, 2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]
# --- end of fixed values ---


def _poly(coefs, x) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def _let(value: Column, body) -> Column:
    """Bind a value once: nested rational functions would otherwise repeat it dozens of times."""
    return F.transform(F.array(value), body)[0]


def log_ndtr(z) -> Column:
    """Log of the standard normal CDF, finite and accurate far into the lower tail."""

    def at(z):
        def parts(y):
            y2 = y * y

            def scaled(s):  # s = exp(y^2) * erfc(y)
                return F.when(z < 0, F.ln(s / 2) - y2).otherwise(F.log1p(-F.exp(-y2) * s / 2))

            def far(i):
                return (F.lit(1 / math.sqrt(math.pi)) - i * _poly(FAR_NUM, i) / _poly(FAR_DEN, i)) / y

            small = F.ln((1 + F.signum(z) * y * _poly(ERF_NUM, y2) / _poly(ERF_DEN, y2)) / 2)
            tail = F.when(y <= 4, _poly(MID_NUM, y) / _poly(MID_DEN, y)).otherwise(_let(F.lit(1.0) / F.greatest(y2, F.lit(1.0)), far))
            return F.when(y <= 0.46875, small).otherwise(_let(tail, scaled))

        return _let(F.abs(z) / math.sqrt(2), parts)

    return _let(_c(z).cast("double"), at)


def ndtr(z) -> Column:
    return F.exp(log_ndtr(z))


def interval_logprob(mu, sigma, lo, hi) -> Column:
    """Log mass of a lognormal in (lo, hi]; upper tails use survival differences, lo = 0 is allowed."""
    mu, sigma, lo, hi = map(_c, (mu, sigma, lo, hi))
    zl = F.when(lo > 0, (F.ln(F.when(lo > 0, lo).otherwise(1.0)) - mu) / sigma).otherwise(F.lit(-1e9))
    zu = (F.ln(hi) - mu) / sigma
    # mass = CDF(first) - CDF(second); beyond the median both are taken from the other side
    first = F.when(zl > 0, -zl).otherwise(zu)
    second = F.when(zl > 0, -zu).otherwise(zl)

    def mass(pair):
        return pair[0] + F.ln(-F.expm1(F.least(pair[1] - pair[0], F.lit(-1e-300))))

    both = F.array(log_ndtr(first), F.when(lo > 0, log_ndtr(second)).otherwise(F.lit(-1e300)))
    return _let(both, mass)


def add_log_ndtr(df: DataFrame, z: Column, out: str) -> DataFrame:
    """:func:`log_ndtr` as a chain of plain columns: the form for hot loops, as it stays in generated code."""
    t = "__" + out
    d = df.withColumn(t + "z", z).withColumn(t + "y", F.abs(t + "z") / math.sqrt(2))
    d = d.withColumn(t + "q", F.col(t + "y") * F.col(t + "y")).withColumn(t + "i", F.lit(1.0) / F.greatest(F.col(t + "q"), F.lit(1.0)))
    y, q, i = F.col(t + "y"), F.col(t + "q"), F.col(t + "i")
    small = y * _poly(ERF_NUM, q) / _poly(ERF_DEN, q)
    mid = _poly(MID_NUM, y) / _poly(MID_DEN, y)
    far = (F.lit(1 / math.sqrt(math.pi)) - i * _poly(FAR_NUM, i) / _poly(FAR_DEN, i)) / y
    d = d.withColumn(t + "s", F.when(y <= 0.46875, small).when(y <= 4, mid).otherwise(far))
    s, zz = F.col(t + "s"), F.col(t + "z")
    value = F.when(y <= 0.46875, F.ln((1 + F.signum(zz) * s) / 2)).when(zz < 0, F.ln(s / 2) - q).otherwise(F.log1p(-F.exp(-q) * s / 2))
    return d.withColumn(out, value).drop(*[t + c for c in "zyqis"])


def add_interval_logprob(df: DataFrame, mu, sigma, lo, hi, out: str) -> DataFrame:
    """:func:`interval_logprob` as a chain of plain columns."""
    mu, sigma, lo, hi = map(_c, (mu, sigma, lo, hi))
    t = "__" + out
    d = df.withColumn(t + "l", F.when(lo > 0, (F.ln(F.when(lo > 0, lo).otherwise(1.0)) - mu) / sigma).otherwise(F.lit(-1e9))).withColumn(t + "u", (F.ln(hi) - mu) / sigma)
    zl, zu = F.col(t + "l"), F.col(t + "u")
    d = add_log_ndtr(d, F.when(zl > 0, -zl).otherwise(zu), t + "a")
    d = add_log_ndtr(d, F.when(zl > 0, -zu).otherwise(F.greatest(zl, F.lit(-1e6))), t + "b")
    a, b = F.col(t + "a"), F.when(lo > 0, F.col(t + "b")).otherwise(F.lit(-1e300))
    return d.withColumn(out, a + F.ln(-F.expm1(F.least(b - a, F.lit(-1e-300))))).drop(*[t + c for c in "luab"])
