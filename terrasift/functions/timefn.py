"""Time scalars: aware instants, solar light and Korean local time."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c, clip

AWARE = r"(Z|[+-]\d{2}:?\d{2})$"


def excel_to_ts(days) -> Column:
    """Spreadsheet day number to an instant, rounded to the second."""
    return F.timestamp_seconds(excel_to_epoch(days))


def excel_to_epoch(days) -> Column:
    return F.bround((_c(days) - 25569) * 86400).cast("bigint")


def parse_aware(s) -> Column:
    """ISO text with an offset to a TIMESTAMP; text without an offset or malformed gives NULL."""
    s = F.trim(_c(s))
    return F.when(s.rlike(r"T.*" + AWARE), F.try_to_timestamp(s))


def parse_label_stamp(s) -> Column:
    return F.try_to_timestamp(F.trim(_c(s)), F.lit("yyyy/MM/dd HH:mm:ss"))


def kst_to_utc(local) -> Column:
    return F.to_utc_timestamp(_c(local), "Asia/Seoul")


def utc_to_kst(ts) -> Column:
    return F.from_utc_timestamp(_c(ts), "Asia/Seoul")


def elapsed_hours(start, end) -> Column:
    """Hours between two instants, in fractions of a second."""
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(3.6e9)


def elapsed_check(start, end) -> Column:
    """Reason why a pair of instants is refused, NULL when it is fine."""
    start, end = _c(start), _c(end)
    h = elapsed_hours(start, end)
    return (
        F.when(start.isNull() & end.isNotNull(), "MISSING_START")
        .when(start.isNull(), F.lit(None).cast("string"))
        .when((h < 0.25) | (h > 8), "OUT_OF_RANGE")
    )


def solar_elevation_at(year, yday, hour, lat, lon) -> Column:
    """Geometric altitude of the sun's centre, degrees (NOAA series), from UTC parts."""
    year, yday, hour = _c(year), _c(yday), _c(hour)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    g = F.lit(2 * math.pi) / F.when(leap, 366.0).otherwise(365.0) * (yday - 1 + (hour - 12) / 24)
    eq = F.lit(229.18) * (
        F.lit(0.000075) + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g)
    )
    dec = (
        F.lit(0.006918) - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g)
        + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    )
    angle = F.radians(F.pmod(hour * 60 + eq + 4 * _c(lon), F.lit(1440.0)) / 4 - 180)
    la = F.radians(_c(lat))
    return F.degrees(F.asin(clip(F.sin(la) * F.sin(dec) + F.cos(la) * F.cos(dec) * F.cos(angle), -1, 1)))


def solar_elevation(ts, lat, lon) -> Column:
    """``ts`` is a TIMESTAMP in a UTC session."""
    t = _c(ts)
    hour = F.hour(t) + F.minute(t) / 60.0 + F.extract(F.lit("SECOND"), t).cast("double") / 3600.0
    return solar_elevation_at(F.year(t), F.dayofyear(t), hour, lat, lon)


def light_phase(alt) -> Column:
    alt = _c(alt)
    return F.when(alt >= 0, "DAY").when(alt > -6, "TWILIGHT").otherwise("NIGHT")


def light_factor(alt, night_factor=0.6) -> Column:
    nf = _c(night_factor)
    return nf + (1 - nf) * clip((_c(alt) + 6) / 6, 0, 1)


def refresh_elapsed(age_s, step: int = 15, cap: int = 6 * 3600) -> Column:
    """Forecast age floored to the refresh step and capped; never negative."""
    return F.least((F.floor(F.greatest(_c(age_s), F.lit(0)) / step) * step), F.lit(cap)).cast("bigint")


def refresh_expired(age_s, step: int = 15, cap: int = 6 * 3600) -> Column:
    return F.floor(F.greatest(_c(age_s), F.lit(0)) / step) * step > cap
