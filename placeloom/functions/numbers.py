"""Numbers, dates and geography as native column expressions."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_RADIUS_M = 6_371_000.0


def round_half_up(c: Column, n: int) -> Column:
    return F.round(c.cast("decimal(38,18)"), n)


def divmod_floor(n: Column, d: Column) -> tuple[Column, Column]:
    """Quotient and non-negative remainder."""
    r = F.pmod(n, F.abs(d))
    return ((n - r) / d).cast("long"), r


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere; within 0.5 % of the spheroid."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def metres_to_degrees(metres: Column, latitude: Column) -> Column:
    return metres / (111_320.0 * F.cos(F.radians(latitude)))


def similarity_score(c: Column) -> Column:
    """Rounded to 5 decimals, 1 at most, 0 as 0."""
    return F.when(c >= 1, 1.0).when(c <= 0, 0.0).otherwise(F.round(c, 5))


def parse_float(c: Column) -> Column:
    """Comma or point as the decimal sign, a trailing comma dropped; NaN and text as null."""
    v = F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), ",$", ""), ",", ".").try_cast("double")
    return F.when(~F.isnan(v), v)


def ratio_percent(part: Column, total: Column) -> Column:
    """Percentage with two decimals, 0 for an empty total."""
    return F.when(total == 0, F.lit(0).cast("decimal(38,2)")).otherwise(F.round(part.cast("decimal(20,0)") / F.nullif(total, F.lit(0)).cast("decimal(20,0)") * 100, 2).cast("decimal(38,2)"))


def floor_period(ts: Column, period: str) -> Column:
    """Start of the day, ISO week, month or year."""
    return F.date_trunc({"day": "DAY", "week": "WEEK", "month": "MONTH", "year": "YEAR"}[period], ts)


def shift_period(ts: Column, period: str, n: int) -> Column:
    """The start of the period, n periods later."""
    start = floor_period(ts, period)
    if period in ("day", "week"):
        return (start + F.expr(f"INTERVAL '{n * (7 if period == 'week' else 1)}' DAY")).cast("timestamp")
    return F.add_months(start.cast("date"), n * (12 if period == "year" else 1)).cast("timestamp")


def is_fresh(ts: Column, now: Column, days: int = 30) -> Column:
    return ts > now - F.expr(f"INTERVAL '{days}' DAY")


def point(c: Column) -> Column:
    """struct(lat, lon) of a ``lat,lon`` string."""
    parts = F.split(c, ",")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("lon"))


@F.pandas_udf(T.StringType())
def wkb_hex(lon: pd.Series, lat: pd.Series) -> pd.Series:
    """Little-endian WKB of a point, in upper-case hex; Spark has no IEEE byte view, so this is an Arrow function."""
    return pd.Series([None if x != x or y != y else struct.pack("<BIdd", 1, 1, x, y).hex().upper() for x, y in zip(lon, lat, strict=True)])


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting over array<struct<lon, lat>>, closed or not; native, so it stays in one stage."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"])

    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return F.size(hits) % 2 == 1
