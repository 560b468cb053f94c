"""Solar geometry as column expressions (the low-precision formulas of the Astronomical Almanac)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SOLAR_CONSTANT = 1361.0


def sine_of_elevation(utc_us: Column, lat: Column, lon: Column) -> Column:
    """Sine of the sun's elevation for instants in microseconds since 1970; null in, null out."""
    days = utc_us / F.lit(86400e6) + F.lit(2440587.5 - 2451545.0)
    mean = F.radians(F.pmod(F.lit(280.460) + 0.9856474 * days, F.lit(360.0)))
    anomaly = F.radians(F.pmod(F.lit(357.528) + 0.9856003 * days, F.lit(360.0)))
    ecliptic = mean + F.radians(1.915 * F.sin(anomaly) + 0.020 * F.sin(2 * anomaly))
    tilt = F.radians(F.lit(23.439) - 4e-7 * days)
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    sidereal = F.pmod(F.lit(18.697374558) + 24.06570982441908 * days, F.lit(24.0))
    hour_angle = F.radians(sidereal * 15 + lon) - ascension
    return F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour_angle)


def _above(sine: Column, shift: float = 0.0) -> Column:
    # greatest skips nulls, so an unknown elevation is asked for first.
    return F.when(sine.isNotNull(), F.greatest(sine + shift, F.lit(0.0)))


def clear_sky(sine: Column) -> Column:
    """W/m2 on level ground under a clear sky, twilight included, near enough to take the daily course out of readings."""
    return 0.75 * SOLAR_CONSTANT * F.pow(_above(sine, 0.03), 1.15)


def most_possible(sine: Column) -> Column:
    """W/m2 on level ground that no sky exceeds: the limit used in radiation networks, with 30 W/m2 for twilight."""
    return 1.5 * SOLAR_CONSTANT * F.pow(_above(sine), 1.2) + F.when(sine > -0.02, 30.0).otherwise(15.0)
