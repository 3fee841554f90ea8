"""Closed-form weather expressions from published formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heat_index(t: Column, rh: Column) -> Column:
    """Heat index in degF from temperature (degF) and relative humidity (%): the weather service's regression with its adjustments."""
    simple = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + rh * 0.094)
    full = (
        -42.379 + 2.04901523 * t + 10.14333127 * rh - 0.22475541 * t * rh - 0.00683783 * t * t - 0.05481717 * rh * rh
        + 0.00122874 * t * t * rh + 0.00085282 * t * rh * rh - 0.00000199 * t * t * rh * rh
    )
    dry = ((13.0 - rh) / 4.0) * F.sqrt(F.greatest(F.lit(0.0), (17.0 - F.abs(t - 95.0)) / 17.0))
    wet = ((rh - 85.0) / 10.0) * ((87.0 - t) / 5.0)
    adjusted = full - F.when((rh < 13) & (t >= 80) & (t <= 112), dry).otherwise(0.0) + F.when((rh > 85) & (t >= 80) & (t <= 87), wet).otherwise(0.0)
    return F.when((simple + t) / 2 >= 80, adjusted).otherwise(simple)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees that the wind comes from, 0 to below 360."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def saturation(t: Column) -> Column:
    """Saturation vapour pressure (kPa) at t degC."""
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def dew_point(t: Column, rh: Column) -> Column:
    """degC, by the Magnus form; humidity in %."""
    g = F.log(rh / 100.0) + 17.27 * t / (t + 237.3)
    return 237.3 * g / (17.27 - g)


def relative_humidity(t: Column, td: Column) -> Column:
    return 100.0 * saturation(td) / saturation(t)


def sea_level_pressure(psfc: Column, t2: Column, q2: Column, elevation: Column) -> Column:
    """hPa from surface pressure (Pa), temperature (K), humidity (kg/kg) and elevation (m): hypsometric equation with half the standard lapse added."""
    virtual = t2 * (1.0 + 0.61 * q2) + 0.0065 * elevation / 2.0
    return psfc / 100.0 * F.exp(9.80665 * elevation / (287.05 * virtual))


def pet_fao56(tmin: Column, tmax: Column, rh: Column, net_radiation: Column, wind10: Column, elevation: Column | None = None) -> Column:
    """mm a day, Penman-Monteith: temperatures degC, humidity %, radiation MJ m-2 day-1, wind m/s at 10 m."""
    elevation = F.lit(0.0) if elevation is None else elevation
    t = (tmin + tmax) / 2.0
    es = (saturation(tmin) + saturation(tmax)) / 2.0
    ea = es * rh / 100.0
    delta = 4098.0 * saturation(t) / F.pow(t + 237.3, F.lit(2.0))
    pressure = 101.3 * F.pow((293.0 - 0.0065 * elevation) / 293.0, F.lit(5.26))
    gamma = 0.000665 * pressure
    u2 = wind10 * 0.748  # logarithmic profile, 10 m to 2 m
    top = 0.408 * delta * net_radiation + gamma * 900.0 / (t + 273.0) * u2 * (es - ea)
    return F.greatest(F.lit(0.0), top / (delta + gamma * (1.0 + 0.34 * u2)))


def geostrophic(dz_dx: Column, dz_dy: Column, lat: Column) -> tuple[Column, Column]:
    """(u, v) from the slopes of geopotential height."""
    f = 2.0 * 7.2921e-5 * F.sin(F.radians(lat))
    return -9.80665 / f * dz_dy, 9.80665 / f * dz_dx


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for positive x, by Stirling's series after shifting x up by 8."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - 1 / (1680 * F.pow(y, F.lit(7.0)))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)
