"""Scalar functions as column expressions: units, leads, humidity, pressure, sun, calendar, arrays. None of them is a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors and offsets to canonical units.
UNITS = {"degC": (1.0, 0.0), "degF": (5 / 9, -160 / 9), "mph": (0.44704, 0.0), "ms": (1.0, 0.0), "kmh": (1 / 3.6, 0.0), "inHg": (33.8639, 0.0), "hPa": (1.0, 0.0), "Pa": (0.01, 0.0), "inch": (25.4, 0.0), "mm": (1.0, 0.0), "percent": (1.0, 0.0)}
#: Left-closed lead buckets in hours, by product.
LEAD_EDGES = {
    "hourly": ((0, 1, "0-1h"), (1, 3, "1-3h"), (3, 6, "3-6h"), (6, 12, "6-12h"), (12, 24, "12-24h"), (24, 48, "24-48h"), (48, 96, "48-96h"), (96, 168, "96-168h"), (168, 240, "168-240h"), (240, math.inf, "240h+")),
    "daily": ((0, 48, "D1"), (48, 72, "D2"), (72, 120, "D3-4"), (120, 192, "D5-7"), (192, 264, "D8-10")),
    "minutely": ((0, 5 / 60, "0-5min"), (5 / 60, 15 / 60, "5-15min"), (15 / 60, 30 / 60, "15-30min"), (30 / 60, 45 / 60, "30-45min"), (45 / 60, 61 / 60, "45-60min")),
}


def converted(value: Column, unit: str) -> Column:
    """``value`` in the canonical unit; an unknown unit is an error."""
    factor, offset = UNITS[unit]
    return value * factor + offset


def lead_bucket(hours: Column, product: str = "hourly") -> Column:
    """The bucket's name; null below 0 and past the last bucket."""
    out = None
    for low, high, name in LEAD_EDGES[product]:
        inside = (hours >= low) if high == math.inf else (hours >= low) & (hours < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def fresh(age: Column, cap: float) -> Column:
    """Whether an age is a number from 0 on and under the cap."""
    return F.coalesce(finite(age) & (age >= 0) & (age < cap), F.lit(False))


#: A published fit of the error function, good to 1.2e-7.
ERF_TERMS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erf(x: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(ERF_TERMS[-1])
    for c in reversed(ERF_TERMS[:-1]):
        poly = c + t * poly
    return F.signum(x) * (1 - t * F.exp(-x * x + poly))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def gaussian_crps(mu: Column, sigma: Column, y: Column) -> Column:
    z = (y - mu) / sigma
    return sigma * (z * erf(z / math.sqrt(2)) + math.sqrt(2 / math.pi) * F.exp(-z * z / 2) - 1 / math.sqrt(math.pi))


def coherent(low: Column, high: Column) -> tuple[Column, Column]:
    """Two quantile curves on the same levels, of which the first may nowhere exceed the second, and both rise."""
    def rising(a: Column) -> Column:
        return F.transform(a, lambda _, i: F.array_max(F.slice(a, F.lit(1), i + 1)))

    return rising(F.zip_with(low, high, lambda a, b: F.least(a, b))), rising(F.zip_with(low, high, lambda a, b: F.greatest(a, b)))


def clipped(value: Column, low: float | None, high: float | None) -> Column:
    """Within bounds; null stays null, which greatest and least alone would not keep."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def bounds_flag(value: Column, low: float, high: float, bit: int = 1) -> Column:
    return F.when((value < low) | (value > high), bit).otherwise(0)


def dew_point_c(temp_c: Column, humidity: Column) -> Column:
    """Magnus formula; null unless 0 < humidity <= 100."""
    gamma = F.ln(humidity / 100) + 17.625 * temp_c / (243.04 + temp_c)
    return F.when((humidity > 0) & (humidity <= 100), 243.04 * gamma / (17.625 - gamma))


def sea_level_hpa(station_hpa: Column, temp_c: Column, elevation_m: float) -> Column:
    drop = 0.0065 * elevation_m
    return station_hpa * F.pow(1 - drop / (temp_c + drop + 273.15), F.lit(-5.257))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def solar_elevation_deg(ts: Column, latitude: float, longitude: float) -> Column:
    """Elevation of the sun at a UTC timestamp, by the NOAA Fourier series."""
    day = F.dayofyear(ts) - 1
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    g = 2 * math.pi / 365 * (day + (hour - 12) / 24)
    eqtime = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decl = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    minutes = F.pmod(hour * 60 + eqtime + 4 * longitude, F.lit(1440.0))
    angle = F.radians(minutes / 4 - 180)
    lat = math.radians(latitude)
    sine = math.sin(lat) * F.sin(decl) + math.cos(lat) * F.cos(decl) * F.cos(angle)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine))))


def toa_irradiance(ts: Column, elevation_deg: Column) -> Column:
    return 1361.0 * (1 + 0.033 * F.cos(2 * math.pi * F.dayofyear(ts) / 365)) * F.greatest(F.sin(F.radians(elevation_deg)), F.lit(0.0))


def solar_load(toa: Column, wind_ms: Column) -> Column:
    return toa / 1000 / (1 + F.greatest(wind_ms, F.lit(0.0)))


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_day_minutes(date: Column, zone: str) -> Column:
    """Minutes of a local calendar day: 1380, 1440 or 1500."""
    start, end = (F.to_utc_timestamp(d.cast("timestamp"), zone) for d in (date, F.date_add(date, 1)))
    return ((F.unix_seconds(end) - F.unix_seconds(start)) / 60).cast("int")


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    return F.sin(2 * math.pi * value / period), F.cos(2 * math.pi * value / period)


def median_of(values: Column) -> Column:
    """The median of an array of numbers without nulls."""
    s, n = F.array_sort(values), F.size(values)
    upper, lower = F.element_at(s, (F.floor(n / 2) + 1).cast("int")), F.element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    return F.when(n > 0, (upper + lower) / 2)


def masked_mean(values: Column) -> Column:
    """The mean of an array's members that aren't null; null without any."""
    some = F.filter(values, lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, v: a + v), F.size(some))


def renormalised(values: Column, weights: Column) -> Column:
    """Weighted mean over the members that aren't null."""
    pairs = F.filter(F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w"))), lambda p: p["v"].isNotNull())
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])
    return F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"] * p["v"]), total)


def trimmed_mean(values: Column, share: float = 0.2) -> Column:
    """The mean without the floor(share * k) least and greatest of k available members."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    cut = F.floor(F.size(s) * F.lit(share)).cast("int")
    kept = F.slice(s, cut + 1, F.size(s) - 2 * cut)
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), F.size(kept))


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Linear interpolation over sorted knots, held at the ends."""
    n = F.size(xs)
    right = F.size(F.filter(xs, lambda k: k < x)) + 1  # the first knot not below x
    lo, hi = F.greatest(right - 1, F.lit(1)), F.least(right, n)
    x0, x1, y0, y1 = F.element_at(xs, lo), F.element_at(xs, hi), F.element_at(ys, lo), F.element_at(ys, hi)
    share = F.coalesce(F.try_divide(x - x0, x1 - x0), F.lit(0.0))
    return F.when(x.isNotNull() & (n > 0), y0 + (y1 - y0) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def anchor_weight(lead: Column, tau: float, floor: float = 0.05) -> Column:
    w = F.exp(-lead / tau)
    return F.when(w >= floor, w).otherwise(0.0)


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))


def encoded_segment(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("__"), F.lit("%5F%5F"))


def decoded_segment(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("%5F%5F"), F.lit("__")), F.lit("%25"), F.lit("%"))


def short_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)


def source_slug(provider: Column, model: Column) -> Column:
    """The provider's name, with its model's where that says more."""
    plain = F.coalesce(model, F.lit("")).isin("", "best_match") | (model == provider)
    return F.when(plain, provider).otherwise(F.concat_ws("_", provider, model))
