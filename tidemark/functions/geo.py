"""Geometry, scores of counts, and display sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_NAUTICAL_MILE = 1.852
# Abramowitz and Stegun 7.1.26.
_ERF_P = 0.3275911
_ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null where a place is; ``least`` would skip it


def rounded(x: Column, digits: int) -> Column:
    """``x``, 0 to 2**52 when scaled, to so many digits, halves up: as SQL rounds a double, and ``x`` is made once. ``round`` goes by a double's decimal digits instead."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def covering_radius_nm(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """From the centre of a box to its farthest corner, in nautical miles."""
    lat, lon = (min_lat + max_lat) / 2, (min_lon + max_lon) / 2
    corners = [haversine_km(lat, lon, a, b) for a in (min_lat, max_lat) for b in (min_lon, max_lon)]
    return F.greatest(*corners) / KM_PER_NAUTICAL_MILE


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """``box``: min_lon, min_lat, max_lon, max_lat; all sides count as inside."""
    min_lon, min_lat, max_lon, max_lat = box
    return lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon)


def check_box(box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The box, or ValueError for one that is out of range or out of order."""
    if len(box) != 4:
        raise ValueError("a box has four numbers: min_lon, min_lat, max_lon, max_lat")
    min_lon, min_lat, max_lon, max_lat = map(float, box)
    if not (-180 <= min_lon < max_lon <= 180):
        raise ValueError("longitudes must rise within -180 and 180")
    if not (-90 <= min_lat < max_lat <= 90):
        raise ValueError("latitudes must rise within -90 and 90")
    return min_lon, min_lat, max_lon, max_lat


def box_fault(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """What ``check_box`` would say of a row's box, or null for a good one; missing numbers are out of range."""
    good = lambda low, high, bound: F.coalesce((low >= -bound) & (low < high) & (high <= bound), F.lit(False))
    return F.when(~good(min_lon, max_lon, 180), "longitudes must rise within -180 and 180").when(~good(min_lat, max_lat, 90), "latitudes must rise within -90 and 90")


def point_box(lat: Column, lon: Column, margin: float = 0.01) -> Column:
    return F.array(lon - margin, lat - margin, lon + margin, lat + margin)


def erf(x: Column) -> Column:
    t = 1 / (1 + _ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(_ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def circle_radius(n: Column, height: Column) -> Column:
    return erf(height / 3e6) * F.log(n + 1.5) * 110_000


def cylinder(n: Column, camera: Column) -> tuple[Column, Column]:
    """Radius and height of a count's cylinder, below the camera."""
    radius = F.log(n + 1.5) * 20_000
    tall = 100_000.0 * n
    return radius, F.when(tall > camera - 10_000, camera - 10_000).otherwise(tall)


def recency(age_seconds: Column, days: int = 7) -> Column:
    """1 for now, 0 for ``days`` ago and before."""
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), age_seconds / (days * 86_400.0)))


def height_of_zoom(zoom: Column) -> Column:
    return 1.6e8 / F.pow(F.lit(2.0), zoom)


def zoom_of_height(height: Column) -> Column:
    return F.log2(F.lit(1.6e8) / height)


def decay(age_hours: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -age_hours / half_life)


def log_count(c: Column) -> Column:
    return 1 + F.log1p(c)


def log_population(population: Column) -> Column:
    return F.when(population > 0, F.log10(population + 1)).otherwise(0.0)


def lenient_float(text: Column) -> Column:
    """A number in a string; booleans and junk are null."""
    return text.try_cast("double")


def lenient_int(text: Column) -> Column:
    """As ``lenient_float``, truncated."""
    return lenient_float(text).try_cast("bigint")
