"""Geographic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def equirect_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Flat distance in km, with longitude shortened at the first latitude."""
    return F.sqrt(F.pow((lat2 - lat1) * 111.0, 2) + F.pow((lon2 - lon1) * 111.0 * F.cos(F.radians(lat1)), 2))


def manhattan_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.abs(lat2 - lat1) + F.abs(lon2 - lon1)


def euclid_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def tile_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile numbers at a zoom of 0 to 18."""
    n = 2 ** max(0, min(18, zoom))
    rad = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n)
    return x.cast("long"), y.cast("long")


def density_cell(value: Column, low: float, high: float, n: int) -> Column:
    """Cell of n between low and high; values at or past the ends are in the end cells."""
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((value - low) / ((high - low) / n)))).cast("long")


def parse_point(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of 'Point(lon lat)'; null where it is no point on earth."""
    number = r"(-?[0-9]+(?:\.[0-9]+)?)"
    pattern = rf"^Point\({number} {number}\)$"
    lon = F.regexp_extract(text, pattern, 1).try_cast("double")
    lat = F.regexp_extract(text, pattern, 2).try_cast("double")
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, lat), F.when(good, lon)
