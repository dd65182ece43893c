"""Distances and grid cells on the sphere.

The cells hold for places up to 89 degrees of latitude (for radii of some
kilometres) that don't lie on both sides of the 180th meridian; distances hold everywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(chord))


def lat_step(radius_m: float) -> float:
    """Degrees of latitude that span the radius, a little enlarged."""
    return math.degrees(radius_m / EARTH_M) * 1.001


def lat_row(lat: Column, radius_m: float) -> Column:
    return F.floor(lat / F.lit(lat_step(radius_m)))


def lon_step(row: Column, radius_m: float) -> Column:
    """Longitude width of a grid row: the radius at the row's widest reach.

    The row's neighbours are included, so three columns to each side always
    cover the radius for points of the row itself.
    """
    edge = F.radians((F.abs(row) + 2) * F.lit(lat_step(radius_m)))
    return F.lit(lat_step(radius_m)) / F.greatest(F.cos(edge), F.lit(0.01))


def lon_col(lon: Column, row: Column, radius_m: float) -> Column:
    return F.floor(lon / lon_step(row, radius_m))
