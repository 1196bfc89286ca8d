"""Coordinates: validity, map grid and the Chinese map offset."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Krasovsky 1940 ellipsoid, and the offset polynomial and waves around
# their origin. Polynomials: constant, x, y, squared term, x*y, root of |x|. Waves:
# (amplitude, frequency in half turns per degree).
SEMI_MAJOR_AXIS = 6378245.0
ECCENTRICITY_SQUARED = 0.00669342162296594323
ORIGIN_LAT, ORIGIN_LON = 35.0, 105.0
NORTH_POLYNOMIAL = (-100.0, 2.0, 3.0, 0.2, 0.1, 0.2)
EAST_POLYNOMIAL = (300.0, 1.0, 2.0, 0.1, 0.1, 0.1)
COMMON_WAVES = ((20.0, 6.0), (20.0, 2.0))
NORTH_WAVES = ((20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30))
EAST_WAVES = ((20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30))
WAVE_SCALE = 2 / 3

# Map grid, degrees at zoom 0 and the finest cell.
GRID_DEGREES = 90
FINEST_CELL = 1e-4


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """Finite and on the globe. NaN sorts above every number, so ``between`` rejects it."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def grid_precision(zoom: int) -> float:
    """Cell width in degrees at a zoom level."""
    return max(GRID_DEGREES / 2**zoom, FINEST_CELL)


def _waves(x: Column, waves) -> Column:
    total = F.lit(0.0)
    for amplitude, frequency in waves:
        total = total + amplitude * F.sin(x * (frequency * math.pi))
    return total * WAVE_SCALE


def _polynomial(x: Column, y: Column, squared: Column, coefficients) -> Column:
    terms = (F.lit(1.0), x, y, squared * squared, x * y, F.sqrt(F.abs(x)))
    total = F.lit(0.0)
    for coefficient, term in zip(coefficients, terms):
        total = total + coefficient * term
    return total


def wgs84_to_gcj02(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Shift WGS-84 coordinates to the GCJ-02 map datum (applied everywhere).

    The offset is given in metres north and east; dividing by the radii of curvature of
    the ellipsoid at the latitude turns it into angles. At the poles, where east has no
    meaning, the longitude is null.
    """
    x, y = lon - ORIGIN_LON, lat - ORIGIN_LAT
    common = _waves(x, COMMON_WAVES)
    north = _polynomial(x, y, y, NORTH_POLYNOMIAL) + common + _waves(y, NORTH_WAVES)
    east = _polynomial(x, y, x, EAST_POLYNOMIAL) + common + _waves(x, EAST_WAVES)
    phi = F.radians(lat)
    w = 1 - ECCENTRICITY_SQUARED * F.sin(phi) * F.sin(phi)
    meridian = SEMI_MAJOR_AXIS * (1 - ECCENTRICITY_SQUARED) / (w * F.sqrt(w))
    parallel = SEMI_MAJOR_AXIS / F.sqrt(w) * F.cos(phi)
    return lat + F.degrees(north / meridian), F.when(F.abs(lat) < 90, lon + F.degrees(east / parallel))
