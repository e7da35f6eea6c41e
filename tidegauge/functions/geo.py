"""Geographic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0

# Fixed values of the weather service's published 5 km Lambert grid.
GRID_RADIUS_KM = 6371.00877
GRID_SPACING_KM = 5.0
GRID_PARALLELS = (30.0, 60.0)
GRID_ORIGIN = (38.0, 126.0)
GRID_OFFSET = (43, 136)


def great_circle_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance in kilometres."""
    half_lat = F.radians(lat_b - lat_a) / 2
    half_lon = F.radians(lon_b - lon_a) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere; straight-line order equals great-circle order there."""
    phi, lam = F.radians(lat), F.radians(lon)
    return [F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)]


def grid_constants() -> tuple[float, float, float]:
    """Cone constant, scale and distance of the origin for the conformal conic projection."""
    first, second = (math.radians(p) for p in GRID_PARALLELS)

    def stretch(angle: float) -> float:
        return math.tan(math.pi / 4 + angle / 2)

    cone = math.log(math.cos(first) / math.cos(second)) / math.log(stretch(second) / stretch(first))
    scale = GRID_RADIUS_KM / GRID_SPACING_KM * math.cos(first) / cone * stretch(first) ** cone
    return cone, scale, scale / stretch(math.radians(GRID_ORIGIN[0])) ** cone


def grid_cell(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(column, row) of the 5 km grid, truncated toward zero."""
    cone, scale, origin = grid_constants()
    radius = F.lit(scale) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(cone))
    turn = F.radians(lon - F.lit(GRID_ORIGIN[1]))
    theta = (F.pmod(turn + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi)) * F.lit(cone)
    x = radius * F.sin(theta) + F.lit(GRID_OFFSET[0] + 0.5)
    y = F.lit(origin) - radius * F.cos(theta) + F.lit(GRID_OFFSET[1] + 0.5)
    return x.cast("int"), y.cast("int")
