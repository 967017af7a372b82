"""Spherical geodesy and local metric frames as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0
#: Squared eccentricity of the WGS 84 ellipsoid, for local frames.
_E2 = 6.69437999014e-3


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def normalize_heading_deg(value: Column) -> Column:
    return F.pmod(value, F.lit(360.0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), F.lit(2.0))
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def initial_bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return normalize_heading_deg(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def destination_point(lat: Column, lon: Column, bearing_deg: Column, distance_m: Column) -> tuple[Column, Column]:
    """Latitude and longitude after going some way along a great circle."""
    b, p, d = F.radians(bearing_deg), F.radians(lat), distance_m / F.lit(EARTH_RADIUS_M)
    sine = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)
    east = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * sine)
    still = distance_m == 0
    return F.when(still, lat).otherwise(F.degrees(F.asin(sine))), F.when(still, lon).otherwise(F.pmod(F.degrees(east) + 540.0, F.lit(360.0)) - 180.0)


def _radii(lat0: float) -> tuple[float, float]:
    """Metres a radian northward and eastward at a latitude of the ellipsoid."""
    w = 1 - _E2 * math.sin(math.radians(lat0)) ** 2
    return EARTH_RADIUS_M * (1 - _E2) / w**1.5, EARTH_RADIUS_M / w**0.5 * math.cos(math.radians(lat0))


def enu_to_wgs84(e: Column, n: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Latitude and longitude of local metres east and north of an anchor.

    A tangent frame with the ellipsoid's radii at the anchor and a first-order change of the
    eastward radius; within 1 km of the anchor it is off by some centimetres from an
    azimuthal equidistant projection.
    """
    north, east = _radii(lat0)
    lat = F.lit(lat0) + F.degrees(n / F.lit(north))
    shrink = F.lit(1.0) - F.tan(F.lit(math.radians(lat0))) * n / F.lit(north) / 2
    return lat, F.lit(lon0) + F.degrees(e / (F.lit(east) * (F.lit(2.0) * shrink - 1)))


def wgs84_to_enu(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of an anchor: the inverse of enu_to_wgs84."""
    north, east = _radii(lat0)
    n = F.radians(lat - F.lit(lat0)) * F.lit(north)
    shrink = F.lit(1.0) - F.tan(F.lit(math.radians(lat0))) * n / F.lit(north) / 2
    return F.radians(lon - F.lit(lon0)) * F.lit(east) * (F.lit(2.0) * shrink - 1), n


def rigid(e: Column, n: Column, u: Column, *, scale: float = 1.0, yaw_deg: float = 0.0, shift: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[Column, Column, Column]:
    """Points scaled, turned about the vertical and moved."""
    c, s = math.cos(math.radians(yaw_deg)), math.sin(math.radians(yaw_deg))
    return (e * (c * scale) - n * (s * scale) + shift[0], e * (s * scale) + n * (c * scale) + shift[1], u * scale + shift[2])


def north_alignment_deg(east: float, north: float) -> float:
    """The yaw that turns the direction from one picked point to another toward north."""
    return math.degrees(math.atan2(east, north))


def height_boundary_near_zero(low: float, high: float, zoom: int) -> float:
    """The altitude of the layer edge that lies nearest to altitude 0, to which a local zero is snapped."""
    step = (high - low) / (1 << zoom)
    return low + round(-low / step) * step


def resolve_height_origin(given: float | None, stored: float | None, low: float, high: float, zoom: int) -> float:
    """The altitude of a local zero: as given, else as stored with the data, else the layer edge nearest to altitude 0."""
    for value in (given, stored):
        if value is not None:
            return float(value)
    return height_boundary_near_zero(low, high, zoom)


def height_origin(given: Column, stored: Column, low: float, high: float, zoom: Column) -> Column:
    """resolve_height_origin as a column; nulls are altitudes that aren't given or stored."""
    step = F.lit(high - low) / F.pow(F.lit(2.0), zoom)
    return F.coalesce(given.cast("double"), stored.cast("double"), F.lit(low) + F.rint(F.lit(-low) / step) * step)
