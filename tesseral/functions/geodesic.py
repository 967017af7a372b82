"""Geodesics on the WGS 84 ellipsoid as columns, by Vincenty's series, and the azimuthal equidistant projection about an anchor.

The series are iterated a fixed number of times, which within some thousand kilometres is far more than double precision needs; the inverse is not for
points that lie almost opposite to each other on the globe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and flattening (fixed values), and the semi-minor axis.
A_M, FLAT = 6378137.0, 1 / 298.257223563
B_M = A_M * (1 - FLAT)
ROUNDS = 6


def _with(df: DataFrame, **steps: Column) -> DataFrame:
    for name, value in steps.items():
        df = df.withColumn("_g_" + name, value)
    return df


def _g(name: str) -> Column:
    return F.col("_g_" + name)


def _clean(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_g_")])


def _big(u: Column) -> Column:
    return 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))


def _small(u: Column) -> Column:
    return u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))


def _shift(b: Column, sigma: Column, middle: Column) -> Column:
    """How far the arc on the sphere is from that on the ellipsoid."""
    s, c = F.sin(sigma), F.cos(sigma)
    return b * s * (middle + b / 4 * (c * (2 * middle * middle - 1) - b / 6 * middle * (4 * s * s - 3) * (4 * middle * middle - 3)))


def _longer(sine: Column, square: Column, sigma: Column, middle: Column) -> Column:
    """By how much longitude on the sphere exceeds that on the ellipsoid."""
    c = FLAT / 16 * square * (4 + FLAT * (4 - 3 * square))
    return (1 - c) * FLAT * sine * (sigma + c * F.sin(sigma) * (middle + c * F.cos(sigma) * (2 * middle * middle - 1)))


def direct(df: DataFrame, lat: Column, lon: Column, azimuth_deg: Column, distance_m: Column, out: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """df with latitude and longitude of the end of a geodesic. Longitudes lie between -180 and 180."""
    df = _with(df, p=lat, l=lon, z=F.radians(azimuth_deg), d=distance_m)
    df = _with(df, u=F.atan((1 - FLAT) * F.tan(F.radians(_g("p")))))
    df = _with(df, s1=F.atan2(F.tan(_g("u")), F.cos(_g("z"))), sine=F.cos(_g("u")) * F.sin(_g("z")))
    df = _with(df, square=1 - _g("sine") * _g("sine"))
    df = _with(df, u2=_g("square") * ((A_M * A_M - B_M * B_M) / (B_M * B_M)))
    df = _with(df, first=_g("d") / (B_M * _big(_g("u2"))), b=_small(_g("u2")))
    df = _with(df, sigma=_g("first"))
    for _ in range(ROUNDS):
        df = _with(df, middle=F.cos(2 * _g("s1") + _g("sigma")))
        df = _with(df, sigma=_g("first") + _shift(_g("b"), _g("sigma"), _g("middle")))
    df = _with(df, middle=F.cos(2 * _g("s1") + _g("sigma")), ss=F.sin(_g("sigma")), cs=F.cos(_g("sigma")), su=F.sin(_g("u")), cu=F.cos(_g("u")), cz=F.cos(_g("z")))
    across = _g("su") * _g("ss") - _g("cu") * _g("cs") * _g("cz")
    north = F.atan2(_g("su") * _g("cs") + _g("cu") * _g("ss") * _g("cz"), (1 - FLAT) * F.sqrt(_g("sine") * _g("sine") + across * across))
    east = F.atan2(_g("ss") * F.sin(_g("z")), _g("cu") * _g("cs") - _g("su") * _g("ss") * _g("cz"))
    turned = F.degrees(east - _longer(_g("sine"), _g("square"), _g("sigma"), _g("middle")))
    still = _g("d") == 0
    df = df.withColumns({out[0]: F.when(still, _g("p")).otherwise(F.degrees(north)), out[1]: F.when(still, _g("l")).otherwise(F.pmod(_g("l") + turned + 540.0, F.lit(360.0)) - 180.0)})
    return _clean(df)


def inverse(df: DataFrame, lat1: Column, lon1: Column, lat2: Column, lon2: Column, out: tuple[str, str] = ("distance_m", "azimuth_deg")) -> DataFrame:
    """df with the length of the geodesic between two points and the azimuth, from 0 to 360, in which it begins; 0 and 0 for equal points."""
    df = _with(df, u1=F.atan((1 - FLAT) * F.tan(F.radians(lat1))), u2=F.atan((1 - FLAT) * F.tan(F.radians(lat2))), l=F.radians(F.pmod(lon2 - lon1 + 540.0, F.lit(360.0)) - 180.0))
    df = _with(df, s1=F.sin(_g("u1")), c1=F.cos(_g("u1")), s2=F.sin(_g("u2")), c2=F.cos(_g("u2")), far=_g("l"))
    for _ in range(ROUNDS + 1):
        df = _with(df, x=_g("c2") * F.sin(_g("far")), y=_g("c1") * _g("s2") - _g("s1") * _g("c2") * F.cos(_g("far")))
        df = _with(df, ss=F.sqrt(_g("x") * _g("x") + _g("y") * _g("y")), cs=_g("s1") * _g("s2") + _g("c1") * _g("c2") * F.cos(_g("far")))
        df = _with(df, sigma=F.atan2(_g("ss"), _g("cs")), sine=F.when(_g("ss") == 0, 0.0).otherwise(_g("c1") * _g("c2") * F.sin(_g("far")) / _g("ss")))
        df = _with(df, square=1 - _g("sine") * _g("sine"))
        df = _with(df, middle=F.when(_g("square") == 0, 0.0).otherwise(_g("cs") - 2 * _g("s1") * _g("s2") / _g("square")))
        df = _with(df, far=_g("l") + _longer(_g("sine"), _g("square"), _g("sigma"), _g("middle")))
    df = _with(df, w=_g("square") * ((A_M * A_M - B_M * B_M) / (B_M * B_M)))
    df = df.withColumns({out[0]: B_M * _big(_g("w")) * (_g("sigma") - _shift(_small(_g("w")), _g("sigma"), _g("middle"))), out[1]: F.pmod(F.degrees(F.atan2(_g("x"), _g("y"))) + 360.0, F.lit(360.0))})
    return _clean(df)


def enu_to_wgs84(df: DataFrame, e: Column, n: Column, lat0: float, lon0: float, out: tuple[str, str] = ("lat", "lon")) -> DataFrame:
    """df with latitude and longitude of metres east and north of an anchor in the azimuthal equidistant projection about it."""
    return direct(df, F.lit(lat0), F.lit(lon0), F.degrees(F.atan2(e, n)), F.sqrt(e * e + n * n), out)


def wgs84_to_enu(df: DataFrame, lat: Column, lon: Column, lat0: float, lon0: float, out: tuple[str, str] = ("e", "n")) -> DataFrame:
    """The inverse of enu_to_wgs84."""
    df = inverse(df, F.lit(lat0), F.lit(lon0), lat, lon, ("_s", "_z"))
    return df.withColumns({out[0]: F.col("_s") * F.sin(F.radians("_z")), out[1]: F.col("_s") * F.cos(F.radians("_z"))}).drop("_s", "_z")
