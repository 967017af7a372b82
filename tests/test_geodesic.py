import math
import random

from pyspark.sql import functions as F

from tesseral.functions import geo, geodesic


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_published_values(spark):
    """The published line from Flinders Peak to Buninyong, 54972.271 m at 306 52 05.37."""
    a, b = (dms(-37, 57, 3.72030), dms(144, 25, 29.52440)), (dms(-37, 39, 10.15610), dms(143, 55, 35.38390))
    df = spark.createDataFrame([(*a, *b, dms(306, 52, 5.37), 54972.271)], "p double, l double, q double, m double, z double, d double")
    row = geodesic.inverse(df, *map(F.col, "plqm")).first()
    assert abs(row["distance_m"] - 54972.271) < 1e-3 and abs(row["azimuth_deg"] - dms(306, 52, 5.37)) < 3e-6
    end = geodesic.direct(df, *map(F.col, "plzd")).first()
    assert abs(end["lat"] - b[0]) < 1e-8 and abs(end["lon"] - b[1]) < 1e-8


def walked(lat, lon, azimuth, distance, steps=2000):
    """The end of a geodesic by walking it in short steps (Runge-Kutta on its differential equations)."""
    e2 = geodesic.FLAT * (2 - geodesic.FLAT)

    def slope(p, _, z):
        w = 1 - e2 * math.sin(p) ** 2
        m, n = geodesic.A_M * (1 - e2) / w**1.5, geodesic.A_M / w**0.5
        return math.cos(z) / m, math.sin(z) / (n * math.cos(p)), math.tan(p) * math.sin(z) / n

    at, h = (math.radians(lat), math.radians(lon), math.radians(azimuth)), distance / steps
    for _ in range(steps):
        k = [slope(*at)]
        for f in (0.5, 0.5, 1):
            k.append(slope(*[x + f * h * d for x, d in zip(at, k[-1], strict=True)]))
        at = tuple(x + h / 6 * (a + 2 * b + 2 * c + d) for x, a, b, c, d in zip(at, *k, strict=True))
    return math.degrees(at[0]), math.degrees(at[1])


def test_against_walked_lines(spark):
    rnd = random.Random(12)
    rows = [(rnd.uniform(-70, 70), rnd.uniform(-170, 170), rnd.uniform(0, 360), rnd.choice([0.5, 30.0, 2_000.0, 100_000.0])) for _ in range(40)]
    df = spark.createDataFrame(rows, "p double, l double, z double, d double")
    ends = geodesic.direct(df, F.col("p"), F.col("l"), F.col("z"), F.col("d"))
    back = geodesic.inverse(ends, F.col("p"), F.col("l"), F.col("lat"), F.col("lon")).collect()
    assert len(back) == len(rows)
    for r in back:
        lat, lon = walked(r["p"], r["l"], r["z"], r["d"])
        assert abs(r["lat"] - lat) < 5e-10 and abs(r["lon"] - lon) * math.cos(math.radians(lat)) < 5e-10  # 0.06 mm
        assert abs(r["distance_m"] - r["d"]) < 1e-5 and abs((r["azimuth_deg"] - r["z"] + 180) % 360 - 180) * r["d"] < 1e-3


def test_projection_and_the_tangent_frame(spark):
    rows = [(0.0, 0.0), (12.5, -300.0), (-80_000.0, 45_000.0), (1000.0, 0.0), (0.0, -1000.0)]
    df = spark.createDataFrame(rows, "e double, n double")
    there = geodesic.enu_to_wgs84(df, F.col("e"), F.col("n"), 37.5, 139.95)
    back = geodesic.wgs84_to_enu(there, F.col("lat"), F.col("lon"), 37.5, 139.95, ("e2", "n2")).collect()
    assert all(abs(r["e"] - r["e2"]) < 1e-6 and abs(r["n"] - r["n2"]) < 1e-6 for r in back) and len(back) == 5
    # How far the frame with the radii at the anchor is off a kilometre away: below 10 cm.
    lat, lon = geo.enu_to_wgs84(F.col("e"), F.col("n"), 37.5, 139.95)
    flat = geodesic.wgs84_to_enu(df.where("abs(e) + abs(n) <= 1000").withColumns({"lat": lat, "lon": lon}), F.col("lat"), F.col("lon"), 37.5, 139.95, ("e2", "n2")).collect()
    assert all(math.hypot(r["e"] - r["e2"], r["n"] - r["n2"]) < 0.1 for r in flat)
