import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesseral.functions import codec, geo
from tesseral.functions.cells import CELL, common_prefix, matches
from tesseral.operators.joins import prefixed

BITS = "111101001010010010010011111000110101100100111000001101000001011011110"


@pytest.fixture(scope="module")
def example(spark):
    df = spark.createDataFrame([(139.75, 35.68, 10.0, "2025-05-21T15:00:00Z")], "x double, y double, f double, iso string")
    return df.withColumn("t", codec.from_iso(F.col("iso")))


def test_worked_example(example):
    cells = codec.encode(example, x="x", y="y", f="f", t="t", zooms={"x": 10, "y": 10, "f": 5, "t": 20})
    row = cells.select(codec.id_bits().alias("b"), codec.bit_length().alias("n"), codec.id_separate().alias("s")).first()
    assert row["b"] == BITS and row["n"] == 69
    assert row["s"] == "1/1/1/1/01001/01001/00100/10011/1110001101/0110010011/10000/01101000001011011110"
    back = codec.decode(codec.parse_bits(cells.select(codec.id_bits().alias("b")), "b")).first()
    assert (back["x"], back["f"], back["t"]) == (139.5703125, 529.0, 1747836928)
    assert back["y"] == pytest.approx(35.746512259918504, abs=1e-12)


def tiles(lng, lat, h, t, zx, zy, zf, zt):
    n = 1 << zx
    x = min(int(((lng + 180.0) % 360.0 - 180.0 + 180.0) / 360.0 * n), n - 1)
    r = math.radians(max(-codec.MAX_LATITUDE, min(codec.MAX_LATITUDE, lat)))
    m = 1 << zy
    y = min(max(int((1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * m), 0), m - 1)
    return x, y, int((h + 16383.0) / 32767.0 * 4294967295) >> (32 - zf), t >> (32 - zt)


def test_random_points_round_trip(spark):
    rnd = random.Random(20260903)
    rows = []
    for i in range(1500):
        z = [rnd.randint(1, 20) for _ in range(4)]
        rows.append((i, rnd.uniform(-179.9, 179.9), rnd.uniform(-84, 84), rnd.uniform(-16000, 16000), rnd.randint(0, 1 << 31), *z))
    rows = [(*r[:1], *(None if rnd.random() < 0.2 else v for v in r[1:5]), *r[5:]) for r in rows]
    df = spark.createDataFrame(rows, "i int, x double, y double, f double, t long, a int, b int, c int, d int")
    cells = codec.encode(df, x="x", y="y", f="f", t="t", zooms={"x": "a", "y": "b", "f": "c", "t": "d"})
    out = cells.withColumn("bits", codec.id_bits()).withColumn("bytes", codec.id_bytes(F.col("bits")))
    back = codec.parse_bits(prefixed(out, "o_").withColumn("b", codec.bytes_to_bits(F.col("o_bytes"))), "b").where("o_flags > 0").collect()
    by = {r[0]: r for r in rows}
    assert len(back) > 1400
    for r in back:
        assert [r[c] for c in CELL] == [r["o_" + c] for c in CELL]
        assert r["b"] == r["o_bits"] and len(r["o_bytes"]) == -(-len(r["o_bits"]) // 8)
        src = by[r["o_i"]]
        want = tiles(*(0 if v is None else v for v in src[1:5]), *src[5:])
        for a, v, w in zip("xyft", src[1:5], want, strict=True):
            assert r[f"v{a}"] == (w if v is not None else 0)


def test_longitudes_wrap_and_latitudes_clamp(spark):
    lng = [-180.0, 180.0, 190.0, -190.0, 540.0, -540.0, 360.0, 539.9, -180 - 2.8e-14]
    df = spark.createDataFrame([(v,) for v in lng], "v double").select("v", codec.x_tile(F.col("v"), 8).alias("t"))
    got = {r["v"]: r["t"] for r in df.collect()}
    assert got[-180.0] == got[180.0] == got[540.0] == got[-540.0] == 0
    assert got[539.9] == 255 and got[360.0] == 128
    assert all(got[v] == tiles(v, 0, 0, 0, 8, 8, 8, 8)[0] for v in lng)
    lat = spark.createDataFrame([(v,) for v in (90.0, 89.9, 85.0, -85.0, -90.0)], "v double").select("v", codec.y_tile(F.col("v"), 10).alias("t"))
    assert {r["v"]: r["t"] for r in lat.collect()} == {v: tiles(0, v, 0, 0, 8, 10, 8, 8)[1] for v in (90.0, 89.9, 85.0, -85.0, -90.0)}
    nulls = spark.sql("select cast(null as double) v").select(codec.x_tile(F.col("v"), 3), codec.y_tile(F.col("v"), 3), codec.f_tile_linear(F.col("v"), 3)).first()
    assert list(nulls) == [None] * 3


def test_bad_bytes_fail(spark):
    for data in (b"", b"\xf0", b"\x84"):
        df = spark.createDataFrame([(bytearray(data),)], "b binary").select(codec.bytes_to_bits(F.col("b")))
        with pytest.raises(PySparkException):
            df.collect()


def test_leading_zeros(spark):
    df = spark.createDataFrame([(35.0, 5)], "y double, t long")
    bits = codec.encode(df, y="y", t="t", zooms={"y": 4, "t": 8}).select(codec.id_bits().alias("b")).first()["b"]
    assert bits.startswith("0101")
    assert spark.createDataFrame([(bits,)], "b string").select(codec.strip_leading_zeros(F.col("b"))).first()[0] == bits[1:]


def test_common_prefix_and_match(spark):
    from tests.helpers import SCHEMA, cell, prefix

    pairs = [
        (cell(x=prefix("0110"), y=prefix("1")), cell(x=prefix("01011"), y=prefix("0")), cell(x=prefix("01")), False),
        (cell(x=prefix("0110"), t=prefix("11")), cell(x=prefix("01"), y=prefix("0")), cell(x=prefix("01")), True),
        (cell(x=prefix("1")), cell(x=prefix("0")), cell(), False),
    ]
    for a, b, want, overlap in pairs:
        both = prefixed(spark.createDataFrame([a], SCHEMA), "a_").crossJoin(prefixed(spark.createDataFrame([b], SCHEMA), "b_"))
        assert tuple(both.select(*common_prefix("a_", "b_")).first()) == want
        assert both.select(matches("a_", "b_")).first()[0] is overlap


def test_bounds_hold_their_points(spark):
    df = spark.createDataFrame([(139.75, 35.68, 10.0), (-179.99, -84.0, -16000.0)], "x double, y double, f double")
    got = codec.encode(df.withColumns({"px": F.col("x"), "py": F.col("y"), "pf": F.col("f")}), x="x", y="y", f="f", zooms={"x": 12, "y": 12, "f": 12}).withColumns(codec.bounds())
    for r in got.collect():
        assert r["west"] <= r["px"] < r["east"] and r["south"] < r["py"] <= r["north"] and r["bottom"] <= r["pf"] < r["top"]


def test_geodesy(spark):
    df = spark.createDataFrame([(37.5, 139.9, 37.51, 139.93)], "a double, b double, c double, d double")
    a, b, c, d = (F.col(x) for x in "abcd")
    lat, lon = geo.destination_point(a, b, geo.initial_bearing_deg(a, b, c, d), geo.haversine_m(a, b, c, d))
    r = df.select(lat.alias("lat"), lon.alias("lon")).first()
    assert r["lat"] == pytest.approx(37.51, abs=1e-9) and r["lon"] == pytest.approx(139.93, abs=1e-9)
    p, q = geo.enu_to_wgs84(F.lit(250.0), F.lit(-120.0), 37.5, 139.9)
    e, n = geo.wgs84_to_enu(p, q, 37.5, 139.9)
    r = spark.range(1).select(e.alias("e"), n.alias("n"), geo.haversine_m(F.lit(37.5), F.lit(139.9), p, q).alias("d")).first()
    assert r["e"] == pytest.approx(250, abs=1e-6) and r["n"] == pytest.approx(-120, abs=1e-6) and r["d"] == pytest.approx(math.hypot(250, 120), rel=3e-3)
    assert geo.height_boundary_near_zero(codec.F_LOW, codec.F_HIGH, 14) == pytest.approx(0, abs=1.0)


def test_sql_functions(spark):
    from tesseral.functions.register import register

    assert "tess_time_cover" in register(spark)
    df = spark.createDataFrame([(139.75, 35.68, 10.0, 1747839600), (-190.0, -89.0, -5.0, 0)], "x double, y double, f double, t long")
    want = df.select(codec.x_tile(F.col("x"), 10), codec.y_tile(F.col("y"), 12), codec.f_tile(F.col("f"), 9), codec.t_tile(F.col("t"), 20)).collect()
    df.createOrReplaceTempView("points_for_sql")
    got = spark.sql("select tess_x_tile(x, 10), tess_y_tile(y, 12), tess_f_tile(f, 9), tess_t_tile(t, 20) from points_for_sql").collect()
    assert list(map(tuple, got)) == list(map(tuple, want))
    cover = spark.sql("select zt, vt from tess_time_cover(3, 17)").collect()
    assert sorted((r["vt"] << (32 - r["zt"]), (r["vt"] + 1) << (32 - r["zt"])) for r in cover) == [(3, 4), (4, 8), (8, 16), (16, 17)]
    assert sorted(map(tuple, spark.sql("select * from tess_refine(5, 3)").collect())) == [(4, 10), (4, 11)]
    assert spark.sql("select tess_compatible(5, 3, 2, 2), tess_subsumes(5, 3, 2, 2), tess_subsumes(2, 2, 5, 3), tess_prefix_bits(5, 4), tess_time_block(30)").first()[:] == (True, False, True, "0101", 4)


def test_bytes_of_ids_take_no_steps_by_digit(spark):
    """IDs of all lengths, and longer strings; up to the longest ID no array of digits is made."""
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("01") for _ in range(n)) for n in [*range(1, 160), 192, 193, 200, 500]]
    df = spark.createDataFrame([(t,) for t in texts], "b string")
    made = {r["b"]: bytes(r["x"]) for r in df.select("b", codec.id_bytes(F.col("b")).alias("x")).collect()}
    assert made == {t: int(t.ljust(-(-len(t) // 8) * 8, "0"), 2).to_bytes(-(-len(t) // 8), "big") for t in texts}
    ids = ["0000", "1000" + "00111" + "10101010", "1111" + "11111" * 4 + "1" * 128, "0101" + "00000" + "11111" + "0" + "01" * 16]
    raw = spark.createDataFrame([(t, int(t.ljust(-(-len(t) // 8) * 8, "0"), 2).to_bytes(-(-len(t) // 8), "big")) for t in ids], "b string, x binary")
    assert all(r["b"] == r["got"] for r in raw.select("b", codec.bytes_to_bits(F.col("x")).alias("got")).collect())
    plan = raw.select(codec.bytes_to_bits(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan
