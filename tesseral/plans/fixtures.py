"""Deterministic cell tables derived from the driver's tables, in Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions.cells import as_cells

EPOCH = "unix_seconds(cast(ts as timestamp))"
#: The scenario's time, in which events are made to lie.
START_S, END_S = 1_700_000_000, 1_700_007_200


#: Columns of the grid: blocks of 8 by 16 squares that alternate, in layers that change every 4 columns, so holes stay at any size.
_PLAID_X = "(l_orderkey*7 + l_linenumber*3) % 32"
_PLAID_Y = f"(l_partkey*5 + l_linenumber) % 16 + 16 * ((({_PLAID_X}) >> 3) & 1)"
_PLAID_H = f"l_suppkey % 2 + 2 * ((({_PLAID_X}) >> 2) & 1)"
#: A point of a ball's surface for each line: 96 steps around and 48 from pole to pole.
_BALL = tuple(
    f"cast(floor(16.37D + 12 * {c}) as bigint)"
    for c in (
        "cos(3.141592653589793D * (l_orderkey % 96) / 48) * sin(3.141592653589793D * (l_partkey % 48 + 0.5D) / 48)",
        "sin(3.141592653589793D * (l_orderkey % 96) / 48) * sin(3.141592653589793D * (l_partkey % 48 + 0.5D) / 48)",
        "cos(3.141592653589793D * (l_partkey % 48 + 0.5D) / 48)",
    )
)


def _sql(spark: SparkSession, sf_dir: str, table: str, query: str) -> DataFrame:
    return spark.sql(query, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, region_id, user_id, lon, lat, alt, t."""
    return _sql(spark, sf_dir, "events", f"""
        select event_id as point_id, event_type as region_id, user_id,
          139.90D + cast((user_id*37 + event_id % 50) % 100 as double)/1000D as lon,
          37.45D + cast((user_id*53 + event_id % 30) % 100 as double)/1000D as lat, value as alt, {EPOCH} as t from {{t}}""")  # fmt: skip


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, side and the distinct mixed-zoom cells on x and y of each."""
    rows = _sql(spark, sf_dir, "orders", """
        select distinct o_orderstatus as region_id, o_orderkey % 2 as side, cast(5 + o_orderkey % 5 as bigint) as zx,
          (o_orderkey*40503) % (1L << cast(5 + o_orderkey % 5 as int)) as ix, cast(5 + o_custkey % 4 as bigint) as zy,
          (o_custkey*7919) % (1L << cast(5 + o_custkey % 4 as int)) as iy from {t}""")  # fmt: skip
    return as_cells(rows, x=("zx", "ix"), y=("zy", "iy"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, ix, iy, ih on a grid of zooms 5, 5 and 2, of every line."""
    return _sql(spark, sf_dir, "lineitem", f"""
        select distinct l_returnflag as region_id, {_PLAID_X} as ix, {_PLAID_Y} as iy, {_PLAID_H} as ih from {{t}}""")


def shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, ix, iy, ih: a hollow ball of radius 12 around (16, 16, 16), seen from every line."""
    return _sql(spark, sf_dir, "lineitem", f"select distinct l_returnflag as region_id, {_BALL[0]} as ix, {_BALL[1]} as iy, {_BALL[2]} as ih from {{t}}")


def shell_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shell(spark, sf_dir).select("region_id", *[F.lit(5).alias(n) for n in ("zx", "zy", "zf")], "ix", "iy", "ih")
    return as_cells(rows, x=("zx", "ix"), y=("zy", "iy"), f=("zf", "ih"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).select("region_id", *[F.lit(z).alias(n) for n, z in (("zx", 5), ("zy", 5), ("zf", 2))], "ix", "iy", "ih")
    return as_cells(rows, x=("zx", "ix"), y=("zy", "iy"), f=("zf", "ih"))


def line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, side and distinct cells of zoom 16 on x."""
    rows = _sql(spark, sf_dir, "lineitem", """
        select distinct l_returnflag as region_id, l_linenumber % 2 as side, 16 as zx,
          (l_orderkey*31 + l_linenumber*7 + l_partkey % 3) % 65536 as ix from {t}""")  # fmt: skip
    return as_cells(rows, x=("zx", "ix"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, event_id, start_s, end_s."""
    return _sql(spark, sf_dir, "events", f"select user_id as key, event_id, {EPOCH} as start_s, {EPOCH} + 300 + (event_id % 7)*3600 as end_s from {{t}}")


def flight_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 40 flights within two hours: flight_id, epoch_s, phase, lat, lon, ground_m, amsl_m."""
    return _sql(spark, sf_dir, "events", f"""
        select user_id % 40 as flight_id, {START_S} + event_id*61 % 7200 as epoch_s, case when event_id % 9 = 0 then 'climb' else 'cruise' end as phase,
          37.45D + cast((user_id*53 + event_id % 7) % 40 as double)/10000D as lat, 139.90D + cast((user_id*37 + event_id % 5) % 40 as double)/10000D as lon,
          200D + cast(event_id % 10 as double) as ground_m, 240D + cast(event_id % 31 as double) as amsl_m from {{t}}""")  # fmt: skip


EP = "(epoch_us(ts)//1000000)"
#: The same tables as common table expressions for DuckDB.
CTE = {
    "points": f"""points as (select event_id as point_id, event_type as region_id, user_id,
        139.90::double + ((user_id*37 + event_id % 50) % 100)::double/1000::double as lon,
        37.45::double + ((user_id*53 + event_id % 30) % 100)::double/1000::double as lat, value as alt, {EP} as t from events)""",
    "cells": """cells as (select distinct o_orderstatus as region_id, o_orderkey % 2 as side, (5 + o_orderkey % 5)::int as zx,
        (o_orderkey*40503) % (1::bigint << (5 + o_orderkey % 5)::int) as vx, (5 + o_custkey % 4)::int as zy,
        (o_custkey*7919) % (1::bigint << (5 + o_custkey % 4)::int) as vy from orders)""",
    "grid": f"grid as (select distinct l_returnflag as region_id, {_PLAID_X} as ix, {_PLAID_Y} as iy, {_PLAID_H} as ih from lineitem)",
    "shell": "sh as (select distinct l_returnflag as region_id, " + ", ".join(f"{c} as {n}" for c, n in zip(_BALL, ("ix", "iy", "ih"), strict=True)).replace("3.141592653589793D", "3.141592653589793e0").replace("16.37D", "16.37e0").replace("0.5D", "0.5e0") + " from lineitem)",
    "line": """line as (select distinct l_returnflag as region_id, l_linenumber % 2 as side,
        (l_orderkey*31 + l_linenumber*7 + l_partkey % 3) % 65536 as ix from lineitem)""",
    "intervals": f"intervals as (select user_id as key, event_id, {EP} as start_s, {EP} + 300 + (event_id % 7)*3600 as end_s from events)",
    "samples": f"""samples as (select user_id % 40 as flight_id, {START_S} + event_id*61 % 7200 as epoch_s, case when event_id % 9 = 0 then 'climb' else 'cruise' end as phase,
        37.45::double + ((user_id*53 + event_id % 7) % 40)::double/10000::double as lat, 139.90::double + ((user_id*37 + event_id % 5) % 40)::double/10000::double as lon,
        200::double + (event_id % 10)::double as ground_m, 240::double + (event_id % 31)::double as amsl_m from events)""",
}
