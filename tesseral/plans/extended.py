"""More of the catalogue: scenarios as documents, meshes, and the operators for large keys and mixed regions, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import geodesic
from tesseral.operators import regions, scans
from tesseral.plans import fixtures, oracles, queries, scenario
from tesseral.plans.fixtures import END_S, START_S
from tesseral.sources import obj, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    from tesseral.operators.lineage import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _document(spark: SparkSession, sf: str) -> str:
    """The path of the document of a scenario with a flight for every supplier."""
    path = scratch(spark, "scenario") + ".json.gz"
    scenario.write_scenario_document(scenario.plan_scenario(queries.flights(spark, sf), START_S, END_S), path)
    return path


@query
def scenario_document(spark: SparkSession, sf: str) -> DataFrame:
    """What a scenario's document reserves, read back: a row an interval."""
    return tables.read_scenario(spark, _document(spark, sf))


@query
def scenario_flights(spark: SparkSession, sf: str) -> DataFrame:
    """Each flight of a scenario's document: times, band, samples and conformance."""
    return scenario.read_flights(spark, _document(spark, sf)).withColumn("inside_ratio", F.round("inside_ratio", 9))


@query
def scenario_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap segments of a scenario's document with their cells' bounds."""
    o = scenario.read_overlaps(spark, _document(spark, sf))
    edges = ("west", "east", "south", "north", "h_bottom_m", "h_top_m")
    return o.select("x_index", "y_index", "h_index", *[F.round(c, 6).alias(c) for c in edges], "start_epoch_s", "end_epoch_s", "coverage", F.array_join("flight_ids", "|").alias("flight_ids"))


_TOTALS = "flights bigint, atoms bigint, overlap_atoms bigint, max_coverage bigint, max_active bigint, overlap_segments bigint, applicable bigint, inside bigint, outside bigint, horizontal_violations bigint, altitude_violations bigint, time_violations bigint, flown_samples bigint"


@query
def scenario_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of a scenario's document."""
    return scenario.read_summary(spark, _document(spark, sf), _TOTALS)


def _scenario_sql() -> dict[str, str]:
    o = oracles
    nominal = o.O["nominal_trajectory"].rsplit("select k as flight_id", 1)[0].replace("select k, phase, dep + e as epoch_s,", "select k, phase, agl as tagl, (1 - fr) * og + fr * dg as ground_m, dep + e as epoch_s,")
    flown = o.O["actual_trajectory"].rsplit("select k as flight_id", 1)[0]
    reserved = o._RES.replace("ground_m + 20e0", "ground_m + (tagl - 10e0)").replace("ground_m + 40e0 - 1e-9", "ground_m + (tagl + 10e0) - 1e-9")
    judged = o._judged("0e0").replace("select flight_id, epoch_s + flight_id * 20 as epoch_s, phase, lat, lon, amsl_m from samples", "select flight_id, epoch_s, phase, lat, lon, amsl_m from act")
    base = f"with samples as materialized ({nominal} select k as flight_id, epoch_s, phase, lat, lon, ground_m, tagl from u),\n{reserved},\nroutes as ({o._FLIGHTS} select * from r2)"
    acts = f"act as materialized ({flown} select k as flight_id, dep + e as epoch_s, phase, lat, lon, amsl as amsl_m from g3),\n{judged}"
    iso = lambda s, jst="": f"strftime(make_timestamp(({s}{jst}) * 1000000), '%Y-%m-%dT%H:%M:%S{'+09:00' if jst else 'Z'}')"
    tally = """count(inside) as applicable, count(*) filter (where inside) as inside, count(*) filter (where not inside) as outside, count(*) filter (where violation = 'horizontal') as horizontal_violations,
      count(*) filter (where violation = 'altitude') as altitude_violations, count(*) filter (where violation = 'time') as time_violations, count(*) as flown_samples"""
    names = "applicable inside outside horizontal_violations altitude_violations time_violations flown_samples".split()
    sql = {}
    sql["scenario_document"] = f"""{base}
select res.flight_id::varchar as flight_id, greatest(0e0, agl - 10e0) as agl_bottom_m, agl + 10e0 as agl_top_m, 21 as xy_zoom, 12 as h_zoom, x21, y21, h12, start_s, end_s from res join routes on k = flight_id"""
    sql["scenario_flights"] = f"""{base}, {acts},
  tally as (select flight_id, {tally} from judged group by 1), span as (select flight_id, min(start_s) as a, max(end_s) as b, count(distinct (x21, y21, h12)) as n from res group by 1)
select k::varchar as flight_id, case when v <= 5 then 'slow' when v <= 8 then 'medium' else 'fast' end as speed_class, {iso("dep")} as scheduled_departure_utc, {iso("span.a")} as start_utc, {iso("span.b", " + 32400")} as end_jst,
  greatest(0e0, agl - 10e0) as agl_bottom_m, agl + 10e0 as agl_top_m, coalesce(span.n, 0) as dynamic_atom_count, (select count(*) from samples s where s.flight_id = k) as nominal_samples, coalesce(t.flown_samples, 0) as actual_samples,
  {", ".join(f"coalesce(t.{n}, 0) as {n}" for n in names)}, round(case when coalesce(t.applicable, 0) > 0 then t.inside / t.applicable else 0 end, 9) as inside_ratio
from routes left join tally t on t.flight_id = k left join span on span.flight_id = k"""
    west = lambda v: f"round(-180e0 + ({v}) * (360e0 / 2097152), 6)"
    north = lambda v: f"round(degrees(atan(sinh(pi() * (1e0 - 2e0 * ({v}) / 2097152)))), 6)"
    height = lambda v: f"round(least(-16383e0 + (({v}) << 20) / 4294967295e0 * 32767e0, 16384e0), 6)"
    sql["scenario_overlaps"] = f"""{base}, {o._OVER}
select x21 as x_index, y21 as y_index, h12 as h_index, {west("x21")} as west, {west("x21 + 1")} as east, {north("y21 + 1")} as south, {north("y21")} as north, {height("h12")} as h_bottom_m, {height("h12 + 1")} as h_top_m,
  start_s as start_epoch_s, end_s as end_epoch_s, coverage::int as coverage, members as flight_ids from seg where coverage >= 2"""
    summary = o.O["scenario_summary"].rsplit("\nselect", 1)[1]
    ends = "f as (select flight_id, min(start_s) as a, max(end_s) as b from res group by 1), e as (select a as t, 1 as d from f union all select b, -1 from f)"
    sql["scenario_totals"] = f"""{base}, {acts}, {o._OVER}, {ends}
select {summary.strip()}, (select count(*) from seg where coverage >= 2) as overlap_segments, {", ".join(f"(select {t.strip()} from judged)" for t in ("count(inside)", "count(*) filter (where inside)", "count(*) filter (where not inside)", "count(*) filter (where violation = 'horizontal')", "count(*) filter (where violation = 'altitude')", "count(*) filter (where violation = 'time')", "count(*)"))}"""
    for name in names:
        sql["scenario_totals"] = sql["scenario_totals"].replace(" from judged)", f" from judged_) as {name}", 1)
    sql["scenario_totals"] = sql["scenario_totals"].replace("judged_)", "judged)")
    return sql


ORACLE_SQL.update(_scenario_sql())


#: A box for each customer: low and high edges by axis.
_BOX = {
    "low_e": "cast(c_custkey % 97 as double) * 3.5D", "low_n": "cast(c_custkey % 89 as double) * 2.25D", "low_u": "cast(c_nationkey as double) * 8",
    "high_e": "cast(c_custkey % 97 as double) * 3.5D + 1 + c_custkey % 5", "high_n": "cast(c_custkey % 89 as double) * 2.25D + 2", "high_u": "cast(c_nationkey as double) * 8 + 0.5D + c_custkey % 3",
}


@query
def mesh_triangles(spark: SparkSession, sf: str) -> DataFrame:
    """The triangles of a mesh of boxes, written as OBJ files and read back by ranges."""
    boxes = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey as box", *[f"{v} as {k}" for k, v in _BOX.items()])
    path = scratch(spark, "mesh")
    tables.box_mesh_lines(boxes, named=True).select("value").write.text(path)
    made = obj.triangles(obj.read_mesh(spark, path))
    return made.select(F.col("object").cast("long").alias("box"), *[n + c for n in "abc" for c in "xyz"])


_corner = lambda at, axis: f"case when (({at} - 1) >> {'enu'.index(axis)}) & 1 = 1 then high_{axis} else low_{axis} end"
ORACLE_SQL["mesh_triangles"] = (
    "with boxes as (select c_custkey as box, " + ", ".join(f"{v} as {k}" for k, v in _BOX.items()).replace("3.5D", "3.5e0").replace("2.25D", "2.25e0").replace("0.5D", "0.5e0") + " from customer), "
    "t(a, b, c) as (values (1, 3, 4), (1, 4, 2), (5, 6, 8), (5, 8, 7), (1, 2, 6), (1, 6, 5), (3, 7, 8), (3, 8, 4), (1, 5, 7), (1, 7, 3), (2, 4, 8), (2, 8, 6)) select box, "
    + ", ".join(f"{_corner(n, e)} as {n}{c}" for n in "abc" for c, e in zip("xyz", "enu", strict=True)) + " from boxes, t"
)

#: Both sides of a region together: within one, no two cells are siblings.
_REGION = ["region_id"]


@query
def normalize_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The normal form, cell by cell, of regions of mixed zooms, each brought to it by a task."""
    return regions.normalize_regions(fixtures.cells(spark, sf), _REGION).select(*_REGION, "zx", "zy", "vx", "vy")


@query
def normalize_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What bringing each region to its normal form took."""
    return regions.normalize_counters(fixtures.cells(spark, sf), _REGION)


@query
def merge_one_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Each region after one merge of two siblings."""
    return regions.merge_one_pair(fixtures.cells(spark, sf).drop("side").distinct(), _REGION).select(*_REGION, "zx", "zy", "vx", "vy")


#: More passes than the fixture's regions, of zooms up to 9 and 8, can take in practice; too few would end in other rows.
_PASSES = 24


def _passes(last: int) -> str:
    """CTEs c0 to c{last}, the cells before each pass, k{i}, those that nothing subsumes, and m{i}, the parents merged."""
    key, cell = "region_id", "zx, vx, zy, vy"
    steps = [oracles.CTE["cells"], f"c0 as materialized (select distinct {key}, zx, vx, zy, vy from cells)"]
    for i in range(last):
        steps.append(
            f"k{i} as materialized (select c.* from c{i} c anti join (select c.* from c{i} c join (select distinct {key}, zx, zy from c{i}) v "
            f"on v.region_id = c.region_id and v.zx <= c.zx and v.zy <= c.zy and (v.zx < c.zx or v.zy < c.zy) join c{i} d on d.region_id = c.region_id "
            f"and d.zx = v.zx and d.zy = v.zy and d.vx = c.vx >> (c.zx - v.zx) and d.vy = c.vy >> (c.zy - v.zy)) g using ({key}, {cell}))"
        )
        steps.append(f"x{i} as materialized (select {key}, 'x' as axis, zx - 1 as zx, vx >> 1 as vx, zy, vy from k{i} where zx > 1 group by {key}, zx, vx >> 1, zy, vy having count(*) = 2)")
        steps.append(f"y{i} as materialized (select {key}, 'y' as axis, zx, vx, zy - 1 as zy, vy >> 1 as vy from k{i} where zy > 1 and region_id not in (select region_id from x{i}) group by {key}, zx, vx, zy, vy >> 1 having count(*) = 2)")
        steps.append(f"m{i} as materialized (select * from x{i} union all select * from y{i})")
        steps.append(
            f"c{i + 1} as materialized (select {key}, {cell} from m{i} union select {key}, {cell} from k{i} k anti join (select {key}, zx + (axis = 'x')::int as zx, vx * (1 + (axis = 'x')::int) + case when axis = 'x' then b else 0 end as vx, "
            f"zy + (axis = 'y')::int as zy, vy * (1 + (axis = 'y')::int) + case when axis = 'y' then b else 0 end as vy from m{i}, (values (0), (1)) t(b)) g using ({key}, {cell}))"
        )
    return "with " + ",\n".join(steps)


ORACLE_SQL["normalize_regions"] = _passes(_PASSES) + f"\nselect region_id, zx, zy, vx, vy from c{_PASSES}"
_tally = " union all ".join(f"select region_id, '{t}' as kind, {i} as pass, count(*) as n from {t}{i} group by 1" for i in range(_PASSES) for t in "ckm")
ORACLE_SQL["normalize_counters"] = (
    _passes(_PASSES) + f", tally as ({_tally} union all select region_id, 'n', 0, count(*) from c{_PASSES} group by 1)\n"
    "select region_id, sum(n) filter (where kind = 'c' and pass = 0)::bigint as cells, sum(n) filter (where kind = 'n')::bigint as normal, count(*) filter (where kind = 'm') as passes, "
    "(sum(n) filter (where kind = 'c') - sum(n) filter (where kind = 'k'))::bigint as dropped, coalesce(sum(n) filter (where kind = 'm'), 0)::bigint as merged from tally group by 1"
)
ORACLE_SQL["merge_one_pair"] = f"""with {oracles.CTE["cells"]}, pairs as (
  select region_id, 1 as axis, zx, zy, vx >> 1 as px, vy as py from (select distinct region_id, zx, vx, zy, vy from cells) where zx > 1 group by region_id, zx, zy, vx >> 1, vy having count(*) = 2
  union all select region_id, 2, zx, zy, vx, vy >> 1 from (select distinct region_id, zx, vx, zy, vy from cells) where zy > 1 group by region_id, zx, zy, vx, vy >> 1 having count(*) = 2),
  one as (select * from (select *, row_number() over (partition by region_id order by axis, zx, zy, px, py) as n from pairs) where n = 1)
select region_id, zx, zy, vx, vy from (select distinct region_id, zx, vx, zy, vy from cells) c anti join (select region_id, zx, zy, case when axis = 1 then px * 2 + b else px end as vx, case when axis = 2 then py * 2 + b else py end as vy from one, (values (0), (1)) t(b)) g using (region_id, zx, zy, vx, vy)
union select region_id, case when axis = 1 then zx - 1 else zx end, case when axis = 2 then zy - 1 else zy end, px, py from one"""


@query
def merge_intervals_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The intervals of each key, joined, by ranges of key and time."""
    return scans.merged_intervals(fixtures.intervals(spark, sf), ["key"])


@query
def canonical_order_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical place of each cell in its region, by ranges of region and cell."""
    order = ["flags", "zx", "zy", "zf", "zt", "vx", "vy", "vf", "vt"]
    return scans.ranked(fixtures.cells(spark, sf), ["region_id", "side"], order).select("region_id", "side", "zx", "zy", "vx", "vy", "rank")


@query
def asof_in_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The latest sample before each instant asked for, by ranges of flight and time; the last one holds on after a flight's end."""
    samples = fixtures.flight_samples(spark, sf).groupBy("flight_id", "epoch_s").agg(F.max("amsl_m").alias("amsl_m"))
    asked = samples.select((F.col("flight_id") % 41).alias("flight_id"), (F.col("epoch_s") * 7 % 8000 + START_S - 400).alias("epoch_s")).distinct()
    found = scans.asof(asked, samples, ["flight_id"], "epoch_s", "epoch_s")
    return found.select("flight_id", "epoch_s", F.coalesce("s_epoch_s", F.lit(-1)).alias("s_epoch_s"), F.coalesce("s_amsl_m", F.lit(-1.0)).alias("s_amsl_m"))


ORACLE_SQL["merge_intervals_in_ranges"] = oracles.O["merge_intervals"]
ORACLE_SQL["canonical_order_in_ranges"] = oracles.O["canonical_order"]
ORACLE_SQL["asof_in_ranges"] = f"""with {oracles.CTE["samples"]}, s as (select flight_id, epoch_s, max(amsl_m) as amsl_m from samples group by 1, 2),
  q as (select distinct flight_id % 41 as flight_id, epoch_s * 7 % 8000 + {START_S - 400} as epoch_s from s)
select q.flight_id, q.epoch_s, coalesce(s.epoch_s, -1) as s_epoch_s, coalesce(s.amsl_m, -1e0) as s_amsl_m from q asof left join s on q.flight_id = s.flight_id and q.epoch_s >= s.epoch_s"""


@query
def cloud_azimuthal(spark: SparkSession, sf: str) -> DataFrame:
    """Points in metres about the anchor to degrees on the ellipsoid, and back to millimetres."""
    there = geodesic.enu_to_wgs84(queries._cloud(spark, sf), F.col("e"), F.col("n"), *queries._ANCHOR)
    back = geodesic.wgs84_to_enu(there, F.col("lat"), F.col("lon"), *queries._ANCHOR, ("e2", "n2"))
    return back.select("point_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("e2", 3).alias("e"), F.round("n2", 3).alias("n"))


def _direct_sql() -> str:
    """Vincenty's direct series from the anchor, a step a table."""
    f, a = geodesic.FLAT, geodesic.A_M
    b = a * (1 - f)
    steps = [
        "radians(37.5e0) as p, atan2(e, n) as z, sqrt(e * e + n * n) as d", f"atan({1 - f!r} * tan(p)) as uu", "atan2(tan(uu), cos(z)) as s1, cos(uu) * sin(z) as sine", "1 - sine * sine as sq",
        f"sq * {(a * a - b * b) / (b * b)!r} as w", f"d / ({b!r} * (1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))))) as s0, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) as bb", "s0 as g0",
    ]
    for i in range(5):
        steps += [f"cos(2 * s1 + g{i}) as m{i}", f"s0 + bb * sin(g{i}) * (m{i} + bb / 4 * (cos(g{i}) * (2 * m{i} * m{i} - 1) - bb / 6 * m{i} * (4 * sin(g{i}) * sin(g{i}) - 3) * (4 * m{i} * m{i} - 3))) as g{i + 1}"]
    steps += [
        f"cos(2 * s1 + g5) as m, {f / 16!r} * sq * (4 + {f!r} * (4 - 3 * sq)) as c", "sin(uu) * sin(g5) - cos(uu) * cos(g5) * cos(z) as x",
        f"degrees(atan2(sin(uu) * cos(g5) + cos(uu) * sin(g5) * cos(z), {1 - f!r} * sqrt(sine * sine + x * x))) as la, "
        f"139.95e0 + degrees(atan2(sin(g5) * sin(z), cos(uu) * cos(g5) - sin(uu) * sin(g5) * cos(z)) - (1 - c) * {f!r} * sine * (g5 + c * sin(g5) * (m + c * cos(g5) * (2 * m * m - 1)))) as lo",
    ]
    tables = [f"d{i} as (select *, {s} from {f'd{i - 1}' if i else 'cloud'})" for i, s in enumerate(steps)]
    return oracles._with("points", oracles._CLOUD, *tables) + f"select point_id, round(case when d = 0 then 37.5e0 else la end, 8) as lat, round(case when d = 0 then 139.95e0 else lo end, 8) as lon, round(e, 3) as e, round(n, 3) as n from d{len(steps) - 1}"


ORACLE_SQL["cloud_azimuthal"] = _direct_sql()
