"""A day of flights as one plan: routes, samples, reservations, conformance, overlaps, totals, and the document that holds them all."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions import codec
from tesseral.functions.cells import shl
from tesseral.operators.lineage import kept, spread
from tesseral.plans import airspace
from tesseral.sources.document import EMPTY, read_document, write_document


#: Rows of a scenario that a task sorts and writes.
ROWS_PER_TASK = 150_000


@dataclass
class Scenario:
    """The tables of a scenario; each is made once and stored."""

    flights: DataFrame  #: with route and reservation window, a row each
    nominal: DataFrame
    flown: DataFrame  #: judged samples
    reserved: DataFrame
    overlaps: DataFrame
    conformance: DataFrame  #: counts, a row a flight
    summary: DataFrame  #: one row
    start_s: int
    end_s: int


def plan_scenario(flights: DataFrame, start_s: int, end_s: int, flown: DataFrame | None = None) -> Scenario:
    """The scenario of these flights between two times.

    flights: see airspace. flown: samples flight_id, epoch_s, phase, lat, lon, ground_m, amsl_m as recorded; by default the planned course with the
    disturbances of airspace.actual_samples. Flights without a speed or a route have no samples, reservations or window, and counts of 0.
    """
    nominal = kept(airspace.nominal_samples(flights.where("cruise_speed_mps > 0 and distance_m is not null" if "distance_m" in flights.columns else "cruise_speed_mps > 0"), end_s), "nominal")
    bubble = airspace.VERTICAL_BUBBLE_M
    reserved = kept(airspace.reservations(nominal, F.greatest(F.lit(0.0), F.col("agl_m") - bubble), F.col("agl_m") + bubble, start_s, end_s), "reserved")
    flown = kept(airspace.actual_samples(flights, end_s) if flown is None else flown, "flown")
    judged = kept(airspace.conformance(flown, reserved), "judged")
    over = kept(airspace.overlaps(reserved, merged=True), "overlaps")
    window = reserved.groupBy("flight_id").agg(F.min("start_s").alias("from_s"), F.max("end_s").alias("to_s"), F.countDistinct("x21", "y21", "h12").alias("atoms"), F.count("*").alias("intervals"))
    planned = nominal.groupBy("flight_id").agg(F.count("*").alias("nominal_samples"))
    counts = airspace.conformance_counts(judged).join(spread(judged.groupBy("flight_id").agg(F.count("*").alias("flown_samples"))), "flight_id")
    named = airspace.with_route(flights).join(spread(window), "flight_id", "left").join(spread(planned), "flight_id", "left").fillna(0, ["atoms", "intervals", "nominal_samples"])
    tallies = ["applicable", "inside", "outside", "horizontal_violations", "altitude_violations", "time_violations", "flown_samples"]
    conformance = kept(flights.select("flight_id").join(spread(counts), "flight_id", "left").fillna(0, [*tallies, "inside_ratio"]), "conformance")
    sums = conformance.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tallies])
    shape = over.agg(F.count("*").alias("overlap_segments"))
    summary = airspace.scenario_summary(reserved, over).crossJoin(shape).crossJoin(sums)  # one row each
    return Scenario(kept(named, "flights"), nominal, judged, reserved, over, conformance, kept(summary, "summary"), start_s, end_s)


def atom_document(x: Column, y: Column, h: Column) -> Column:
    """A reservation cell's zooms, indices and bounds as a struct."""
    v = {"x": x, "y": y, "h": h}
    low, high = (F.lit(codec.F_LOW) + shl(i, F.lit(32 - airspace.H_ZOOM)) / F.lit(4294967295.0) * F.lit(codec.F_HIGH - codec.F_LOW) for i in (v["h"], v["h"] + 1))
    z = F.lit(airspace.ATOM_ZOOM)
    bounds = F.struct(
        codec.x_west(v["x"], z).alias("west"), codec.x_west(v["x"] + 1, z).alias("east"), codec.y_north(v["y"] + 1, z).alias("south"),
        codec.y_north(v["y"], z).alias("north"), low.alias("h_bottom_m"), F.least(high, F.lit(codec.F_HIGH)).alias("h_top_m"),
    )
    zooms = [F.lit(n).alias(c) for c, n in (("x_zoom", airspace.ATOM_ZOOM), ("y_zoom", airspace.ATOM_ZOOM), ("h_zoom", airspace.H_ZOOM))]
    return F.struct(*zooms, *[v[c].alias(f"{c}_index") for c in "xyh"], bounds.alias("bounds"))


def speed_class(speed: Column) -> Column:
    slow, medium, _ = airspace.CRUISE_SPEEDS_MPS
    return F.when(speed <= slow, "slow").when(speed <= medium, "medium").otherwise("fast")


def _both_times(**seconds: Column) -> list[Column]:
    return [f.alias(f"{name}_{zone}") for name, s in seconds.items() for zone, f in (("jst", codec.to_iso_jst(s)), ("utc", codec.to_iso(s)))]


_ORDER = ("_section", "_owner", "_part", "_a", "_b", "_c", "_d")


@dataclass
class _Kind:
    """Leaves of one kind: how they are ordered, and how their paths and values are told from rows that have been dealt to tasks and sorted."""

    rows: DataFrame
    order: list[Column]
    path: list[Column | str]  #: of the columns in _ORDER
    value: Callable[[Callable[[str], Column]], Column]  #: of the rows' columns
    empty: bool = False  #: an empty list stands there


def _kind(rows: DataFrame, section: int, path: list[Column | str], value: Callable[[Callable[[str], Column]], Column], owner: Column | None = None, part: int = 0, by: tuple[str, ...] = (), empty: bool = False) -> _Kind:
    zero = F.lit(0).cast("long")
    return _Kind(rows, [F.lit(section), owner if owner is not None else zero, F.lit(part), *map(F.col, by), *[zero] * (4 - len(by))], path, value, empty)


def _kinds(s: Scenario) -> list[_Kind]:
    spark = s.flights.sparkSession
    one = spark.range(1)
    f = F.col("flight_id").cast("long")
    flight = ["flights", F.concat(F.lit("["), F.col("_owner").cast("string"))]
    lit = lambda **x: [F.lit(v).alias(k) for k, v in x.items()]
    rules = F.struct(*lit(xy_zoom=airspace.ATOM_ZOOM, base_xy_zoom=airspace.BASE_ZOOM, margin_xy_zoom=airspace.ATOM_ZOOM, h_zoom=airspace.H_ZOOM, vertical_bubble_m=airspace.VERTICAL_BUBBLE_M, time_bubble_before_s=airspace.TIME_BUBBLE_S, time_bubble_after_s=airspace.TIME_BUBBLE_S), F.array(*map(F.lit, sorted(airspace.RESERVED_PHASES))).alias("reserved_phases"))
    speeds = F.struct(*lit(climb=airspace.CLIMB_MPS, descent=airspace.DESCENT_MPS), F.array(*map(F.lit, airspace.CRUISE_SPEEDS_MPS)).alias("cruise_options"))
    about = F.struct(*_both_times(simulation_start=F.lit(s.start_s), simulation_end=F.lit(s.end_s)), *lit(sample_interval_s=1), speeds.alias("speeds_mps"), rules.alias("reservation"))
    named = lambda c, *names: [c(n).alias(n) for n in names]
    route = lambda c: F.struct(*named(c, "distance_m", "bearing_deg", "origin_lat", "origin_lon", "origin_ground_m", "destination_lat", "destination_lon", "destination_ground_m"))
    head = lambda c: F.struct(c("flight_id").cast("string").alias("flight_id"), *named(c, "target_agl_m"), c("cruise_speed_mps").alias("planned_cruise_speed_mps"), speed_class(c("cruise_speed_mps")).alias("speed_class"), *_both_times(scheduled_departure=c("departure_s")), route(c).alias("route"))
    band = lambda c: [F.greatest(F.lit(0.0), c("target_agl_m") - airspace.VERTICAL_BUBBLE_M).alias("agl_bottom_m"), (c("target_agl_m") + airspace.VERTICAL_BUBBLE_M).alias("agl_top_m")]
    held = lambda c: F.struct(*_both_times(start=c("from_s"), end=c("to_s")), *band(c), c("atoms").alias("dynamic_atom_count"))
    atoms = s.reserved.groupBy("flight_id", "x21", "y21", "h12").agg(F.array_sort(F.collect_list(F.array("start_s", "end_s"))).alias("intervals"))
    cell = ("x21", "y21", "h12")
    atom = lambda c: F.struct(*named(c, *cell, "intervals"))
    key = F.concat_ws(":", F.lit("["), "_a", "_b", "_c")
    second = F.concat(F.lit("["), F.col("_a").cast("string"))
    nominal = lambda c: F.struct(*_both_times(time=c("epoch_s")), *named(c, "epoch_s", "elapsed_s", "phase", "lat", "lon"), c("ground_m").alias("ground_est_m"), *named(c, "agl_m", "amsl_m"), c("horizontal_mps").alias("horizontal_speed_mps"), c("vertical_mps").alias("vertical_speed_mps"), *named(c, "heading_deg"))
    flown = lambda c: F.struct(*named(c, "epoch_s", "phase", "lat", "lon", "ground_m", "amsl_m"), c("inside").alias("inside_reservation"), *named(c, "violation"), F.struct(*named(c, *cell)).alias("reservation_atom"))
    segment = lambda c: F.struct(atom_document(*map(c, cell)).alias("cell"), *_both_times(start=c("start_s"), end=c("end_s")), c("start_s").alias("start_epoch_s"), c("end_s").alias("end_epoch_s"), *named(c, "coverage"), F.transform(c("members"), lambda m: m.cast("string")).alias("flight_ids"))
    tallies = [c for c in s.conformance.columns if c != "flight_id"]
    # A flight's list that no row fills stands there empty.
    none = lambda rows, part, *path: _kind(s.flights.join(spread(rows.select("flight_id").distinct()), "flight_id", "left_anti").select("flight_id"), 2, [*flight, *path], lambda c: F.struct(c("flight_id")), f, part, empty=True)
    return [
        none(s.reserved, 2, "reservation", "dynamic_atoms"), none(s.nominal, 3, "nominal_trajectory"), none(s.flown, 4, "actual_trajectory"),
        _kind(one, 0, ["metadata", "*"], lambda c: about),
        _kind(s.summary, 1, ["summary", "*"], lambda c: F.struct(*named(c, *s.summary.columns))),
        _kind(s.flights, 2, [*flight, "*"], head, f, 0),
        _kind(s.flights, 2, [*flight, "reservation", "*"], held, f, 1),
        _kind(atoms, 2, [*flight, "reservation", "dynamic_atoms", key], atom, f, 2, cell),
        _kind(s.nominal, 2, [*flight, "nominal_trajectory", second], nominal, f, 3, ("epoch_s",)),
        _kind(s.flown, 2, [*flight, "actual_trajectory", second], flown, f, 4, ("epoch_s",)),
        _kind(s.conformance, 2, [*flight, "conformance", "*"], lambda c: F.struct(*named(c, *tallies)), f, 5),
        _kind(s.overlaps, 3, ["overlap_segments", F.concat(key, F.lit(":"), F.col("_d").cast("string"))], segment, None, 0, (*cell, "start_s")),
    ]


def write_scenario_document(s: Scenario, path: str) -> None:
    """The scenario as one nested JSON document, which read_scenario and the readers below take.

    Rows are dealt to tasks and sorted as they are; their text, many times longer, is made after that.
    """
    kinds = _kinds(s)
    rows = [k.rows.select(*[c.alias(n) for c, n in zip(k.order, _ORDER, strict=True)], F.lit(i).alias("_kind"), F.struct("*").alias(f"_row{i}")) for i, k in enumerate(kinds)]
    steps = lambda k: F.array(*[F.lit(p) if isinstance(p, str) else p for p in k.path])
    text = lambda i, k: F.lit(EMPTY) if k.empty else F.to_json(k.value(lambda c: F.col(f"_row{i}.{c}")), {"ignoreNullFields": "false"})
    by_kind = lambda of: F.coalesce(*[F.when(F.col("_kind") == i, of(i, k)) for i, k in enumerate(kinds)])
    leaves = lambda df: df.select(by_kind(lambda i, k: steps(k)).alias("path"), by_kind(text).alias("value"))
    segment = F.col("_section") == 3  # its elements are told apart by cell and time, those of flights by their owner
    ranges = ["_section", "_owner", *[F.when(segment, F.col(c)).alias(c) for c in _ORDER[3:]]]
    tasks = math.ceil(sum(df.count() for df in (s.reserved, s.nominal, s.flown, s.overlaps)) / ROWS_PER_TASK)
    write_document(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows), path, _ORDER, totals="totals", ranges=ranges, leaves=leaves, tasks=tasks)


_TALLY = "applicable bigint, inside bigint, outside bigint, horizontal_violations bigint, altitude_violations bigint, time_violations bigint, flown_samples bigint, inside_ratio double"


def read_flights(spark: SparkSession, path: str) -> DataFrame:
    """A row for each flight of a scenario document: its times, its band, how many samples it has and how it kept to its reservation."""
    seen = "array<struct<epoch_s:bigint>>"
    tally = ", ".join(c.strip().replace(" ", ":", 1) for c in _TALLY.split(","))
    flight = f"struct<flight_id:string,speed_class:string,scheduled_departure_utc:string,reservation:struct<start_utc:string,end_jst:string,agl_bottom_m:double,agl_top_m:double,dynamic_atom_count:bigint>,nominal_trajectory:{seen},actual_trajectory:{seen},conformance:struct<{tally}>>"
    doc = read_document(spark, path, f"flights array<{flight}>").select(F.explode("flights").alias("f"))
    sizes = [F.coalesce(F.size(f"f.{c}_trajectory"), F.lit(0)).cast("long").alias(f"{c}_samples") for c in ("nominal", "actual")]
    return doc.select("f.flight_id", "f.speed_class", "f.scheduled_departure_utc", "f.reservation.*", *sizes, "f.conformance.*")


def read_overlaps(spark: SparkSession, path: str) -> DataFrame:
    """A row for each overlap segment of a scenario document, with its cell's bounds."""
    bounds = "struct<west:double,east:double,south:double,north:double,h_bottom_m:double,h_top_m:double>"
    cell = f"struct<x_zoom:int,y_zoom:int,h_zoom:int,x_index:bigint,y_index:bigint,h_index:bigint,bounds:{bounds}>"
    doc = read_document(spark, path, f"overlap_segments array<struct<cell:{cell},start_epoch_s:bigint,end_epoch_s:bigint,coverage:int,flight_ids:array<string>>>")
    o = doc.select(F.explode("overlap_segments").alias("o"))
    return o.select("o.cell.x_index", "o.cell.y_index", "o.cell.h_index", "o.cell.bounds.*", "o.start_epoch_s", "o.end_epoch_s", "o.coverage", "o.flight_ids")


def read_summary(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The totals of a scenario document; columns as a schema."""
    return read_document(spark, path, f"summary struct<{columns}>").select("summary.*")
