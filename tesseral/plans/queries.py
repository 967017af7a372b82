"""The catalogue of queries over the driver's tables; plans.oracles has the SQL of each that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions import codec, geo
from tesseral.functions.cells import CELL, VALUES, ZOOMS, common_prefix, matches
from tesseral.operators import algebra, intervals, joins, neighbors, occupancy
from tesseral.plans import airspace, compression, fixtures
from tesseral.plans.fixtures import END_S, START_S

QUERIES = {}


def query(f):  # noqa: ANN001, ANN201
    QUERIES[f.__name__] = f
    return f


def _encoded(spark: SparkSession, sf: str, zooms: tuple[int, int, int, int] = (10, 10, 5, 20)) -> DataFrame:
    p = fixtures.points(spark, sf)
    return codec.encode(p, x="lon", y="lat", f="alt", t="t", zooms=dict(zip("xyft", zooms, strict=True)))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each point with the next by number, at other zooms; every third left point lacks x and every fifth right one t."""
    p = fixtures.points(spark, sf).withColumn("lon", F.when(F.col("point_id") % 3 != 0, F.col("lon")))
    a = codec.encode(p, x="lon", y="lat", f="alt", t="t", zooms={"x": 20, "y": 18, "f": 16, "t": 12})
    q = fixtures.points(spark, sf).withColumn("t", F.when(F.col("point_id") % 5 != 0, F.col("t")))
    b = codec.encode(q, x="lon", y="lat", f="alt", t="t", zooms={"x": 14, "y": 21, "f": 20, "t": 10})
    b = joins.prefixed(b.select((F.col("point_id") - 1).alias("of"), *CELL), "r_")
    return a.join(b, F.col("point_id") == F.col("r_of"))


@query
def tiles(spark: SparkSession, sf: str) -> DataFrame:
    x, y, f, t = F.col("lon"), F.col("lat"), F.col("alt"), F.col("t")
    return fixtures.points(spark, sf).select(
        "point_id", codec.x_tile(x, 10).alias("x10"), codec.x_tile(x * 7 - 1000, 24).alias("x24"), codec.y_tile(y, 10).alias("y10"), codec.y_tile(y * 2 - 40, 20).alias("y20"),
        codec.f_tile(f, 6).alias("f6"), codec.f_tile(f, 12).alias("f12"), codec.f_tile_linear(f, 14).alias("l14"), codec.t_tile(t, 16).alias("t16"),
    )


@query
def encode_bits(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("point_id", codec.id_bits().alias("id_bits"), codec.bit_length().cast("long").alias("bit_len"))


@query
def encode_bits_no_x(spark: SparkSession, sf: str) -> DataFrame:
    cells = codec.encode(fixtures.points(spark, sf), y="lat", f="alt", t="t", zooms={"y": 12, "f": 9, "t": 21})
    bits = cells.select("point_id", codec.id_bits().alias("id_bits"))
    return bits.withColumn("as_integer", codec.strip_leading_zeros(F.col("id_bits")))


@query
def decode_cells(spark: SparkSession, sf: str) -> DataFrame:
    back = codec.decode(codec.parse_bits(_encoded(spark, sf).select("point_id", codec.id_bits().alias("b")), "b"))
    return back.select("point_id", *[F.round(c, 8).alias(c) for c in "xyf"], "t")


@query
def id_separate(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("point_id", codec.id_separate().alias("readable"))


@query
def bytes_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    cells = _encoded(spark, sf, (7, 9, 5, 13)).select("point_id", codec.id_bits().alias("id_bits"))
    return cells.withColumn("b", codec.id_bytes(F.col("id_bits"))).select("point_id", F.hex("b").alias("id_hex"), codec.bytes_to_bits(F.col("b")).alias("id_bits"))


@query
def iso_time(spark: SparkSession, sf: str) -> DataFrame:
    iso = fixtures.points(spark, sf).select("point_id", codec.to_iso(F.col("t")).alias("iso"))
    return iso.withColumn("t", codec.from_iso(F.col("iso")))


@query
def tile_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("point_id", *[F.round(c, 8).alias(n) for n, c in codec.bounds().items()])


@query
def common_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("point_id", *common_prefix("", "r_"))


@query
def match_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("point_id", matches("", "r_").alias("overlap"))


@query
def shared_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The first query end to end: coarse cells that several event types share."""
    cells = _encoded(spark, sf, (8, 8, 6, 16)).select("region_id", *CELL).distinct()
    shared = cells.groupBy(*CELL).agg(F.count("*").alias("regions")).where("regions >= 2")
    return shared.select(codec.id_bits().alias("id_bits"), "regions")


@query
def haversine_bearing(spark: SparkSession, sf: str) -> DataFrame:
    site = (F.lit(37.5), F.lit(139.93))
    p = fixtures.points(spark, sf)
    lat, lon = geo.destination_point(F.col("lat"), F.col("lon"), F.col("alt"), F.lit(1000.0))
    return p.select("point_id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), *site), 4).alias("metres"), F.round(geo.initial_bearing_deg(F.col("lat"), F.col("lon"), *site), 6).alias("bearing"), F.round(lat, 8).alias("to_lat"), F.round(lon, 8).alias("to_lon"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = fixtures.cells(spark, sf)
    return c.where("side = 0").drop("side"), c.where("side = 1").drop("side")


XY = ("zx", "zy", "vx", "vy")


@query
def subsumes_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    found = joins.containment_join(a, b, by=["region_id"])
    return found.groupBy("region_id", *["c_" + c for c in XY]).agg(F.count("*").alias("inside"))


@query
def descendants_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    found = joins.containment_join(b, a, by=["region_id"])
    return found.groupBy("region_id", *XY).agg(F.count("*").alias("containers"))


@query
def compatible_join(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return joins.overlap_join(a, b, by=["region_id"]).groupBy("region_id", *XY).agg(F.count("*").alias("partners"), F.sum("r_vx").alias("sum_vx"))


@query
def compatible_pair_count(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return joins.overlap_count(a, b)


@query
def contains_semi(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return joins.covered(a, b, by=["region_id"]).select("region_id", *XY)


@query
def uncovered_anti(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return joins.covered(a, b, by=["region_id"], how="left_anti").select("region_id", *XY)


@query
def meet_cells(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    return joins.meets(a, b, by=["region_id"]).select("region_id", *XY)


@query
def refine_children(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.refine(fixtures.cells(spark, sf), ["x", "y", "x"]).select("region_id", "side", *XY)


@query
def coarsen_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.coarsen(fixtures.cells(spark, sf), {"x": 2, "y": 2}, ["region_id"]).select("region_id", *XY)


@query
def expand_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.atoms(fixtures.cells(spark, sf), {"x": 9, "y": 8}, ["region_id"]).select("region_id", "vx", "vy")


def _atom_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a, b = _sides(spark, sf)
    return tuple(algebra.atoms(x, {"x": 9, "y": 8}, ["region_id"]).select("region_id", "vx", "vy") for x in (a, b))


@query
def atoms_union(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.atoms_union(*_atom_sides(spark, sf))


@query
def atoms_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.atoms_intersection(*_atom_sides(spark, sf))


@query
def atoms_difference(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.atoms_difference(*_atom_sides(spark, sf))


@query
def remove_subsumed(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.remove_subsumed(fixtures.cells(spark, sf), ["region_id"]).select("region_id", *XY)


@query
def normalize_1d_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.normalize(fixtures.line(spark, sf), ["region_id"]).select("region_id", "zx", "vx")


@query
def normalize_3d_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.normalize(fixtures.grid_cells(spark, sf), ["region_id"]).select("region_id", "zx", "vx", "zy", "vy", "zf", "vf")


@query
def normalize_attributes(spark: SparkSession, sf: str) -> DataFrame:
    cells = fixtures.grid_cells(spark, sf).groupBy(*CELL).agg(F.array_join(F.array_sort(F.collect_set("region_id")), "|").alias("attribute"))
    found, merges = compression.normalize_attributes(cells, {"x": 5, "y": 5, "f": 2, "t": 32}, ["attribute"])
    compression.check_merges(cells, found, merges)
    return found.select("attribute", "zx", "vx", "zy", "vy", "zf", "vf")


@query
def normalize_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of the normal form of mixed-zoom regions, which must be those of the regions."""
    normal = algebra.normalize(fixtures.cells(spark, sf).drop("side"), ["region_id"])
    return algebra.atoms(normal, {"x": 9, "y": 8}, ["region_id"]).select("region_id", "vx", "vy")


def _line_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = fixtures.line(spark, sf)
    return c.where("side = 0").drop("side"), c.where("side = 1").drop("side")


@query
def union_region(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.union(*_line_sides(spark, sf), ["region_id"]).select("region_id", "zx", "vx")


@query
def intersection_region(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.intersection(*_line_sides(spark, sf), ["region_id"]).select("region_id", "zx", "vx")


@query
def difference_1d(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.difference(*_line_sides(spark, sf), ["region_id"]).select("region_id", "zx", "vx")


@query
def difference_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of the difference of mixed-zoom regions."""
    a, b = _sides(spark, sf)
    found = algebra.difference(a, b, ["region_id"])
    return algebra.atoms(found, {"x": 9, "y": 8}, ["region_id"]).select("region_id", "vx", "vy")


@query
def semantic_equal(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.cells(spark, sf).drop("side")
    some = c.where("region_id != 'P' or zx < 9")
    return algebra.semantic_equal(c, some, {"x": 9, "y": 8}, ["region_id"])


def _moved(spark: SparkSession, sf: str, boundary: str) -> DataFrame:
    rows = neighbors.neighbors(fixtures.cells(spark, sf), [{"x": 1}, {"x": -1, "y": 2}], boundary)
    return rows.select("region_id", "side", "offset_id", *XY)


@query
def neighbor_reject(spark: SparkSession, sf: str) -> DataFrame:
    return _moved(spark, sf, "reject")


@query
def neighbor_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return _moved(spark, sf, "wrap")


@query
def neighbor_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return _moved(spark, sf, "clamp")


@query
def neighbor_membership(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    found = neighbors.neighbor_membership(a, b, [{"x": 1}, {"y": -1}], by=["region_id"])
    return found.select("region_id", *XY, "offset_id", "member")


@query
def prefix_dilate_1d(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.dilate(fixtures.line(spark, sf), [{"x": 1}, {"x": -1}], by=["region_id"]).select("region_id", "zx", "vx")


GRID_STEPS = [{"x": 1}, {"x": -1}, {"y": 1}, {"y": -1}]
GRID_OUT = ("region_id", "vx", "vy", "vf")


@query
def grid_dilate(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.grid_dilate(fixtures.grid_cells(spark, sf), GRID_STEPS, ["region_id"]).select(*GRID_OUT)


@query
def grid_erode(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.grid_erode(fixtures.grid_cells(spark, sf), GRID_STEPS, ["region_id"]).select(*GRID_OUT)


@query
def grid_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.grid_frontier(fixtures.grid_cells(spark, sf), GRID_STEPS, ["region_id"]).select(*GRID_OUT)


@query
def exposed_faces(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.exposed_faces(fixtures.grid_cells(spark, sf), by=["region_id"]).groupBy("region_id", "offset_id").agg(F.count("*").alias("faces"))


@query
def route_margins(spark: SparkSession, sf: str) -> DataFrame:
    base = fixtures.flight_samples(spark, sf).select(codec.x_tile(F.col("lon"), 20).alias("vx"), codec.y_tile(F.col("lat"), 20).alias("vy")).distinct()
    return neighbors.route_margin(base, 20).distinct()


@query
def merge_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_intervals(fixtures.intervals(spark, sf), ["key"])


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), "|"))


def _few(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.intervals(spark, sf).selectExpr("key % 16 as cell", "event_id % 9 as member", "start_s", "start_s + 120 + (event_id % 11) * 60 as end_s")


@query
def overlap_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(intervals.overlap_segments(_few(spark, sf), ["cell"], "member")).select("cell", "start_s", "end_s", "members", F.col("coverage").cast("long").alias("coverage"))


@query
def attribute_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(intervals.attribute_segments(_few(spark, sf), ["cell"], "member")).select("cell", "start_s", "end_s", "members")


@query
def max_concurrency(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.max_concurrency(fixtures.intervals(spark, sf))


@query
def dyadic_cover(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.dyadic_cover(fixtures.intervals(spark, sf).select("event_id", "start_s", "end_s"))


@query
def h_cover(spark: SparkSession, sf: str) -> DataFrame:
    p = fixtures.points(spark, sf)
    return p.select("point_id", F.explode(airspace.h_layers(F.col("alt") - 10, F.col("alt") + 15, 12)).alias("h12"))


def _reserved(spark: SparkSession, sf: str) -> DataFrame:
    return airspace.reservations(fixtures.flight_samples(spark, sf), F.lit(20.0), F.lit(40.0), START_S, END_S)


@query
def reservation_atoms(spark: SparkSession, sf: str) -> DataFrame:
    return _reserved(spark, sf)


@query
def conformance(spark: SparkSession, sf: str) -> DataFrame:
    samples = fixtures.flight_samples(spark, sf).withColumn("epoch_s", F.col("epoch_s") + F.col("flight_id") * 20)
    samples = samples.withColumn("lon", F.col("lon") + F.when(F.col("epoch_s") % 3 == 0, 0.0008).otherwise(0.0))
    return airspace.conformance(samples, _reserved(spark, sf)).select("flight_id", "epoch_s", "phase", "x21", "y21", "h12", "inside", "violation")


@query
def conformance_counts(spark: SparkSession, sf: str) -> DataFrame:
    samples = fixtures.flight_samples(spark, sf).withColumn("epoch_s", F.col("epoch_s") + F.col("flight_id") * 20)
    counts = airspace.conformance_counts(airspace.conformance(samples, _reserved(spark, sf)))
    return counts.withColumn("inside_ratio", F.round("inside_ratio", 9))


@query
def airspace_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    over = airspace.overlaps(_reserved(spark, sf))
    return over.groupBy("x21", "y21", "h12").agg(F.count("*").alias("segments"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"), F.max("coverage").cast("long").alias("most"))


@query
def scenario_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = airspace.scenario_summary(_reserved(spark, sf))
    return s.select(*[F.col(c).cast("long").alias(c) for c in s.columns])


@query
def asof_sample(spark: SparkSession, sf: str) -> DataFrame:
    samples = fixtures.flight_samples(spark, sf).groupBy("flight_id", "epoch_s").agg(F.max("amsl_m").alias("amsl_m"))
    asked = spark.range(40).selectExpr("id as flight_id", f"explode(sequence({START_S}L - 60L, {END_S}L + 60L, 97L)) as epoch_s")
    found = airspace.sample_at(samples, asked)
    return found.select("flight_id", "epoch_s", F.coalesce("s_epoch_s", F.lit(-1)).alias("s_epoch_s"), F.coalesce("s_amsl_m", F.lit(-1.0)).alias("s_amsl_m"))


@query
def timeslice_coverage(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.range(40).selectExpr("id as flight_id", "cast(20 + id % 2 * 30 as double) as agl_bottom_m", "cast(40 + id % 2 * 30 as double) as agl_top_m")
    sliced = airspace.time_slice(_reserved(spark, sf), bands, START_S + 3600)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)
    return sliced.select("x21", "y21", "agl_bottom_m", "agl_top_m", text("flights"), text("layers"), "coverage")


@query
def timeslice_composed(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.range(40).selectExpr("id as flight_id", "cast(20 + id % 2 * 30 as double) as agl_bottom_m", "cast(40 + id % 2 * 30 as double) as agl_top_m")
    composed = airspace.composed_slice(airspace.time_slice(_reserved(spark, sf), bands, START_S + 3600))
    return composed.select("agl_bottom_m", "agl_top_m", F.array_join(F.transform("flights", lambda x: x.cast("string")), "|").alias("flights"), "zx", "vx", "zy", "vy")


def flights(spark: SparkSession, sf: str) -> DataFrame:
    """A flight for every supplier."""
    o = spark.read.parquet(f"{sf}/supplier.parquet")
    k, place = F.col("s_suppkey"), lambda base, m: F.lit(base) + (F.col("s_suppkey") * m % 40).cast("double") / 2000
    return o.select(
        k.alias("flight_id"), (F.lit(START_S) + k % 34 * 180).cast("long").alias("departure_s"), place(37.45, 7).alias("origin_lat"), place(139.9, 11).alias("origin_lon"),
        (F.lit(180.0) + k % 20).alias("origin_ground_m"), place(37.46, 13).alias("destination_lat"), place(139.91, 17).alias("destination_lon"), (F.lit(190.0) + k % 25).alias("destination_ground_m"),
        F.element_at(F.array(F.lit(30.0), F.lit(50.0), F.lit(100.0)), (k % 3 + 1).cast("int")).alias("target_agl_m"), F.element_at(F.array(F.lit(5.0), F.lit(8.0), F.lit(10.0)), (k % 7 % 3 + 1).cast("int")).alias("cruise_speed_mps"),
    )


@query
def nominal_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    s = airspace.nominal_samples(flights(spark, sf), END_S)
    return s.groupBy("flight_id", "phase").agg(F.count("*").alias("samples"), F.min("epoch_s").alias("first_s"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("amsl_m"), 4).alias("amsl_m"))


@query
def actual_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    s = airspace.actual_samples(flights(spark, sf), END_S)
    sums = [F.sum(c).alias(c) for c in ("along_mm", "cross_mm", "agl_mm")]
    return s.groupBy("flight_id", "phase").agg(F.count("*").alias("samples"), F.min("epoch_s").alias("first_s"), *sums, F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.sum("amsl_m"), 4).alias("amsl_sum_m"), F.round(F.sum("speed_factor"), 7).alias("speed_sum"))


@query
def zoom_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.zoom_histogram(fixtures.cells(spark, sf), ["region_id"]).select("region_id", "zx", "zy", "cells")


@query
def topk_zoom(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.zoom_histogram(fixtures.cells(spark, sf), top=5).select("zx", "zy", "cells")


def _compressed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from tesseral.operators.lineage import cut

    segments = cut(compression.segments_of(_reserved(spark, sf)))
    cells = cut(compression.prefixes_of(segments, (21, 21, 12)))
    normal, merges = compression.normalize_attributes(cells, {"x": 21, "y": 21, "f": 12, "t": 32})
    compression.check_merges(cells, normal, merges)
    return segments, cells, normal


@query
def representation_totals(spark: SparkSession, sf: str) -> DataFrame:
    return compression.representation_totals(*_compressed(spark, sf), (21, 21, 12), 20)


@query
def compression_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """The normal form of the reservation table by attribute."""
    return _compressed(spark, sf)[2].select("attribute", *ZOOMS, *VALUES)


@query
def compression_zooms(spark: SparkSession, sf: str) -> DataFrame:
    return compression.zoom_distribution(_compressed(spark, sf)[2], (21, 21, 12))


@query
def compression_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return compression.cardinalities(*_compressed(spark, sf))


@query
def flight_summary(spark: SparkSession, sf: str) -> DataFrame:
    return compression.flight_summary(_reserved(spark, sf))


@query
def max_inscribed(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.max_inscribed(occupancy.directional_fill(fixtures.shell(spark, sf), by=["region_id"]), (4, 4, 4), ["region_id"])


@query
def min_enclosing(spark: SparkSession, sf: str) -> DataFrame:
    cells = codec.encode(fixtures.points(spark, sf), x="lon", y="lat", f="alt", zooms={"x": 20, "y": 20, "f": 16})
    return algebra.enclosing_cell(cells.withColumn("user", F.col("user_id") % 50), ["user"])


@query
def enclosing_cover(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.enclosing_cover(fixtures.shell_cells(spark, sf), ["region_id"]).select("region_id", "zx", "vx", "zy", "vy", "zf", "vf", "cells")


@query
def directional_fill(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.directional_fill(fixtures.shell(spark, sf), by=["region_id"])


@query
def flood_fill(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.flood_fill(occupancy.close(fixtures.shell(spark, sf), 1, ["region_id"]), ["region_id"])


@query
def closing(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.close(fixtures.shell(spark, sf), 1, ["region_id"])


@query
def boundary_voxels(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.boundary(fixtures.grid(spark, sf), ["region_id"])


@query
def exposed_origin(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.shell(spark, sf)
    closed = occupancy.close(raw, 1, ["region_id"])
    solid = occupancy.directional_fill(closed, by=["region_id"])
    return occupancy.classify_exposed(raw, closed, solid, ["region_id"]).groupBy("region_id", "origin").agg(F.count("*").alias("voxels"))


@query
def cell_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON records of cells, read back."""
    from tesseral.sources.tables import cell_records

    back = cell_records(fixtures.grid_cells(spark, sf).drop("region_id").distinct(), "bitmap")
    schema = "kind string, zx int, vx long, zy int, vy long, zf int, vf long, west double, north double, bottom double"
    back = back.select(F.from_json("value", schema).alias("r")).select("r.*")
    return back.select("kind", "zx", "vx", "zy", "vy", "zf", "vf", *[F.round(c, 6).alias(c) for c in ("west", "north", "bottom")])


@query
def expansion_check(spark: SparkSession, sf: str) -> DataFrame:
    """The normal form of the cells of one side against those of the other."""
    a, b = _line_sides(spark, sf)
    return algebra.expansion_check(algebra.normalize(a, ["region_id"]), b, {"x": 16}, ["region_id"])


@query
def index_update(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _sides(spark, sf)
    grown = algebra.add_cells(a.select("region_id", *CELL), b)
    return algebra.discard_cells(grown, algebra.coarsen(b, {"x": 5, "y": 5}, ["region_id"])).select("region_id", *XY)


@query
def voxel_set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    raw = fixtures.shell(spark, sf)
    closed = occupancy.close(raw, 1, ["region_id"])
    sizes = occupancy.set_sizes(raw, closed, occupancy.directional_fill(closed, by=["region_id"]), ["region_id"])
    return sizes.withColumn("fill_share", F.round("fill_share", 9))


@query
def voxel_downsample(spark: SparkSession, sf: str) -> DataFrame:
    p = fixtures.points(spark, sf).selectExpr("lon * 100 as e", "lat * 100 as n", "alt as u")
    return occupancy.downsample(occupancy.crop(p, {"u": 5.0}, {"e": 13998.0}), 2.0).select(*[F.round(c, 6).alias(c) for c in "enu"])


@query
def thinned_routes(spark: SparkSession, sf: str) -> DataFrame:
    samples = fixtures.flight_samples(spark, sf).groupBy("flight_id", "epoch_s").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    return airspace.thinned_routes(samples, 5).select("flight_id", "epoch_s", "lat", "lon")


@query
def site_cells(spark: SparkSession, sf: str) -> DataFrame:
    sites = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey as site_id", "37.3D + n_nationkey / 50.0D as lat", "139.6D + n_nationkey / 40.0D as lon", "150.0D + n_nationkey as ground_m")
    cells = airspace.cell_bounds_of_sites(sites, (30, 50, 100), (20, 24, 28))
    return cells.select("site_id", "agl_m", "zoom", "id_bits", *[F.round(c, 7).alias(c) for c in ("west", "north", "bottom")])


@query
def normalize_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: what each pass over mixed-zoom regions did."""
    stats: list[dict[str, int]] = []
    algebra.normalize_mixed(fixtures.cells(spark, sf), ["region_id"], stats=stats)
    rows = [(i, r["cells"], r["kept"], sum(v for k, v in r.items() if k.startswith("merged_"))) for i, r in enumerate(stats)]
    return spark.createDataFrame(rows, "pass int, cells long, kept long, merges long")


@query
def index_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """How many of all pairs of the two sides of a region are compatible, by the number of axes in use."""
    a, b = _sides(spark, sf)
    out = None
    for axes in ("x", "xy"):
        side = [s.select("region_id", F.lit(sum({"x": 8, "y": 4}[x] for x in axes)).alias("flags"), *[F.col(k) if k[1] in axes else F.lit(0).cast("int" if k[0] == "z" else "long").alias(k) for k in CELL[1:]]).distinct() for s in (a, b)]
        row = joins.overlap_join(*side, by=["region_id"]).groupBy("region_id").agg(F.count("*").alias("pairs")).select("region_id", F.lit(len(axes)).alias("axes"), "pairs")
        out = row if out is None else out.unionByName(row)
    return out


@query
def symmetric_difference_1d(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.symmetric_difference(*_line_sides(spark, sf), ["region_id"]).select("region_id", "zx", "vx")


@query
def difference_working(spark: SparkSession, sf: str) -> DataFrame:
    """Rows only: a difference that is cut no finer than the working grid; what a subtractor touches there goes."""
    a, b = _sides(spark, sf)
    found = algebra.difference(a, b, ["region_id"], {"x": 7, "y": 6})
    return algebra.atoms(found, {"x": 9, "y": 8}, ["region_id"]).select("region_id", "vx", "vy")


@query
def same_domain(spark: SparkSession, sf: str) -> DataFrame:
    from tesseral.functions.cells import same_domain as same

    return _pairs(spark, sf).select("point_id", same("", "r_").alias("same"))


@query
def castle_bounds(spark: SparkSession, sf: str) -> DataFrame:
    low, high = codec.f_bounds_linear(codec.f_tile_linear(F.col("alt"), 14), 14, 12.5)
    return fixtures.points(spark, sf).select("point_id", F.round(low, 6).alias("low_u"), F.round(high, 6).alias("high_u"))


@query
def height_origins(spark: SparkSession, sf: str) -> DataFrame:
    """The altitude of each site's local zero: given, stored with its data, or the layer edge nearest to altitude 0."""
    sites = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey as site", "cast(4 + s_suppkey % 16 as int) as zoom", "case when s_suppkey % 5 = 0 then s_acctbal end as given", "case when s_suppkey % 3 = 0 then s_suppkey * 0.5D end as stored")
    return sites.select("site", "zoom", F.round(geo.height_origin(F.col("given"), F.col("stored"), codec.F_LOW, codec.F_HIGH, F.col("zoom")), 6).alias("origin_m"))


_ANCHOR = (37.5, 139.95)


def _cloud(spark: SparkSession, sf: str) -> DataFrame:
    """Points in metres east, north and up of the anchor."""
    return fixtures.points(spark, sf).selectExpr("point_id", "region_id", "(lon - 139.95) * 88000 as e", "(lat - 37.5) * 111000 as n", "alt as u")


@query
def cloud_quantize(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.quantize(_cloud(spark, sf), *_ANCHOR, 220.0, 24, 14)


@query
def cloud_wgs84(spark: SparkSession, sf: str) -> DataFrame:
    """Points to degrees, and back to metres."""
    lat, lon = geo.enu_to_wgs84(F.col("e"), F.col("n"), *_ANCHOR)
    there = _cloud(spark, sf).withColumns({"lat": lat, "lon": lon})
    e, n = geo.wgs84_to_enu(F.col("lat"), F.col("lon"), *_ANCHOR)
    return there.select("point_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round(e, 5).alias("e"), F.round(n, 5).alias("n"))


@query
def cloud_rigid(spark: SparkSession, sf: str) -> DataFrame:
    e, n, u = geo.rigid(F.col("e"), F.col("n"), F.col("u"), scale=1.5, yaw_deg=geo.north_alignment_deg(3.0, 4.0), shift=(10.0, -20.0, 5.0))
    return _cloud(spark, sf).select("point_id", F.round(e, 5).alias("e"), F.round(n, 5).alias("n"), F.round(u, 5).alias("u"))


@query
def voxel_centres(spark: SparkSession, sf: str) -> DataFrame:
    """The middles of the distinct voxels of points on a grid of 2.5 m."""
    origin = (-6000.0, -7000.0, -100.0)
    return occupancy.voxel_centers(occupancy.voxelize(_cloud(spark, sf), 2.5, origin), 2.5, origin)


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    p = fixtures.points(spark, sf)
    rows = p.selectExpr("region_id", "point_id", "20 as zx", "19 as zy", "14 as zf").join(p.select("point_id", codec.x_tile(F.col("lon"), 20).alias("ix"), codec.y_tile(F.col("lat"), 19).alias("iy"), codec.f_tile_linear(F.col("alt"), 14).alias("ih")), "point_id")
    from tesseral.functions.cells import as_cells

    cells = as_cells(rows, x=("zx", "ix"), y=("zy", "iy"), f=("zf", "ih"))
    return occupancy.local_bounds(cells, *_ANCHOR, 3.0)


@query
def local_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes(spark, sf).select("point_id", *[F.round(c, 4).alias(c) for c in ("low_e", "high_e", "low_n", "high_n", "low_u", "high_u")])


@query
def largest_boxes(spark: SparkSession, sf: str) -> DataFrame:
    best = occupancy.largest_by_volume(_boxes(spark, sf), ["region_id"])
    return best.select("region_id", F.round("volume", 2).alias("volume"))


@query
def prefix_durations(spark: SparkSession, sf: str) -> DataFrame:
    """The prefixes of an interval's cover last as long as it does."""
    cover = intervals.dyadic_cover(fixtures.intervals(spark, sf).select("event_id", "start_s", "end_s"))
    return cover.groupBy("event_id").agg(F.count("*").alias("prefixes"), F.sum(codec.duration_s(F.col("zt"))).alias("seconds"))


@query
def departures(spark: SparkSession, sf: str) -> DataFrame:
    """A slot and a cruise speed for every supplier's flight."""
    flights = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("flight_id"))
    made = airspace.scheduled(flights, START_S)
    return made.select("flight_id", "departure_s", codec.to_iso(F.col("departure_s")).alias("utc"), codec.to_iso_jst(F.col("departure_s")).alias("jst"), "cruise_speed_mps")


@query
def route_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """An origin for every supplier, and a destination that is another nation."""
    from tesseral.sources import generators

    sites = spark.read.parquet(f"{sf}/nation.parquet").count()
    return generators.route_pairs(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("flight_id")), sites)


@query
def coverage_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """How many flights hold the cell of each sample at its time."""
    at = airspace.query_atom(F.col("lon"), F.col("lat"), F.col("amsl_m"))
    atoms = fixtures.flight_samples(spark, sf).select(*[c.alias(k) for k, c in at.items()], "epoch_s").distinct()
    return airspace.coverage_at(atoms, airspace.overlaps(_reserved(spark, sf))).select("x21", "y21", "h12", "epoch_s", F.col("coverage").cast("long").alias("coverage"))


@query
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    samples = fixtures.flight_samples(spark, sf).groupBy("flight_id", "epoch_s").agg(F.max("phase").alias("phase"), F.max("lat").alias("lat"), F.max("lon").alias("lon"), F.max("amsl_m").alias("amsl_m"))
    return airspace.status_at(airspace.conformance(samples, _reserved(spark, sf)), START_S + 3600)


@query
def coarsening(spark: SparkSession, sf: str) -> DataFrame:
    return compression.coarsening_counts(_compressed(spark, sf)[2], (21, 21, 12))


@query
def attribute_examples(spark: SparkSession, sf: str) -> DataFrame:
    found = compression.example_prefixes(_compressed(spark, sf)[2])
    return found.select("cardinality", "attribute", "example", *ZOOMS, *VALUES)


@query
def canonical_order(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.canonical_rank(fixtures.cells(spark, sf), ["region_id", "side"]).select("region_id", "side", *XY, "rank")


@query
def generated_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's shapes with a cell for each customer of a nation: how many cells they have before and after normalising."""
    from tesseral.operators.regions import normalize_counters
    from tesseral.operators.scans import ranked
    from tesseral.sources import generators

    customers = ranked(spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"])
    made = generators.shapes(customers.select(F.col("c_nationkey").alias("region"), (F.col("rank") - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("n")))
    return normalize_counters(made, ["region", "shape"]).select("region", "shape", "cells", "normal")
