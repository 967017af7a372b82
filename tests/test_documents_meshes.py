import gzip
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tesseral.plans import extended, scenario
from tesseral.plans.fixtures import END_S, START_S
from tesseral.plans.queries import flights
from tesseral.sources import obj, tables
from tesseral.sources.document import between, closing, list_name, opening, read_document, write_document

SF = "/root/testdata/sf0.001"


def leaves_of(value, path=()):
    """The leaves of a JSON value, in order, as (path, text)."""
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves_of(v, (*path, k))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves_of(v, (*path, f"[{i}"))]
    return [(path, json.dumps(value))]


def random_value(rnd, depth):
    kind = rnd.random()
    if depth == 0 or kind < 0.3:
        return rnd.choice([1, "a,]}\"b", None, True, 2.5, "ü"])
    if kind < 0.65:
        return [random_value(rnd, depth - 1) for _ in range(rnd.randint(1, 4))]
    return {f"k{i}": random_value(rnd, depth - 1) for i in range(rnd.randint(1, 4))}


def test_text_between_leaves():
    rnd = random.Random(4)
    for _ in range(200):
        doc = {f"m{i}": random_value(rnd, 4) for i in range(rnd.randint(1, 4))}
        leaves = leaves_of(doc)
        text = "{" + opening(leaves[0][0]) + leaves[0][1]
        for (before, _), (after, value) in zip(leaves, leaves[1:], strict=False):
            text += between(before, after) + value
        assert json.loads(text + closing(leaves[-1][0]) + "}") == doc


def test_document_of_many_tasks(spark, tmp_path):
    rnd = random.Random(8)
    doc = {"head": {"a": 1, "b": [1, 2]}, "items": [{"id": i, "rows": [rnd.randrange(99) for _ in range(rnd.randint(1, 9))]} for i in range(120)], "tail": {"x": "y"}}
    leaves = [(list(p), v, i) for i, (p, v) in enumerate(leaves_of(doc))]
    df = spark.createDataFrame(leaves, "path array<string>, value string, n int").repartition(5)
    path = f"file://{tmp_path}/folder/doc.json"
    for _ in range(2):  # a second run replaces the first
        write_document(df, path, ["n"], totals="totals")
    got = json.loads((tmp_path / "folder" / "doc.json").read_text())
    totals = got.pop("totals")
    assert got == doc and totals["items.rows"] == sum(len(x["rows"]) for x in doc["items"]) and totals["items.id"] == 120
    assert sorted(p.name for p in (tmp_path / "folder").iterdir() if not p.name.startswith(".")) == ["doc.json"]


def test_members_put_in_at_once_and_empty_documents(spark, tmp_path):
    rows = [(["a", "*"], '{"x": 1, "y": [2]}', 0), (["a", "z"], "3", 1), (["b", "*"], "{}", 2), (["c"], "null", 3)]
    df = spark.createDataFrame(rows, "path array<string>, value string, n int")
    write_document(df, f"file://{tmp_path}/a.json", ["n"])
    assert json.loads((tmp_path / "a.json").read_text()) == {"a": {"x": 1, "y": [2], "z": 3}, "c": None}
    write_document(df.limit(0), f"file://{tmp_path}/b.json", ["n"], totals="t")
    assert json.loads((tmp_path / "b.json").read_text()) == {"t": {}}
    assert list_name(["a", "[1", "b", "*"]) == "a.b"


def test_a_failed_document_leaves_nothing(spark, tmp_path):
    df = spark.range(100).select(F.array(F.lit("r"), F.concat(F.lit("["), F.col("id").cast("string"))).alias("path"), F.when(F.col("id") != 57, F.col("id").cast("string")).alias("value"), F.col("id").alias("n"))
    with pytest.raises(Exception, match="NoneType|Python"):
        write_document(df, f"file://{tmp_path}/c.json", ["n"])
    assert [p for p in tmp_path.iterdir() if p.suffix == ".json"] == []


def test_scenario_document(spark, tmp_path):
    made = scenario.plan_scenario(flights(spark, SF), START_S, END_S)
    path = f"file://{tmp_path}/s.json"
    scenario.write_scenario_document(made, path)
    doc = json.loads((tmp_path / "s.json").read_text())
    assert list(doc) == ["metadata", "summary", "flights", "overlap_segments", "totals"]
    back = tables.read_scenario(spark, path)
    held = {(str(r["flight_id"]), r["x21"], r["y21"], r["h12"], r["start_s"], r["end_s"]) for r in made.reserved.collect()}
    assert {(r["flight_id"], r["x21"], r["y21"], r["h12"], r["start_s"], r["end_s"]) for r in back.collect()} == held
    nominal = {r["flight_id"]: r["n"] for r in made.nominal.groupBy("flight_id").agg(F.count("*").alias("n")).collect()}
    assert {int(f["flight_id"]): len(f["nominal_trajectory"]) for f in doc["flights"]} == nominal
    assert [int(f["flight_id"]) for f in doc["flights"]] == sorted(nominal)
    assert doc["totals"]["flights.nominal_trajectory"] == sum(nominal.values())
    assert len(doc["overlap_segments"]) == made.overlaps.count() == doc["summary"]["overlap_segments"]
    assert all(f["conformance"]["applicable"] == f["conformance"]["inside"] + f["conformance"]["outside"] for f in doc["flights"])


def test_compressed_document_is_read_by_blocks(spark, tmp_path):
    doc = {"head": {"a": 1, "b": [1, 2]}, "items": [{"id": i, "rows": list(range(i % 7))} for i in range(300)], "tail": [{"x": i} for i in range(90)]}
    leaves = [(list(p), v, n, int(p[1].strip("[")) if p[0] != "head" else 0, i) for i, (p, v) in enumerate(leaves_of(doc)) for n in [list(doc).index(p[0])]]
    df = spark.createDataFrame(leaves, "path array<string>, value string, section int, element int, n int").repartition(5)
    path = f"file://{tmp_path}/d.json.gz"
    for _ in range(2):  # a second run replaces the first and its index
        write_document(df, path, ["n"], totals="t", ranges=["section", "element"], block=400)
        with gzip.open(tmp_path / "d.json.gz") as f:
            got = json.load(f)
        assert {k: got[k] for k in doc} == doc and list(got) == [*doc, "t"]
    items = read_document(spark, path, "items array<struct<id:int,rows:array<int>>>, tail array<struct<x:int>>").collect()
    assert len([r for r in items if r["items"]]) > 8 and len([r for r in items if r["tail"]]) > 1
    assert sorted((i["id"], i["rows"]) for r in items for i in r["items"] or []) == [(i["id"], i["rows"]) for i in doc["items"]]
    assert sorted(i["x"] for r in items for i in r["tail"] or []) == list(range(90))
    assert [r["head"].asDict() for r in read_document(spark, path, "head struct<a:int,b:array<int>>").collect()] == [doc["head"]]
    with gzip.open(tmp_path / "d.json.gz", "w") as f:  # written by another: no index holds
        f.write(b'{"items": [{"id": 7}]}')
    assert [r["items"][0]["id"] for r in read_document(spark, path, "items array<struct<id:int>>").collect()] == [7]


def test_elements_that_tasks_share_are_read_as_a_whole(spark, tmp_path):
    df = spark.range(1, 400).selectExpr("array('items', concat('[', id div 50), concat('m', id)) as path", "cast(id as string) as value", "id as n")
    path = f"file://{tmp_path}/e.json"
    write_document(df, path, ["n"], block=50)
    rows = read_document(spark, path, "items array<map<string,int>>").collect()
    assert len(rows) == 1 and {k: v for i in rows[0]["items"] for k, v in i.items()} == {f"m{i}": i for i in range(1, 400)}


def spoiled(folder, name, keep):
    """The document with all blocks but those of one member made unreadable."""
    where = [json.loads(line) for line in (folder / f".{name}.index" / "blocks.json").read_text().splitlines()[:-1]]
    data = bytearray((folder / name).read_bytes())
    for b in where:
        if b["member"] != keep:
            data[b["at"] : b["at"] + b["length"]] = bytes(b["length"])
    (folder / name).write_bytes(data)
    return sum(b["member"] == keep for b in where)


def small_document(spark, folder):
    """A document of the scenario's members, of 60 flights; its path."""
    flights = [(["flights", f"[{i}", "*"], json.dumps({"flight_id": str(i), "speed_class": "slow", "nominal_trajectory": [{"epoch_s": t} for t in range(i)], "conformance": {"inside": i}}), 1, i) for i in range(60)]
    rows = [(["summary", "*"], '{"flights": 60, "atoms": 8}', 0, 0), *flights, *[(["overlap_segments", f"[{i}"], json.dumps({"coverage": 2 + i, "flight_ids": ["1", "2"]}), 2, i) for i in range(40)]]
    df = spark.createDataFrame(rows, "path array<string>, value string, section int, element int")
    write_document(df, f"file://{folder}/m.json.gz", ["section", "element"], totals="totals", block=300)
    return f"file://{folder}/m.json.gz"


def test_flights_of_a_document_are_read_by_many_tasks_and_nothing_else(spark, tmp_path):
    path = small_document(spark, tmp_path)
    assert spoiled(tmp_path, "m.json.gz", "flights") > 16
    read = scenario.read_flights(spark, path)
    assert {r["flight_id"]: (r["nominal_samples"], r["actual_samples"], r["inside"]) for r in read.collect()} == {str(i): (i, 0, i) for i in range(60)}
    assert read.rdd.getNumPartitions() > 2


def test_summary_of_a_document_is_read_alone(spark, tmp_path):
    path = small_document(spark, tmp_path)
    assert spoiled(tmp_path, "m.json.gz", "summary") == 1
    assert [tuple(r) for r in scenario.read_summary(spark, path, "flights bigint, atoms bigint").collect()] == [(60, 8)]


def test_overlaps_of_a_document_are_read_alone(spark, tmp_path):
    path = small_document(spark, tmp_path)
    assert spoiled(tmp_path, "m.json.gz", "overlap_segments") > 3
    assert sorted(r["coverage"] for r in scenario.read_overlaps(spark, path).collect()) == list(range(2, 42))


def test_scenario_of_flights_without_reservations(spark, tmp_path):
    """A flight that never cruises holds nothing, and its document can be read all the same."""
    some = flights(spark, SF)
    still = some.where("flight_id = 1").withColumns({"flight_id": F.lit(900).cast("long"), "destination_lat": F.col("origin_lat"), "destination_lon": F.col("origin_lon")})
    late = some.where("flight_id = 2").withColumns({"flight_id": F.lit(901).cast("long"), "departure_s": F.lit(END_S + 60).cast("long")})
    made = scenario.plan_scenario(some.unionByName(still).unionByName(late), START_S, END_S)
    path = f"file://{tmp_path}/r.json"
    scenario.write_scenario_document(made, path)
    doc = {f["flight_id"]: f for f in json.loads((tmp_path / "r.json").read_text())["flights"]}
    assert doc["900"]["reservation"]["dynamic_atoms"] == doc["901"]["reservation"]["dynamic_atoms"] == doc["901"]["nominal_trajectory"] == doc["901"]["actual_trajectory"] == []
    assert tables.read_scenario(spark, path).count() == made.reserved.count()
    assert json.loads((tmp_path / "r.json").read_text())["totals"]["flights.reservation.dynamic_atoms"] == sum(len(f["reservation"]["dynamic_atoms"]) for f in doc.values())
    read = {r["flight_id"]: r for r in scenario.read_flights(spark, path).collect()}
    assert read["901"]["nominal_samples"] == 0 and read["900"]["dynamic_atom_count"] == 0


def test_scenario_without_flights(spark, tmp_path):
    none = scenario.plan_scenario(flights(spark, SF).limit(0), START_S, END_S)
    scenario.write_scenario_document(none, f"file://{tmp_path}/n.json")
    doc = json.loads((tmp_path / "n.json").read_text())
    assert "flights" not in doc and doc["summary"]["flights"] == 0 and doc["summary"]["applicable"] == 0


OBJ = """# a comment
v 0 0 0
v 1 0 0
o first one
v 1 1 0.5 1.0
v 0 1 0
vn 0 0 1
f 1 2 3 4
g second
v 5 5 5
f -1 1/2/3 2//1
f 5 4 -2

f 1 2 3"""


@pytest.mark.parametrize("size", [1, 7, 16, 40, 10_000])
def test_mesh_by_ranges(spark, tmp_path, size):
    (tmp_path / "m.obj").write_text(OBJ)
    mesh = obj.read_mesh(spark, f"file://{tmp_path}/m.obj", size)
    points = {r["number"]: (r["x"], r["y"], r["z"]) for r in mesh.vertices.collect()}
    assert points == {1: (0, 0, 0), 2: (1, 0, 0), 3: (1, 1, 0.5), 4: (0, 1, 0), 5: (5, 5, 5)}
    faces = {r["face"]: (r["object"], r["corners"]) for r in mesh.faces.collect()}
    assert faces == {0: ("first one", [1, 2, 3, 4]), 1: ("second", [5, 1, 2]), 2: ("second", [5, 4, 4]), 3: ("second", [1, 2, 3])}
    got = {(r["face"], r["part"]): tuple(r[n + c] for n in "abc" for c in "xyz") for r in obj.triangles(mesh).collect()}
    corners = {(0, 0): (1, 2, 3), (0, 1): (1, 3, 4), (1, 0): (5, 1, 2), (2, 0): (5, 4, 4), (3, 0): (1, 2, 3)}
    assert got == {k: tuple(x for n in v for x in points[n]) for k, v in corners.items()}


def test_meshes_of_a_folder_are_numbered_for_themselves(spark, tmp_path):
    rnd = random.Random(2)
    want = {}
    for name in ("a.obj", "b.obj"):
        points = [tuple(round(rnd.uniform(-9, 9), 3) for _ in "xyz") for _ in range(300)]
        faces = [tuple(rnd.randrange(1, 301) for _ in "abc") for _ in range(400)]
        (tmp_path / name).write_text("".join(f"v {x} {y} {z}\n" for x, y, z in points) + "".join(f"f {a} {b} {c}\r\n" for a, b, c in faces))
        want |= {(name, i): tuple(x for n in f for x in points[n - 1]) for i, f in enumerate(faces)}
    rows = obj.triangles(obj.read_mesh(spark, f"file://{tmp_path}", 1500)).collect()
    assert {(r["file"].rpartition("/")[2], r["face"]): tuple(r[n + c] for n in "abc" for c in "xyz") for r in rows} == want


def test_tasks_of_a_mesh_grow_with_its_files(spark, tmp_path):
    (tmp_path / "t.obj").write_text("".join(f"v {i} 0 0\nv 0 {i} 0\nv 0 0 {i}\nf -3 -2 -1\n" for i in range(400)))
    tasks = [obj.triangles(obj.read_mesh(spark, f"file://{tmp_path}/t.obj", size)).rdd.getNumPartitions() for size in (100_000, 1000, 500)]
    assert tasks[1] >= 8 * tasks[0] and tasks[2] >= 1.9 * tasks[1]


def test_mesh_odd_files(spark, tmp_path):
    (tmp_path / "e.obj").write_text("")
    assert obj.triangles(obj.read_mesh(spark, f"file://{tmp_path}/e.obj")).count() == 0
    (tmp_path / "f.obj").write_text("v 0 0 0\nf 1 1 7\n")
    with pytest.raises(Exception, match="not there"):
        obj.triangles(obj.read_mesh(spark, f"file://{tmp_path}/f.obj")).collect()
    (tmp_path / "g.obj").write_text("v 0 0 0\nf 1 1\n")
    with pytest.raises(Exception, match="less than three"):
        obj.triangles(obj.read_mesh(spark, f"file://{tmp_path}/g.obj")).collect()
    (tmp_path / "h.obj").write_text("v 1 0 2\n")
    turned = obj.transformed(obj.read_mesh(spark, f"file://{tmp_path}/h.obj"), 2.0, 90).vertices.first()
    assert math.isclose(turned["y"], 2) and abs(turned["x"]) < 1e-12 and turned["z"] == 4


def test_queries_have_sql():
    assert set(extended.QUERIES) == set(extended.ORACLE_SQL)
