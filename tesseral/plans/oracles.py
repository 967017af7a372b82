"""DuckDB SQL for the queries of the catalogue, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from tesseral.plans.fixtures import CTE, END_S, START_S

AX = ("x", "y", "f", "t")


def _with(fixture: str, *steps: str) -> str:
    return "with " + ",\n".join([CTE[fixture], *steps]) + "\n"


def x_tile(lon: str, z: int) -> str:
    r = f"(({lon} + 180e0) % 360e0)"
    wrapped = f"({r} + case when {r} < 0 then 360e0 else 0e0 end + (-180e0))"
    return f"least(trunc(({wrapped} + 180e0) / 360e0 * {1 << z})::bigint, {(1 << z) - 1})"


def y_tile(lat: str, z: int) -> str:
    a = f"radians(greatest(-85.05112877980659e0, least(85.05112877980659e0, {lat})))"
    return f"least(greatest(trunc((1e0 - ln(tan({a}) + 1e0/cos({a}))/pi())/2e0 * {1 << z})::bigint, 0), {(1 << z) - 1})"


def f_tile(h: str, z: int) -> str:
    return f"(trunc(({h} + 16383e0) / 32767e0 * 4294967295e0)::bigint >> {32 - z})"


def t_tile(t: str, z: int) -> str:
    return f"({t} >> {32 - z})"


def f_linear(h: str, z: int) -> str:
    return f"least(greatest(floor(({h} + 16383e0) / 32767e0 * {1 << z})::bigint, 0), {(1 << z) - 1})"


def bits(v: str, z: int | str) -> str:
    return f"lpad(bin({v}), {z}, '0')"


def id_bits(axes: dict[str, tuple[str, int]]) -> str:
    flags = sum({"x": 8, "y": 4, "f": 2, "t": 1}[a] for a in axes)
    return " || ".join([f"'{flags:04b}'", *[f"'{z - 1:05b}'" for _, z in axes.values()], *[bits(v, z) for v, z in axes.values()]])


def point_axes(x: int = 0, y: int = 0, f: int = 0, t: int = 0) -> dict[str, tuple[str, int]]:
    made = {"x": (x_tile, "lon", x), "y": (y_tile, "lat", y), "f": (f_tile, "alt", f), "t": (t_tile, "t", t)}
    return {a: (fn(c, z), z) for a, (fn, c, z) in made.items() if z}


def closed(name: str, source: str, keys: str, v: str, zoom: int, out: tuple[str, str]) -> str:
    """CTEs that merge values of one zoom within keys: the full blocks of which no larger full block is the parent."""
    return f"""{name}_full as (select {keys}, z, b from (
        select {keys}, g.z as z, {v} >> ({zoom} - g.z) as b, count(*) as n from (select distinct {keys}, {v} from {source}) s, generate_series(1, {zoom}) as g(z) group by all
      ) q where n = 1::bigint << ({zoom} - z)::int),
    {name} as (select {", ".join(f"f.{k.strip()}" for k in keys.split(","))}, f.z::int as {out[0]}, f.b as {out[1]} from {name}_full f where f.z = 1 or not exists (
        select 1 from {name}_full p where p.z = f.z - 1 and p.b = f.b >> 1 and {" and ".join(f"p.{k.strip()} is not distinct from f.{k.strip()}" for k in keys.split(","))}))"""


def covers(a: str, b: str) -> str:
    return " and ".join(f"{a}.z{x} <= {b}.z{x} and {a}.v{x} = {b}.v{x} >> greatest({b}.z{x} - {a}.z{x}, 0)" for x in "xy")


def overlaps(a: str, b: str) -> str:
    return " and ".join(f"{a}.v{x} >> ({a}.z{x} - least({a}.z{x}, {b}.z{x})) = {b}.v{x} >> ({b}.z{x} - least({a}.z{x}, {b}.z{x}))" for x in "xy")


def expanded(source: str, where: str = "true", zx: int = 9, zy: int = 8) -> str:
    return f"""(select distinct region_id, (vx << ({zx} - zx)) + i.i as vx, (vy << ({zy} - zy)) + j.j as vy from {source},
      lateral (select unnest(range(0, 1::bigint << ({zx} - zx)))) as i(i), lateral (select unnest(range(0, 1::bigint << ({zy} - zy)))) as j(j) where {where})"""


SIDES = "a as (select region_id, zx, vx, zy, vy from cells where side = 0), b as (select region_id, zx, vx, zy, vy from cells where side = 1)"
C = "c as (select distinct region_id, zx, vx, zy, vy from cells)"

ORACLE_SQL: dict[str, str] = {}
O = ORACLE_SQL  # noqa: E741

O["tiles"] = _with("points") + f"""select point_id, {x_tile("lon", 10)} as x10, {x_tile("(lon * 7 - 1000)", 24)} as x24, {y_tile("lat", 10)} as y10, {y_tile("(lat * 2 - 40)", 20)} as y20,
  {f_tile("alt", 6)} as f6, {f_tile("alt", 12)} as f12, {f_linear("alt", 14)} as l14, {t_tile("t", 16)} as t16 from points"""
_e = point_axes(10, 10, 5, 20)
O["encode_bits"] = _with("points") + f"select point_id, {id_bits(_e)} as id_bits, {4 + sum(5 + z for _, z in _e.values())}::bigint as bit_len from points"
O["encode_bits_no_x"] = _with("points", f"e as (select point_id, {id_bits(point_axes(y=12, f=9, t=21))} as id_bits from points)") + "select *, ltrim(id_bits, '0') as as_integer from e"
O["decode_cells"] = _with("points", "e as (select point_id, " + ", ".join(f"{v} as v{a}" for a, (v, _) in _e.items()) + " from points)") + """
select point_id, round(-180e0 + vx * (360e0 / 1024), 8) as x, round(degrees(atan(sinh(pi() * (1e0 - 2e0 * vy / 1024)))), 8) as y,
  round(-16383e0 + vf / 31e0 * 32767e0, 8) as f, vt << 12 as t from e"""
O["id_separate"] = _with("points") + "select point_id, concat_ws('/', '1', '1', '1', '1', " + ", ".join([f"'{z - 1:05b}'" for _, z in _e.values()] + [bits(v, z) for v, z in _e.values()]) + ") as readable from points"
_b = point_axes(7, 9, 5, 13)
_n = 4 + sum(5 + z for _, z in _b.values())
_pad = -_n % 8
O["bytes_round_trip"] = _with("points", f"e as (select point_id, {id_bits(_b)} as id_bits from points)") + f"""
select point_id, list_reduce(list_transform(range(0, {(_n + _pad) // 4}), lambda i: substr('0123456789ABCDEF', 1 + 8*(substr(d, 4*i+1, 1)::int) + 4*(substr(d, 4*i+2, 1)::int) + 2*(substr(d, 4*i+3, 1)::int) + (substr(d, 4*i+4, 1)::int), 1)), lambda p, q: p || q) as id_hex, id_bits
from (select *, id_bits || repeat('0', {_pad}) as d from e)"""
O["iso_time"] = _with("points") + "select point_id, strftime(to_timestamp(t) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as iso, t from points"
O["tile_bounds"] = _with("points", "e as (select point_id, " + ", ".join(f"{v} as v{a}" for a, (v, _) in _e.items()) + " from points)") + """
select point_id, round(-180e0 + vx * (360e0/1024), 8) as west, round(-180e0 + (vx+1) * (360e0/1024), 8) as east,
  round(degrees(atan(sinh(pi() * (1e0 - 2e0 * (vy+1) / 1024)))), 8) as south, round(degrees(atan(sinh(pi() * (1e0 - 2e0 * vy / 1024)))), 8) as north,
  round(-16383e0 + (vf << 27) / 4294967295e0 * 32767e0, 8) as bottom, round(least(-16383e0 + ((vf+1) << 27) / 4294967295e0 * 32767e0, 16384e0), 8) as top from e"""

_L, _R = point_axes(20, 18, 16, 12), point_axes(14, 21, 20, 10)
_PAIRS = _with("points", "l as (select point_id, point_id % 3 <> 0 as onx, true as ony, true as onf, true as ont, " + ", ".join(f"{v} as v{a}, {z} as z{a}" for a, (v, z) in _L.items()) + " from points)",
  "r as (select point_id, true as onx, true as ony, true as onf, point_id % 5 <> 0 as ont, " + ", ".join(f"{v} as v{a}, {z} as z{a}" for a, (v, z) in _R.items()) + " from points)",
  "p as (select l.point_id, " + ", ".join(f"l.on{a} as l_on{a}, r.on{a} as r_on{a}, l.on{a} and r.on{a} as on{a}, least(l.z{a}, r.z{a}) as q{a}, l.v{a} >> (l.z{a} - least(l.z{a}, r.z{a})) as p{a}, r.v{a} >> (r.z{a} - least(l.z{a}, r.z{a})) as r{a}" for a in AX) + " from l join r on r.point_id = l.point_id + 1)")
O["match_pairs"] = _PAIRS + "select point_id, " + " and ".join(f"(not on{a} or p{a} = r{a})" for a in AX) + " as overlap from p"
O["common_prefixes"] = (_PAIRS.rstrip() + ",\nn as (select *, " + ", ".join(f"case when on{a} then q{a} - case when p{a} = r{a} then 0 else length(bin(xor(p{a}, r{a}))) end else 0 end as n{a}" for a in AX) + " from p)\n"
  + "select point_id, (" + " + ".join(f"case when n{a} > 0 then {w} else 0 end" for a, w in zip(AX, (8, 4, 2, 1), strict=True)) + ")::int as flags, "
  + ", ".join(f"n{a}::int as z{a}, case when n{a} > 0 then p{a} >> (q{a} - n{a}) else 0 end::bigint as v{a}" for a in AX) + " from n")
O["shared_cells"] = _with("points", f"e as (select distinct region_id, {id_bits(point_axes(8, 8, 6, 16))} as id_bits from points)") + "select id_bits, count(*) as regions from e group by 1 having count(*) >= 2"
O["haversine_bearing"] = _with("points", "s as (select *, radians(37.5e0) as p2, radians(139.93e0 - lon) as dl, radians(37.5e0 - lat) as dp, 1000e0/6378137e0 as d, radians(alt) as b from points)",
  "u as (select *, asin(sin(radians(lat))*cos(d) + cos(radians(lat))*sin(d)*cos(b)) as q, degrees(atan2(sin(dl)*cos(p2), cos(radians(lat))*sin(p2) - sin(radians(lat))*cos(p2)*cos(dl))) as brg from s)") + """
select point_id, round(2e0*6378137e0*asin(sqrt(pow(sin(dp/2), 2) + cos(radians(lat))*cos(p2)*pow(sin(dl/2), 2))), 4) as metres, round(case when brg < 0 then brg + 360 else brg end, 6) as bearing,
  round(degrees(q), 8) as to_lat, round((degrees(radians(lon) + atan2(sin(b)*sin(d)*cos(radians(lat)), cos(d) - sin(radians(lat))*sin(q))) + 540e0) % 360e0 - 180e0, 8) as to_lon from u"""  # fmt: skip

_ca = ", ".join(f"a.{c} as c_{c}" for c in ("zx", "zy", "vx", "vy"))
O["subsumes_join"] = _with("cells", SIDES) + f"select a.region_id, {_ca}, count(*) as inside from a join b on a.region_id = b.region_id and {covers('a', 'b')} group by all"
O["descendants_join"] = _with("cells", SIDES) + f"select a.region_id, a.zx, a.zy, a.vx, a.vy, count(*) as containers from a join b on a.region_id = b.region_id and {covers('b', 'a')} group by all"
O["compatible_join"] = _with("cells", SIDES) + f"select a.region_id, a.zx, a.zy, a.vx, a.vy, count(*) as partners, sum(b.vx)::bigint as sum_vx from a join b on a.region_id = b.region_id and {overlaps('a', 'b')} group by all"
O["compatible_pair_count"] = _with("cells", SIDES) + f"select count(*) as pairs from a join b on {overlaps('a', 'b')}"
O["contains_semi"] = _with("cells", SIDES) + f"select * from b where exists (select 1 from a where a.region_id = b.region_id and {covers('a', 'b')})"
O["uncovered_anti"] = _with("cells", SIDES) + f"select * from b where not exists (select 1 from a where a.region_id = b.region_id and {covers('a', 'b')})"
O["meet_cells"] = _with("cells", SIDES) + "select distinct a.region_id, " + ", ".join(f"greatest(a.z{x}, b.z{x}) as z{x}, case when b.z{x} > a.z{x} then b.v{x} else a.v{x} end as v{x}" for x in "xy") + f" from a join b on a.region_id = b.region_id and {overlaps('a', 'b')}"
O["refine_children"] = _with("cells") + "select region_id, side, (zx + 2)::int as zx, (zy + 1)::int as zy, vx * 4 + i as vx, vy * 2 + j as vy from cells, range(0, 4) t(i), range(0, 2) u(j)"
O["coarsen_distinct"] = _with("cells") + "select distinct region_id, 2::int as zx, 2::int as zy, vx >> (zx - 2) as vx, vy >> (zy - 2) as vy from cells"
O["expand_atoms"] = _with("cells") + f"select * from {expanded('cells')}"
for _name, _op in (("atoms_union", "union"), ("atoms_intersection", "intersect"), ("atoms_difference", "except")):
    O[_name] = _with("cells", SIDES) + f"select * from {expanded('a')} {_op} select * from {expanded('b')}"
O["remove_subsumed"] = _with("cells", C) + f"select * from c where not exists (select 1 from c d where d.region_id = c.region_id and (d.zx <> c.zx or d.zy <> c.zy) and {covers('d', 'c')})"
O["normalize_1d_uniform"] = _with("line", closed("n", "line", "region_id", "ix", 16, ("zx", "vx"))) + "select * from n"


def _three(source: str, key: str) -> str:
    return ",\n".join((closed("nx", source, f"{key}, iy, ih", "ix", 5, ("zx", "vx")), closed("ny", "nx", f"{key}, zx, vx, ih", "iy", 5, ("zy", "vy")), closed("nf", "ny", f"{key}, zx, vx, zy, vy", "ih", 2, ("zf", "vf"))))


O["normalize_3d_uniform"] = _with("grid", _three("grid", "region_id")) + "select region_id, zx, vx, zy, vy, zf, vf from nf"
O["normalize_attributes"] = _with("grid", "m as (select ix, iy, ih, string_agg(region_id, '|' order by region_id) as attribute from grid group by ix, iy, ih)", _three("m", "attribute")) + "select attribute, zx, vx, zy, vy, zf, vf from nf"
O["normalize_mixed"] = _with("cells") + f"select * from {expanded('cells')}"
_ab = "a as (select region_id, ix from line where side = 0), b as (select region_id, ix from line where side = 1)"
for _name, _op in (("union_region", "union"), ("intersection_region", "intersect"), ("difference_1d", "except")):
    O[_name] = _with("line", _ab, f"s as (select * from a {_op} select * from b)", closed("n", "s", "region_id", "ix", 16, ("zx", "vx"))) + "select * from n"
O["difference_2d"] = _with("cells", SIDES) + f"select * from {expanded('a')} except select * from {expanded('b')}"
_part = "region_id <> 'P' or zx < 9"
O["semantic_equal"] = _with("cells", f"p as (select * from {expanded('cells')})", f"q as (select * from {expanded('cells', _part)})") + """
select region_id, (select count(*) from p x where x.region_id = r.region_id) = (select count(*) from q x where x.region_id = r.region_id) as equal from (select distinct region_id from p) r"""


def _moves(test: str, x: str, y: str) -> str:
    return _with("cells", "o as (select * from (values (0, 1, 0), (1, -1, 2)) t(offset_id, dx, dy))") + f"select region_id, side, offset_id::int as offset_id, zx, zy, {x} as vx, {y} as vy from cells, o where {test}"


_nx, _ny = "(1::bigint << zx)", "(1::bigint << zy)"
O["neighbor_reject"] = _moves(f"vx + dx between 0 and {_nx} - 1 and vy + dy between 0 and {_ny} - 1", "vx + dx", "vy + dy")
O["neighbor_wrap"] = _moves("true", f"(vx + dx + {_nx}) % {_nx}", f"(vy + dy + {_ny}) % {_ny}")
O["neighbor_clamp"] = _moves("true", f"greatest(0, least(vx + dx, {_nx} - 1))", f"greatest(0, least(vy + dy, {_ny} - 1))")
O["neighbor_membership"] = _with("cells", SIDES, "o as (select * from (values (0, 1, 0), (1, 0, -1)) t(offset_id, dx, dy))", "m as (select b.*, offset_id, b.vx + dx as mx, b.vy + dy as my from b, o)") + """
select region_id, zx, zy, vx, vy, offset_id::int as offset_id, mx between 0 and (1::bigint << zx) - 1 and my between 0 and (1::bigint << zy) - 1 and exists (
  select 1 from a where a.region_id = m.region_id and a.zx <= m.zx and a.zy <= m.zy and a.vx = m.mx >> greatest(m.zx - a.zx, 0) and a.vy = m.my >> greatest(m.zy - a.zy, 0)) as member from m"""
O["prefix_dilate_1d"] = _with("line", "s as (select distinct region_id, ix from line)", closed("n", "s", "region_id", "ix", 16, ("zx", "vx")),
  "w as (select region_id, zx, vx + d as vx from n, (values (-1), (0), (1)) t(d) where vx + d between 0 and (1::bigint << zx) - 1)",
  "u as (select distinct region_id, (vx << (16 - zx)) + i as ix from w, lateral (select unnest(range(0, 1::bigint << (16 - zx)))) as g(i))", closed("m", "u", "region_id", "ix", 16, ("zx", "vx"))) + "select * from m"
_steps = "d as (select * from (values (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy))"
O["grid_dilate"] = _with("grid", _steps) + "select region_id, ix as vx, iy as vy, ih as vf from grid union select region_id, ix + dx, iy + dy, ih from grid, d where ix + dx between 0 and 31 and iy + dy between 0 and 31"
O["grid_erode"] = _with("grid", _steps) + "select g.region_id, g.ix as vx, g.iy as vy, g.ih as vf from grid g join d on true join grid h on h.region_id = g.region_id and h.ih = g.ih and h.ix = g.ix + dx and h.iy = g.iy + dy group by all having count(*) = 4"
O["grid_frontier"] = O["grid_erode"].replace("select g.region_id", "select region_id, ix as vx, iy as vy, ih as vf from grid except select g.region_id")
O["exposed_faces"] = _with("grid", "d as (select * from (values (0, -1, 0, 0), (1, 1, 0, 0), (2, 0, -1, 0), (3, 0, 1, 0), (4, 0, 0, -1), (5, 0, 0, 1)) t(offset_id, dx, dy, dh))") + """
select g.region_id, d.offset_id::int as offset_id, count(*) as faces from grid g join d on true left join grid h on h.region_id = g.region_id and h.ix = g.ix + dx and h.iy = g.iy + dy and h.ih = g.ih + dh where h.ix is null group by all"""
_base = f"c as (select distinct {x_tile('lon', 20)} as x, {y_tile('lat', 20)} as y from samples)"
_ring = "w as (select * from (values " + ", ".join(f"({a},{b})" for a in (-1, 0, 1, 2) for b in (-1, 0, 1, 2) if a in (0, 1) or b in (0, 1)) + ") t(dx, dy))"
O["route_margins"] = _with("samples", _base, _ring) + "select distinct (2*x + dx + 2097152) % 2097152 as vx, 2*y + dy as vy from c, w where 2*y + dy between 0 and 2097151"


def _merged(source: str, keys: str, name: str = "merged") -> str:
    k = ", ".join(keys.split())
    return f"""{name}_b as (select *, max(end_s) over (partition by {k} order by start_s, end_s rows between unbounded preceding and 1 preceding) as pe from {source} where end_s > start_s),
    {name}_i as (select *, sum(case when pe is null or start_s > pe then 1 else 0 end) over (partition by {k} order by start_s, end_s rows unbounded preceding) as isl from {name}_b),
    {name} as (select {k}, min(start_s) as start_s, max(end_s) as end_s from {name}_i group by {k}, isl)"""


O["merge_intervals"] = _with("intervals", _merged("intervals", "key")) + "select * from merged"
_few = "few as (select key % 16 as cell, event_id % 9 as member, start_s, start_s + 120 + (event_id % 11) * 60 as end_s from intervals)"


def _segments(source: str, keys: str, member: str) -> str:
    k = keys.split()
    on = " and ".join(f"m.{c} = e.{c}" for c in k)
    return f"""{_merged(source, f"{keys} {member}")},
    edges as (select *, lead(a) over (partition by {", ".join(k)} order by a) as b from (select {", ".join(k)}, start_s as a from merged union select {", ".join(k)}, end_s from merged)),
    seg as (select {", ".join("e." + c for c in k)}, e.a as start_s, e.b as end_s, string_agg(m.{member}::varchar, '|' order by m.{member}) as members, count(*) as coverage from edges e join merged m on {on} and m.start_s <= e.a and e.b <= m.end_s where e.b is not null group by all)"""


O["overlap_segments"] = _with("intervals", _few, _segments("few", "cell", "member")) + "select cell, start_s, end_s, members, coverage from seg where coverage >= 2"
O["attribute_segments"] = _with("intervals", _few, _segments("few", "cell", "member"), """
    g as (select *, case when lag(end_s) over w = start_s and lag(members) over w = members then 0 else 1 end as nw from seg window w as (partition by cell order by start_s)),
    h as (select *, sum(nw) over (partition by cell order by start_s rows unbounded preceding) as isl from g)""") + "select cell, min(start_s) as start_s, max(end_s) as end_s, members from h group by cell, isl, members"  # fmt: skip
O["max_concurrency"] = _with("intervals", "e as (select start_s as t, 1 as d from intervals union all select end_s, -1 from intervals)") + "select max(s)::bigint as max_active from (select sum(d) over (order by t, d rows unbounded preceding) as s from e)"
O["dyadic_cover"] = _with("intervals", "k as (select event_id, start_s, end_s, k::int as k, (start_s + (1::bigint << k::int) - 1) >> k::int as l, end_s >> k::int as r from intervals, range(0, 32) t(k) where end_s > start_s)") + """
select event_id, start_s, end_s, (32 - k)::int as zt, v as vt from (
  select *, l as v from k where l < r and (l % 2 = 1 or (k = 31 and l = 0)) union select *, r - 1 from k where l < r and (r % 2 = 1 or (k = 31 and r = 2)))"""
O["h_cover"] = _with("points") + f"select point_id, unnest(range({f_tile('(alt - 10)', 12)}, {f_tile('greatest(alt - 10, alt + 15 - 1e-9)', 12)} + 1)) as h12 from points"

_RES = f"""base as (select flight_id, {x_tile("lon", 20)} as x, {y_tile("lat", 20)} as y, greatest({START_S}, epoch_s - 300) as start_s, least({END_S}, epoch_s + 300) as end_s,
      {f_tile("(ground_m + 20e0)", 12)} as h0, {f_tile("(ground_m + 40e0 - 1e-9)", 12)} as h1 from samples where phase = 'cruise'),
    {_ring}, around as (select flight_id, 2*x + dx as x21, 2*y + dy as y21, unnest(range(h0, h1 + 1)) as h12, start_s, end_s from base, w),
    {_merged("around", "flight_id x21 y21 h12", "res")}"""
O["reservation_atoms"] = _with("samples", _RES) + "select * from res"


def _judged(shift: str) -> str:
    return f"""s as (select flight_id, epoch_s + flight_id * 20 as epoch_s, phase, lat, lon, amsl_m from samples),
    s2 as (select flight_id, epoch_s, phase, {x_tile(f"(lon + {shift})", 21)} as x21, {y_tile("lat", 21)} as y21, {f_tile("amsl_m", 12)} as h12 from s),
    j as (select s2.*, phase = 'cruise' as applies,
      exists (select 1 from res r where r.flight_id = s2.flight_id and r.x21 = s2.x21 and r.y21 = s2.y21 and r.h12 = s2.h12 and r.start_s <= s2.epoch_s and s2.epoch_s < r.end_s) as hit,
      exists (select 1 from res r where r.flight_id = s2.flight_id and r.x21 = s2.x21 and r.y21 = s2.y21 and r.start_s <= s2.epoch_s and s2.epoch_s < r.end_s) as col,
      coalesce(epoch_s >= (select min(start_s) from res r where r.flight_id = s2.flight_id) and epoch_s < (select max(end_s) from res r where r.flight_id = s2.flight_id), false) as intime from s2),
    judged as (select flight_id, epoch_s, phase, x21, y21, h12, case when applies then hit end as inside,
      case when applies and not hit then case when not intime then 'time' when not col then 'horizontal' else 'altitude' end end as violation from j)"""


O["conformance"] = _with("samples", _RES, _judged("case when epoch_s % 3 = 0 then 0.0008e0 else 0e0 end")) + "select * from judged"
O["conformance_counts"] = _with("samples", _RES, _judged("0e0")) + """select flight_id, count(inside) as applicable, count(*) filter (where inside) as inside, count(*) filter (where not inside) as outside,
  count(*) filter (where violation = 'horizontal') as horizontal_violations, count(*) filter (where violation = 'altitude') as altitude_violations, count(*) filter (where violation = 'time') as time_violations,
  round(case when count(inside) > 0 then count(*) filter (where inside) / count(inside) else 0 end, 9) as inside_ratio from judged group by flight_id"""
_OVER = _segments("res", "x21 y21 h12", "flight_id")
O["airspace_overlaps"] = _with("samples", _RES, _OVER) + "select x21, y21, h12, count(*) as segments, sum(end_s - start_s)::bigint as seconds, max(coverage) as most from seg where coverage >= 2 group by all"
O["scenario_summary"] = _with("samples", _RES, _OVER, "f as (select flight_id, min(start_s) as a, max(end_s) as b from res group by 1)", "e as (select a as t, 1 as d from f union all select b, -1 from f)") + """
select (select count(distinct flight_id) from res) as flights, (select count(*) from (select distinct x21, y21, h12 from res)) as atoms,
  (select count(*) from (select distinct x21, y21, h12 from seg where coverage >= 2)) as overlap_atoms, (select coalesce(max(coverage), 1) from seg where coverage >= 2) as max_coverage,
  (select max(s)::bigint from (select sum(d) over (order by t, d rows unbounded preceding) as s from e)) as max_active"""
O["asof_sample"] = _with("samples", "s as (select flight_id, epoch_s, max(amsl_m) as amsl_m from samples group by 1, 2)", f"q as (select f as flight_id, t as epoch_s from range(0, 40) a(f), range({START_S - 60}, {END_S + 61}, 97) b(t))",
  "ends as (select flight_id, max(epoch_s) as last from s group by 1)") + """
select q.flight_id, q.epoch_s, case when q.epoch_s <= last and s.epoch_s is not null then s.epoch_s else -1 end as s_epoch_s, case when q.epoch_s <= last and s.epoch_s is not null then s.amsl_m else -1e0 end as s_amsl_m
from q asof left join s on q.flight_id = s.flight_id and q.epoch_s >= s.epoch_s left join ends on ends.flight_id = q.flight_id"""  # fmt: skip
O["timeslice_coverage"] = _with("samples", _RES, f"act as (select distinct flight_id, x21, y21, h12 from res where start_s <= {START_S + 3600} and {START_S + 3600} < end_s)",
  "cov as (select x21, y21, h12, count(*) as n from act group by all)", "bands as (select i as flight_id, (20 + i % 2 * 30)::double as agl_bottom_m, (40 + i % 2 * 30)::double as agl_top_m from range(0, 40) t(i))") + """
select x21, y21, agl_bottom_m, agl_top_m, array_to_string(list_sort(list(distinct flight_id)), '|') as flights, array_to_string(list_sort(list(distinct h12)), '|') as layers, max(n) as coverage
from act join cov using (x21, y21, h12) join bands using (flight_id) group by x21, y21, agl_bottom_m, agl_top_m"""  # fmt: skip
_fl = ", ".join(f"{b}::double + (k * {m} % 40)::double / 2000 as {n}" for n, b, m in (("olat", 37.45, 7), ("olon", 139.9, 11), ("dlat", 37.46, 13), ("dlon", 139.91, 17)))
_FLIGHTS = f"""with f as (select k, {START_S} + k % 34 * 180 as dep, {_fl}, 180e0 + k % 20 as og, 190e0 + k % 25 as dg, ([30e0, 50e0, 100e0])[k % 3 + 1] as agl, ([5e0, 8e0, 10e0])[k % 7 % 3 + 1] as v
    from (select s_suppkey as k from supplier)),
  r as (select *, radians(dlon - olon) as dl, 2e0*6378137e0*asin(sqrt(pow(sin(radians(dlat-olat)/2), 2) + cos(radians(olat))*cos(radians(dlat))*pow(sin(radians(dlon-olon)/2), 2))) as dist, agl / 3e0 as climb from f),
  r2 as (select *, dist / v as cruise, atan2(sin(dl)*cos(radians(dlat)), cos(radians(olat))*sin(radians(dlat)) - sin(radians(olat))*cos(radians(dlat))*cos(dl)) as brg from r)"""
O["nominal_trajectory"] = f"""{_FLIGHTS},
  s as (select *, unnest(range(0, least(ceil(climb + cruise + agl / 3e0)::bigint, {END_S} - dep) + 1)) as e from r2 where dep <= {END_S}),
  p as (select *, case when e < climb then 'climb' when e < climb + cruise then 'cruise' when e < climb + cruise + agl / 3e0 then 'descent' else 'landed' end as phase from s),
  q as (select *, case when phase = 'climb' then 0e0 when phase = 'cruise' then case when dist > 0 then greatest(0e0, least(1e0, (e - climb) * v / dist)) else 0e0 end else 1e0 end as fr from p),
  t as (select *, asin(sin(radians(olat))*cos(dist*fr/6378137e0) + cos(radians(olat))*sin(dist*fr/6378137e0)*cos(brg)) as la from q),
  u as (select k, phase, dep + e as epoch_s, case when fr = 1 then dlat when fr = 0 then olat else degrees(la) end as lat,
    case when fr = 1 then dlon when fr = 0 then olon else olon + degrees(atan2(sin(brg)*sin(dist*fr/6378137e0)*cos(radians(olat)), cos(dist*fr/6378137e0) - sin(radians(olat))*sin(la))) end as lon,
    (1 - fr) * og + fr * dg + case phase when 'climb' then least(agl, e * 3e0) when 'cruise' then agl when 'descent' then greatest(0e0, agl - (e - climb - cruise) * 3e0) else 0e0 end as amsl from t)
select k as flight_id, phase, count(*) as samples, min(epoch_s) as first_s, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, round(avg(amsl), 4) as amsl_m from u group by all"""


def _stray(stream: int) -> str:
    def knot(k: str) -> str:
        h = f"((k % 2147483647) * 7919 + {k} * 104729 + {stream} * 1299709 + 15485863) % 2147483647"
        for _ in range(3):
            h = f"(({h}) * 48271 + 11) % 2147483647"
        return f"(({h}) % 2000001)"

    return f"((15 - e % 15) * {knot('(e // 15)')} + (e % 15) * {knot('(e // 15 + 1)')}) // 15 - 1000000"


_point = lambda lat, lon, brg, d: (f"asin(sin(radians({lat}))*cos({d}/6378137e0) + cos(radians({lat}))*sin({d}/6378137e0)*cos({brg}))", f"atan2(sin({brg})*sin({d}/6378137e0)*cos(radians({lat})), cos({d}/6378137e0) - sin(radians({lat}))*sin({{q}}))")
_q1, _l1 = _point("olat", "olon", "brg", "(along / 1e3)")
_q2, _l2 = _point("la", "lo", "(brg + pi()/2)", "(cross_mm / 1e3)")
O["actual_trajectory"] = f"""{_FLIGHTS},
  m as (select *, floor(agl * 1000)::bigint as agl_mm, floor(dist * 1000)::bigint as route, (v * 1000)::bigint as spd, case when v < 6.5 then 6 when v < 9 then 8 else 10 end as st from r2),
  s as (select *, unnest(range(0, least(floor(agl_mm / 2100e0)::bigint * 2 + floor(route * 100 / (spd * (100 - st)))::bigint + 8, {END_S} - dep) + 1)) as e from m where dep <= {END_S}),
  n as (select *, (300000000000 + 3000 * 30 * ({_stray(1)})) // 100000000 as up1, (spd * (100000000 + st * ({_stray(2)}))) // 100000000 as step, {_stray(3)} as ac, {_stray(4)} as bob from s),
  c as (select *, coalesce(sum(up1) over w, 0)::bigint as up, coalesce(sum(step) over w, 0)::bigint as far from n window w as (partition by k order by e rows between unbounded preceding and 1 preceding)),
  c2 as (select *, min(case when up >= agl_mm then far end) over (partition by k) as st0 from c),
  c3 as (select *, min(case when up >= agl_mm and far - st0 >= route then up end) over (partition by k) as top from c2),
  c4 as (select *, case when up < agl_mm then 'climb' when far - st0 < route then 'cruise' when up - top < agl_mm then 'descent' else 'landed' end as phase from c3),
  c5 as (select *, min(case when phase = 'landed' then e end) over (partition by k) as fin from c4),
  d as (select *, case phase when 'climb' then 0 when 'cruise' then far - st0 else route end as along, floor(ac * (case phase when 'cruise' then 4000 when 'landed' then 0 else 500 end) / 1e6)::bigint as cross_mm,
    case phase when 'climb' then up when 'cruise' then agl_mm + floor(bob * 1500 / 1e6)::bigint when 'descent' then agl_mm - (up - top) else 0 end as high from c5 where fin is null or e <= fin),
  g as (select *, {_q1} as q from d), g1 as (select *, case when along = 0 then olat else degrees(q) end as la, case when along = 0 then olon else olon + degrees({_l1.format(q="q")}) end as lo from g),
  g2 as (select *, {_q2} as q2 from g1), g3 as (select *, case when cross_mm = 0 then la else degrees(q2) end as lat, case when cross_mm = 0 then lo else lo + degrees({_l2.format(q="q2")}) end as lon,
    og + (case when route > 0 then along / route::double when phase = 'climb' then 0 else 1 end) * (dg - og) + high / 1e3 as amsl from g2)
select k as flight_id, phase, count(*) as samples, min(dep + e) as first_s, sum(along)::bigint as along_mm, sum(cross_mm)::bigint as cross_mm, sum(high)::bigint as agl_mm, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, round(sum(amsl), 4) as amsl_sum_m,
  round(sum(step / spd::double), 7) as speed_sum from g3 group by all"""
O["zoom_histogram"] = _with("cells") + "select region_id, zx, zy, count(*) as cells from cells group by all"
O["topk_zoom"] = _with("cells") + "select zx, zy, count(*) as cells from cells group by all order by cells desc, zx, zy limit 5"
O["flight_summary"] = _with("samples", _RES) + "select flight_id, (select count(*) from (select distinct x21, y21, h12 from res r where r.flight_id = s.flight_id)) as atoms, count(*) as intervals, sum(end_s - start_s)::bigint as seconds, min(start_s) as start_s, max(end_s) as end_s from res s group by flight_id"
_u = point_axes(20, 20, 16)
O["min_enclosing"] = (_with("points", "g as (select user_id % 50 as \"user\", " + ", ".join(f"min({v}) as p{a}, max({v}) as r{a}, {z} as q{a}" for a, (v, z) in _u.items()) + " from points group by 1)",
  "n as (select *, " + ", ".join(f"q{a} - case when p{a} = r{a} then 0 else length(bin(xor(p{a}, r{a}))) end as n{a}" for a in "xyf") + " from g)")
  + "select \"user\", (" + " + ".join(f"case when n{a} > 0 then {w} else 0 end" for a, w in zip("xyf", (8, 4, 2), strict=True)) + ")::int as flags, "
  + ", ".join(f"n{a}::int as z{a}, case when n{a} > 0 then p{a} >> (q{a} - n{a}) else 0 end::bigint as v{a}" for a in "xyf") + ", 0::int as zt, 0::bigint as vt from n")
O["enclosing_cover"] = (_with("shell", "g as (select region_id, ix >> 4 as fx, iy >> 4 as fy, ih >> 4 as ff, count(*) as cells, " + ", ".join(f"min(i{c}) as p{a}, max(i{c}) as r{a}, {z} as q{a}" for a, c, z in (("x", "x", 5), ("y", "y", 5), ("f", "h", 5))) + " from sh group by all)",
  "n as (select *, " + ", ".join(f"q{a} - case when p{a} = r{a} then 0 else length(bin(xor(p{a}, r{a}))) end as n{a}" for a in "xyf") + " from g)")
  + "select region_id, " + ", ".join(f"n{a}::int as z{a}, p{a} >> (q{a} - n{a}) as v{a}" for a in "xyf") + ", cells from n")
_box = "box as (select r.region_id, x.ix, y.iy, h.ih from (select distinct region_id from sh) r, range(0, 34) x(ix), range(0, 34) y(iy), range(0, 34) h(ih))"

def _filled(source: str) -> str:
    """A shell and the empty voxels with shell to the west, to the east and above."""
    return f"""select * from {source} union select b.* from box b join (select region_id, iy, ih, min(ix) as lo, max(ix) as hi from {source} group by 1, 2, 3) r on r.region_id = b.region_id and r.iy = b.iy and r.ih = b.ih and b.ix > r.lo and b.ix < r.hi
  join (select region_id, ix, iy, max(ih) as top from {source} group by 1, 2, 3) u on u.region_id = b.region_id and u.ix = b.ix and u.iy = b.iy and u.top > b.ih"""


O["directional_fill"] = _with("shell", _box) + _filled("sh")
O["max_inscribed"] = _with("shell", _box, f"so as ({_filled('sh')})", """n as (select region_id, dx::int as dx, dy::int as dy, dh::int as dh, ix >> dx::int as bx, iy >> dy::int as by, ih >> dh::int as bh, count(*) as atoms
    from so, range(0, 5) a(dx), range(0, 5) b(dy), range(0, 5) c(dh) group by all having count(*) = 1::bigint << (dx + dy + dh)::int)""") + "select * from n where atoms = (select max(atoms) from n m where m.region_id = n.region_id)"  # fmt: skip
_cube = "cu as (select a as dx, b as dy, c as dh from range(-1, 2) p(a), range(-1, 2) q(b), range(-1, 2) r(c))"
_close = "di as (select distinct region_id, ix + dx as ix, iy + dy as iy, ih + dh as ih from sh, cu), cl as (select region_id, ix + dx as ix, iy + dy as iy, ih + dh as ih from di, cu group by 1, 2, 3, 4 having count(*) = 27)"
O["closing"] = _with("shell", _cube, _close) + "select region_id, ix, iy, ih from cl"
_face = "fa as (select * from (values (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dx, dy, dh))"


def _edge(solid: str) -> str:
    return f"select s.region_id, s.ix, s.iy, s.ih from {solid} s join fa on true left join {solid} n on n.region_id = s.region_id and n.ix = s.ix + dx and n.iy = s.iy + dy and n.ih = s.ih + dh group by all having count(n.ix) < 6"


O["boundary_voxels"] = _with("grid", _face) + _edge("grid")
O["exposed_origin"] = _with("shell", _cube, _close, _box, _face, f"so as ({_filled('cl')})", f"ed as ({_edge('so')})") + """
select e.region_id, case when s.ix is not null then 'raw' when c.ix is not null then 'closed' else 'fill' end as origin, count(*) as voxels from ed e
  left join sh s using (region_id, ix, iy, ih) left join cl c using (region_id, ix, iy, ih) group by all"""
O["expansion_check"] = _with("line", _ab) + "select region_id, count(*) filter (where not i) as missing, count(*) filter (where not o) as extra from (select region_id, ix, bool_or(s = 0) as i, bool_or(s = 1) as o from (select *, 0 as s from a union all select *, 1 from b) group by all) group by 1"
O["index_update"] = _with("cells", SIDES) + "(select * from a union select * from b) except select region_id, 5, vx >> (zx - 5), 5, vy >> (zy - 5) from b"
O["voxel_set_sizes"] = _with("shell", _cube, _close, _box, f"so as ({_filled('cl')})", "al as (select region_id, ix, iy, ih, max(r) as r, max(c) as c, max(s) as s from (select *, 1 as r, 0 as c, 0 as s from sh union all select region_id, ix, iy, ih, 0, 1, 0 from cl union all select *, 0, 0, 1 from so) group by 1, 2, 3, 4)",
  "n as (select region_id, sum(r)::bigint as raw, count(*) filter (where c = 1 and r = 0) as closed_added, count(*) filter (where s = 1 and c = 0 and r = 0) as fill_added, sum(s)::bigint as solid, count(*) filter (where r = 1 and c = 0) as raw_lost from al group by 1)") + "select *, round(fill_added / solid, 9) as fill_share from n"
O["voxel_downsample"] = _with("points", "p as (select lon * 100 as e, lat * 100 as n, alt as u from points)") + "select round(avg(e), 6) as e, round(avg(n), 6) as n, round(avg(u), 6) as u from p where u >= 5 and e <= 13998e0 group by floor(e / 2e0), floor(n / 2e0), floor(u / 2e0)"
O["thinned_routes"] = _with("samples", "s as (select flight_id, epoch_s, max(lat) as lat, max(lon) as lon from samples group by 1, 2)",
  "k as (select *, row_number() over w - 1 as k, lead(epoch_s) over w is null as fin from s window w as (partition by flight_id order by epoch_s))",
  "t as (select *, lag(lat) over w as pl, lag(lon) over w as po from k where k % 5 = 0 or fin window w as (partition by flight_id order by epoch_s))") + "select flight_id, epoch_s, lat, lon from t where not (pl is not distinct from lat and po is not distinct from lon)"


def _site(z: int) -> str:
    axes = {"x": (x_tile("lon", z), z), "y": (y_tile("lat", z), z), "f": (f_tile("h", z), z)}
    return f"""select site_id, agl_m, {z} as zoom, {id_bits(axes)} as id_bits, round(-180e0 + {axes["x"][0]} * (360e0 / {1 << z}), 7) as west,
      round(degrees(atan(sinh(pi() * (1e0 - 2e0 * {axes["y"][0]} / {1 << z})))), 7) as north, round(-16383e0 + ({axes["f"][0]} << {32 - z}) / 4294967295e0 * 32767e0, 7) as bottom from s"""


O["site_cells"] = "with s as (select n_nationkey as site_id, 37.3e0 + n_nationkey / 50e0 as lat, 139.6e0 + n_nationkey / 40e0 as lon, agl_m, 150e0 + n_nationkey + agl_m as h from nation, (values (30e0), (50e0), (100e0)) t(agl_m))\n" + " union all ".join(map(_site, (20, 24, 28)))
O["index_candidates"] = _with("cells", SIDES) + " union all ".join(
    f"select a.region_id, {n}::int as axes, count(*) as pairs from (select distinct region_id, {cols} from a) a join (select distinct region_id, {cols} from b) b on a.region_id = b.region_id and " + " and ".join(f"a.v{x} >> (a.z{x} - least(a.z{x}, b.z{x})) = b.v{x} >> (b.z{x} - least(a.z{x}, b.z{x}))" for x in axes) + " group by 1"
    for n, cols, axes in ((1, "zx, vx", "x"), (2, "zx, vx, zy, vy", "xy"))
)
O["symmetric_difference_1d"] = _with("line", _ab, "s as ((select * from a except select * from b) union all (select * from b except select * from a))", closed("n", "s", "region_id", "ix", 16, ("zx", "vx"))) + "select * from n"
O["flood_fill"] = _with("shell", _cube, _close, _box, _face, "em as (select b.* from box b left join cl c using (region_id, ix, iy, ih) where c.region_id is null)").replace("with ", "with recursive ", 1).rstrip() + """,
  fl as (select region_id, ix, iy, ih from em where ix = 0 and iy = 0 and ih = 0 union select e.region_id, e.ix, e.iy, e.ih from fl join fa on true join em e on e.region_id = fl.region_id and e.ix = fl.ix + dx and e.iy = fl.iy + dy and e.ih = fl.ih + dh)
select region_id, ix, iy, ih from cl union (select * from em except select * from fl)"""
O["same_domain"] = _PAIRS + "select point_id, " + " and ".join(f"l_on{a} = r_on{a}" for a in AX) + " as same from p"
O["castle_bounds"] = _with("points") + f"select point_id, round(-16383e0 + {f_linear('alt', 14)} * (32767e0 / 16384) - 12.5e0, 6) as low_u, round(-16383e0 + ({f_linear('alt', 14)} + 1) * (32767e0 / 16384) - 12.5e0, 6) as high_u from points"
O["height_origins"] = """select s_suppkey as site, (4 + s_suppkey % 16)::int as zoom, round(coalesce(case when s_suppkey % 5 = 0 then s_acctbal end, case when s_suppkey % 3 = 0 then s_suppkey * 0.5e0 end,
  -16383e0 + round_even(16383e0 / (32767e0 / (1 << (4 + s_suppkey % 16)::int)), 0) * (32767e0 / (1 << (4 + s_suppkey % 16)::int))), 6) as origin_m from supplier"""
_W = "(1 - 6.69437999014e-3 * pow(sin(radians(37.5e0)), 2))"
_RN, _RE = f"(6378137e0 * (1 - 6.69437999014e-3) / pow({_W}, 1.5e0))", f"(6378137e0 / sqrt({_W}) * cos(radians(37.5e0)))"
_CLOUD = "cloud as (select point_id, region_id, (lon - 139.95e0) * 88000 as e, (lat - 37.5e0) * 111000 as n, alt as u from points)"
_DEG = f"deg as (select *, 37.5e0 + degrees(n / {_RN}) as la, 139.95e0 + degrees(e / ({_RE} * (1 - tan(radians(37.5e0)) * n / {_RN}))) as lo from cloud)"


def _metres(lat: str, lon: str) -> tuple[str, str]:
    n = f"(radians({lat} - 37.5e0) * {_RN})"
    return f"(radians({lon} - 139.95e0) * {_RE} * (1 - tan(radians(37.5e0)) * {n} / {_RN}))", n


O["cloud_quantize"] = _with("points", _CLOUD, _DEG) + f"select distinct {x_tile('lo', 24)} as ix, {y_tile('la', 24)} as iy, {f_linear('(u + 220e0)', 14)} as ih from deg"
O["cloud_wgs84"] = _with("points", _CLOUD, _DEG) + f"select point_id, round(la, 9) as lat, round(lo, 9) as lon, round({_metres('la', 'lo')[0]}, 5) as e, round({_metres('la', 'lo')[1]}, 5) as n from deg"
_c, _s = "cos(atan2(3e0, 4e0))", "sin(atan2(3e0, 4e0))"
O["cloud_rigid"] = _with("points", _CLOUD) + f"select point_id, round(1.5e0 * (e * {_c} - n * {_s}) + 10, 5) as e, round(1.5e0 * (e * {_s} + n * {_c}) - 20, 5) as n, round(1.5e0 * u + 5, 5) as u from cloud"
O["voxel_centres"] = _with("points", _CLOUD) + "select distinct (floor((e + 6000) / 2.5e0) + 0.5e0) * 2.5e0 - 6000 as e, (floor((n + 7000) / 2.5e0) + 0.5e0) * 2.5e0 - 7000 as n, (floor((u + 100) / 2.5e0) + 0.5e0) * 2.5e0 - 100 as u from cloud"
_LATS = {k: f"degrees(atan(sinh(pi() * (1e0 - 2e0 * (iy + {k}) / 524288))))" for k in (0, 1)}
_LONS = {k: f"(-180e0 + (ix + {k}) * (360e0 / 1048576))" for k in (0, 1)}
_CORNERS = [_metres(a, b) for a in _LATS.values() for b in _LONS.values()]
_BOXES = "tl as (select *, " + f"{x_tile('lon', 20)} as ix, {y_tile('lat', 19)} as iy, {f_linear('alt', 14)} as ih from points), bx as (select point_id, region_id, " + ", ".join(f"{fn}({', '.join(c[i] for c in _CORNERS)}) as {n}" for fn, i, n in (("least", 0, "low_e"), ("greatest", 0, "high_e"), ("least", 1, "low_n"), ("greatest", 1, "high_n"))) + ", -16383e0 + ih * (32767e0 / 16384) - 3e0 as low_u, -16383e0 + (ih + 1) * (32767e0 / 16384) - 3e0 as high_u from tl)"
O["local_boxes"] = _with("points", _BOXES) + "select point_id, " + ", ".join(f"round({c}, 4) as {c}" for c in ("low_e", "high_e", "low_n", "high_n", "low_u", "high_u")) + " from bx"
O["largest_boxes"] = _with("points", _BOXES) + "select region_id, round(max((high_e - low_e) * (high_n - low_n) * (high_u - low_u)), 2) as volume from bx group by 1"
O["prefix_durations"] = _with("intervals", "k as (select event_id, start_s, end_s, k::int as k, (start_s + (1::bigint << k::int) - 1) >> k::int as l, end_s >> k::int as r from intervals, range(0, 31) t(k) where end_s > start_s)",
  "z as (select event_id, k from k where l < r and l % 2 = 1 union all select event_id, k from k where l < r and r % 2 = 1)") + "select event_id, (select end_s - start_s from intervals i where i.event_id = z.event_id) as seconds, count(*) as prefixes from z group by event_id"
O["departures"] = f"""with h as (select s_suppkey as flight_id, {START_S} + (row_number() over (order by s_suppkey) - 1) * 180 as t, row_number() over (order by ((s_suppkey * 48271 + 11) % 2147483647 * 48271 + 11) % 2147483647, s_suppkey) as turn from supplier)
select flight_id, t as departure_s, strftime(to_timestamp(t) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as utc, strftime(to_timestamp(t) at time zone 'Asia/Tokyo', '%Y-%m-%dT%H:%M:%S+09:00') as jst, ([5e0, 8e0, 10e0])[turn % 3 + 1] as cruise_speed_mps from h"""
O["route_pairs"] = "with h as (select s_suppkey as flight_id, (s_suppkey * 48271 + 11) % 2147483647 as h, (select count(*) from nation) as n from supplier) select flight_id, h % n as origin, (h % n + (h * 48271 + 11) % 2147483647 % (n - 1) + 1) % n as destination from h"
O["coverage_lookup"] = _with("samples", _RES, _OVER, f"qa as (select distinct {x_tile('lon', 21)} as x21, {y_tile('lat', 21)} as y21, {f_tile('amsl_m', 12)} as h12, epoch_s from samples)") + """
select qa.*, coalesce(max(coverage), 1) as coverage from qa left join (select * from seg where coverage >= 2) s on s.x21 = qa.x21 and s.y21 = qa.y21 and s.h12 = qa.h12 and s.start_s <= qa.epoch_s and qa.epoch_s < s.end_s group by all"""
O["status_counts"] = _with("samples", _RES, f"""o as (select flight_id, epoch_s, max(phase) as phase, max(lat) as lat, max(lon) as lon, max(amsl_m) as amsl_m from samples group by 1, 2),
  now as (select flight_id, arg_max(struct_pack(epoch_s, phase, lat, lon, amsl_m), epoch_s) filter (where epoch_s <= {START_S + 3600}) as s from o group by 1 having max(epoch_s) >= {START_S + 3600}),
  n2 as (select flight_id, s.epoch_s as e, s.phase as phase, {x_tile("s.lon", 21)} as x, {y_tile("s.lat", 21)} as y, {f_tile("s.amsl_m", 12)} as h from now where s is not null),
  n3 as (select phase, case when phase = 'cruise' then exists (select 1 from res r where r.flight_id = n2.flight_id and r.x21 = x and r.y21 = y and r.h12 = h and r.start_s <= e and e < r.end_s) end as inside from n2)""") + """
select count(*) filter (where phase <> 'landed') as flying, count(inside) as monitored, count(*) filter (where inside) as inside, count(*) filter (where not inside) as outside from n3"""
_SLICE = O["timeslice_coverage"].rpartition("\nselect x21")
O["timeslice_composed"] = _SLICE[0] + ",\nsl as (select x21" + _SLICE[2] + "),\n" + closed("cx", "sl", "agl_bottom_m, agl_top_m, flights, y21", "x21", 21, ("zx", "vx")) + ",\n" + closed("cy", "cx", "agl_bottom_m, agl_top_m, flights, zx, vx", "y21", 21, ("zy", "vy")) + "\nselect * from cy"
_ATTR = """
    g as (select *, case when lag(end_s) over w = start_s and lag(members) over w = members then 0 else 1 end as nw from seg window w as (partition by x21, y21, h12 order by start_s)),
    h as (select *, sum(nw) over (partition by x21, y21, h12 order by start_s rows unbounded preceding) as isl from g),
    sg as (select x21, y21, h12, members as attribute, any_value(coverage) as cardinality, min(start_s) as start_s, max(end_s) as end_s from h group by x21, y21, h12, isl, members),
    k as (select x21, y21, h12, attribute, cardinality, k::int as k, (start_s + (1::bigint << k::int) - 1) >> k::int as l, end_s >> k::int as r from sg, range(0, 31) t(k)),
    dy as (select x21, y21, h12, attribute, cardinality, 32 - k as zt, l as vt from k where l < r and l % 2 = 1 union select x21, y21, h12, attribute, cardinality, 32 - k, r - 1 from k where l < r and r % 2 = 1)"""
# Covers in time are the largest there are, so merging in space makes no new pairs in time.
_KEY = "attribute, cardinality, zt, vt"
_NORMAL = (_ATTR, closed("n1", "dy", f"{_KEY}, y21, h12", "x21", 21, ("zx", "vx")), closed("n2", "n1", f"{_KEY}, zx, vx, h12", "y21", 21, ("zy", "vy")), closed("n3", "n2", f"{_KEY}, zx, vx, zy, vy", "h12", 12, ("zf", "vf")))
O["compression_normalized"] = _with("samples", _RES, _OVER, *_NORMAL) + "select attribute, zx, zy, zf, zt::int as zt, vx, vy, vf, vt from n3"
O["compression_zooms"] = _with("samples", _RES, _OVER, *_NORMAL) + """select cardinality::int as cardinality, zx, zy, zf, zt::int as zt, count(*) as cells, (24 + zx + zy + zf + zt)::int as bits_per_record, 1::bigint << (32 - zt)::int as time_block_s,
  (21 - zx)::int as x_coarsened_bits, (21 - zy)::int as y_coarsened_bits, (12 - zf)::int as f_coarsened_bits, zx <> zy as anisotropic_xy from n3 group by all"""
O["compression_cardinality"] = _with("samples", _RES, _OVER, *_NORMAL) + """select c::int as cardinality, (select count(*) from sg where cardinality = c) as segments, (select count(*) from dy where cardinality = c) as dyadic, (select count(*) from n3 where cardinality = c) as normalized
  from (select distinct cardinality as c from sg)"""
O["coarsening"] = _with("samples", _RES, _OVER, *_NORMAL) + """select count(*) filter (where zx < 21) as x_coarsened, count(*) filter (where zy < 21) as y_coarsened, count(*) filter (where zf < 12) as f_coarsened,
  count(*) filter (where zx < 21 or zy < 21 or zf < 12) as spatially_merged, count(*) filter (where zx <> zy) as anisotropic from n3"""
O["attribute_examples"] = _with("samples", _RES, _OVER, *_NORMAL, "fa as (select distinct cardinality, attribute from n3 order by cardinality, attribute limit 3)", "ra as (select *, row_number() over (partition by attribute order by zx, zy, zf, zt, vx, vy, vf, vt) as example from n3 semi join fa using (cardinality, attribute))") + "select cardinality::int as cardinality, attribute, example::int as example, zx, zy, zf, zt::int as zt, vx, vy, vf, vt from ra where example <= 3"
O["representation_totals"] = _with("samples", _RES, _OVER, *_NORMAL, """
    t as (select 'seconds' as representation, sum(end_s - start_s)::bigint as records, sum(end_s - start_s)::bigint * (73 + 32) as key_bits from sg
      union all select 'intervals', count(*), count(*) * (73 + 64) from sg union all select 'dyadic', count(*), sum(24 + 54 + zt)::bigint from dy union all select 'normalized', count(*), sum(24 + zx + zy + zf + zt)::bigint from n3)""") + "select *, key_bits + records * 20 as total_bits from t"  # fmt: skip
O["cell_json"] = _with("grid") + """select distinct 'bitmap' as kind, 5::int as zx, ix as vx, 5::int as zy, iy as vy, 2::int as zf, ih as vf, round(-180e0 + ix * (360e0 / 32), 6) as west,
  round(degrees(atan(sinh(pi() * (1e0 - 2e0 * iy / 32)))), 6) as north, round(-16383e0 + (ih << 30) / 4294967295e0 * 32767e0, 6) as bottom from grid"""
O["canonical_order"] = _with("cells") + "select region_id, side, zx, zy, vx, vy, row_number() over (partition by region_id, side order by zx, zy, vx, vy)::int as rank from cells"
O["generated_regions"] = """with g as (select c_nationkey as region, count(*) as n from customer group by 1)
select region, 'antichain_1d' as shape, n as cells, n as normal from g union all select region, 'antichain_4d', n, n from g union all select region, 'merge_heavy_1d', n, bit_count(n)::bigint from g
union all select region, 'anisotropic_2d', n // 2 * 2, 2 * bit_count(n // 2)::bigint from g where n >= 2"""
