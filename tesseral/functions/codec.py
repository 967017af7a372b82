"""Tile numbers of coordinates, and cells as bit strings and bytes.

An ID is 4 flag bits, 5 bits (zoom - 1) for each active axis and then each axis's prefix, up to 152 bits.
No Spark integer holds that, so an ID is a string of 0 and 1, or binary padded with zero bits at its end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions.cells import AXES, BIT, CELL, VALUES, ZOOMS, shl, shr

#: Domains of the axes (fixed values): degrees, degrees after clamping, metres, seconds since 1970.
X_LOW, X_HIGH = -180.0, 180.0
MAX_LATITUDE = 85.05112877980659
F_LOW, F_HIGH = -16383.0, 16384.0
T_BITS = 32


def _lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _tiles(zoom: Column | int) -> Column:
    return shl(F.lit(1), _lit(zoom))


def x_tile(lng: Column, zoom: Column | int) -> Column:
    """The column of a longitude, wrapped to [-180, 180). The remainder is floored, so that tiny negative
    angles land in the last tile."""
    span = X_HIGH - X_LOW
    r = (lng - F.lit(X_LOW)) % F.lit(span)
    wrapped = (r + F.when(r < 0, F.lit(span)).otherwise(F.lit(0.0))) + F.lit(X_LOW)
    n = _tiles(zoom)
    return F.when(lng.isNotNull(), F.least(((wrapped - F.lit(X_LOW)) / F.lit(span) * n).cast("long"), n - 1))


def y_tile(lat: Column, zoom: Column | int) -> Column:
    """The row of a latitude on the Web Mercator square, counted southward, clamped to the square."""
    r = F.radians(F.greatest(F.lit(-MAX_LATITUDE), F.least(F.lit(MAX_LATITUDE), lat)))
    n = _tiles(zoom)
    row = ((F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.pi()) / F.lit(2.0) * n).cast("long")
    return F.when(lat.isNotNull(), F.least(F.greatest(row, F.lit(0).cast("long")), n - 1))


def f_tile(height: Column, zoom: Column | int) -> Column:
    """The layer of an altitude: scaled to 2 ** 32 - 1 steps, then shifted. Not clamped; see f_in_range."""
    full = ((height - F.lit(F_LOW)) / F.lit(F_HIGH - F_LOW) * F.lit(4294967295.0)).cast("long")
    return shr(full, F.lit(32) - _lit(zoom))


def f_tile_linear(height: Column, zoom: Column | int) -> Column:
    """The layer of an altitude on 2 ** zoom equal steps, clipped to the domain: the convention of point clouds."""
    n = _tiles(zoom)
    return F.when(height.isNotNull(), F.least(F.greatest(F.floor((height - F.lit(F_LOW)) / F.lit(F_HIGH - F_LOW) * n), F.lit(0).cast("long")), n - 1))


def f_in_range(height: Column) -> Column:
    return height.between(F_LOW, F_HIGH)


def t_tile(seconds: Column, zoom: Column | int) -> Column:
    """The time prefix of Unix seconds. Not clamped; see t_in_range."""
    return shr(seconds, F.lit(T_BITS) - _lit(zoom))


def t_in_range(seconds: Column) -> Column:
    return (seconds >= 0) & (seconds < F.lit(1 << T_BITS))


def encode(df: DataFrame, *, x: str | None = None, y: str | None = None, f: str | None = None, t: str | None = None, zooms: dict[str, int | str]) -> DataFrame:
    """df with the cell columns of its points. A null coordinate leaves its axis out of that row's cell."""
    tile = {"x": x_tile, "y": y_tile, "f": f_tile, "t": t_tile}
    given = {"x": x, "y": y, "f": f, "t": t}
    flags, cols = F.lit(0), {}
    for a in AXES:
        if given[a] is None:
            cols[f"z{a}"], cols[f"v{a}"] = F.lit(0), F.lit(0).cast("long")
            continue
        c, z = F.col(given[a]), zooms[a]
        z = F.col(z) if isinstance(z, str) else F.lit(z)
        flags = flags + F.when(c.isNotNull(), BIT[a]).otherwise(0)
        cols[f"z{a}"] = F.when(c.isNotNull(), z).otherwise(0).cast("int")
        cols[f"v{a}"] = F.coalesce(tile[a](c, z), F.lit(0).cast("long"))
    cols["flags"] = flags.cast("int")
    keep = [c for c in df.columns if c not in CELL]
    return df.select(*keep, *[cols[c].alias(c) for c in CELL])


def bits_of(value: Column, n: Column) -> Column:
    """value as n binary digits; none for n = 0."""
    return F.when(n > 0, F.lpad(F.bin(value), n, F.lit("0"))).otherwise(F.lit(""))


def id_bits(side: str = "") -> Column:
    """The ID of a cell as a string of binary digits."""
    heads = [F.when(F.col(f"{side}z{a}") > 0, F.lpad(F.bin(F.col(f"{side}z{a}") - 1), 5, "0")).otherwise(F.lit("")) for a in AXES]
    bodies = [bits_of(F.col(f"{side}v{a}"), F.col(f"{side}z{a}")) for a in AXES]
    return F.concat(F.lpad(F.bin(F.col(side + "flags")), 4, "0"), *heads, *bodies)


def bit_length(side: str = "") -> Column:
    """The length of an ID: 4, and 5 + zoom for each active axis."""
    return F.lit(4) + reduce(Column.__add__, (F.when(F.col(side + z) > 0, F.col(side + z) + 5).otherwise(0) for z in ZOOMS))


def read_bits(bits: Column, start: Column | int, n: Column | int) -> Column:
    """n digits from place `start` (from 0) as a number."""
    piece = F.substr(bits, _lit(start) + 1, _lit(n))
    return F.when(F.length(piece) > 0, F.conv(piece, 2, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def parse_bits(df: DataFrame, bits: str) -> DataFrame:
    """df with the cell columns that the ID strings in column `bits` hold."""
    b = F.col(bits)
    flags = read_bits(b, 0, 4).cast("int")
    on = {a: flags.bitwiseAND(BIT[a]) != 0 for a in AXES}
    place, zoom = F.lit(4), {}
    for a in AXES:
        zoom[a] = F.when(on[a], read_bits(b, place, 5).cast("int") + 1).otherwise(0)
        place = place + F.when(on[a], 5).otherwise(0)
    heads = df.withColumns({"flags": flags, **{f"z{a}": zoom[a] for a in AXES}, "_at": place})
    at, values = F.col("_at"), {}
    for a in AXES:
        values[f"v{a}"] = read_bits(b, at, F.col(f"z{a}"))
        at = at + F.col(f"z{a}")
    return heads.withColumns(values).drop("_at")


def strip_leading_zeros(bits: Column) -> Column:
    """What is left of an ID that went through an integer: IDs without an x axis lose digits and can't be parsed."""
    return F.ltrim(bits, F.lit("0"))


#: Digits that conv() takes at once, and as many lots of them as an ID of 152 bits has.
_LOT, _LOTS = {2: 64, 16: 16}, 3


def _let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), made), 1)


def _in_base(digits: Column, base: int, other: int) -> Column:
    """Binary digits, whole hexadecimal ones, in base 16, or the other way round; what is longer than any ID goes lot by lot."""
    lot = _LOT[base]

    def lot_of(d: Column, i: Column) -> Column:
        piece = F.substr(d, i * lot + 1, F.lit(lot))
        n = F.length(piece) / 4 if base == 2 else F.length(piece) * 4
        return F.when(F.length(piece) > 0, F.lpad(F.conv(piece, base, other), n.cast("int"), F.lit("0"))).otherwise(F.lit(""))

    def whole(d: Column) -> Column:
        more = F.array_join(F.transform(F.sequence(F.lit(0), ((F.length(d) - 1) / lot).cast("int")), lambda i: lot_of(d, i)), "")
        return F.when(F.length(d) <= lot * _LOTS, F.concat(*[lot_of(d, F.lit(i)) for i in range(_LOTS)])).otherwise(more)

    return _let(digits, whole)


def id_bytes(bits: Column) -> Column:
    """An ID's digits as bytes, with zero digits added up to whole bytes."""
    padded = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))
    return F.unhex(_in_base(padded, 2, 16))


def bytes_to_bits(data: Column) -> Column:
    """The ID that begins at the first digit of these bytes; its flags and zooms tell how long it is.

    Fails if there is less than a byte or the declared length is more than there is.
    """

    def read(d: Column) -> Column:
        # Headers that aren't there count as the longest, so the length check below fails.
        heads = F.conv(F.rpad(F.substr(d, F.lit(5), F.lit(20)), 20, "1"), 2, 10).cast("long")
        axes = F.bit_count(F.conv(F.substr(d, F.lit(1), F.lit(4)), 2, 10).cast("int"))
        return F.struct(d.alias("d"), axes.alias("axes"), heads.alias("heads"))

    def cut(s: Column) -> Column:
        zooms = reduce(Column.__add__, (F.when(s["axes"] > i, F.shiftright(s["heads"], 15 - 5 * i).bitwiseAND(31) + 1).otherwise(0) for i in range(len(AXES))))
        length = (s["axes"] * 5 + zooms + 4).cast("int")
        bad = (F.length(s["d"]) < 8) | (length > F.length(s["d"]))
        return F.when(bad, F.raise_error(F.lit("bytes hold no whole ID")).cast("string")).otherwise(F.substr(s["d"], F.lit(1), length))

    return F.when(data.isNotNull(), _let(_in_base(F.hex(data), 16, 2), lambda d: _let(read(d), cut)))


def id_separate(side: str = "") -> Column:
    """A readable form: each flag, each zoom header and each prefix, joined by slashes."""
    flags = F.lpad(F.bin(F.col(side + "flags")), 4, "0")
    parts = [F.substr(flags, F.lit(i + 1), F.lit(1)) for i in range(4)]
    parts += [F.when(F.col(side + z) > 0, F.lpad(F.bin(F.col(side + z) - 1), 5, "0")) for z in ZOOMS]
    parts += [F.when(F.col(side + z) > 0, bits_of(F.col(side + v), F.col(side + z))) for z, v in zip(ZOOMS, VALUES, strict=True)]
    return F.concat_ws("/", *parts)


def decode(df: DataFrame, side: str = "") -> DataFrame:
    """df with x, y, f, t of its cells: the west edge, the north edge, the altitude on 2 ** z - 1 steps
    and the first second; null for absent axes."""
    on = {a: F.col(f"{side}z{a}") > 0 for a in AXES}
    v = {a: F.col(f"{side}v{a}") for a in AXES}
    n = {a: _tiles(F.col(f"{side}z{a}")) for a in AXES}
    f_steps = F.nullif(n["f"] - 1, F.lit(0).cast("long"))
    return df.withColumns({
        "x": F.when(on["x"], x_west(v["x"], F.col(f"{side}zx"))),
        "y": F.when(on["y"], y_north(v["y"], F.col(f"{side}zy"))),
        "f": F.when(on["f"], F.lit(F_LOW) + v["f"] / f_steps * F.lit(F_HIGH - F_LOW)),
        "t": F.when(on["t"], shl(v["t"], F.lit(T_BITS) - F.col(f"{side}zt"))),
    })


def x_west(value: Column, zoom: Column | int) -> Column:
    return F.lit(X_LOW) + value * (F.lit(X_HIGH - X_LOW) / _tiles(zoom))


def y_north(value: Column, zoom: Column | int) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - F.lit(2.0) * value / _tiles(zoom)))))


def bounds(side: str = "") -> dict[str, Column]:
    """west, east, south, north, bottom and top of a cell; altitudes on the scale that f_tile encodes with."""
    v, z = (lambda a: F.col(f"{side}v{a}")), (lambda a: F.col(f"{side}z{a}"))
    height = lambda i: F.lit(F_LOW) + shl(i, F.lit(32) - z("f")) / F.lit(4294967295.0) * F.lit(F_HIGH - F_LOW)
    return {
        "west": x_west(v("x"), z("x")),
        "east": x_west(v("x") + 1, z("x")),
        "south": y_north(v("y") + 1, z("y")),
        "north": y_north(v("y"), z("y")),
        "bottom": height(v("f")),
        "top": F.least(height(v("f") + 1), F.lit(F_HIGH)),
    }


def f_bounds_linear(value: Column, zoom: Column | int, origin: float = 0.0) -> tuple[Column, Column]:
    """Bottom and top of a layer on 2 ** zoom equal steps, above `origin`."""
    step = F.lit(F_HIGH - F_LOW) / _tiles(zoom)
    return F.lit(F_LOW) + value * step - F.lit(origin), F.lit(F_LOW) + (value + 1) * step - F.lit(origin)


def from_iso(text: Column) -> Column:
    """Unix seconds of a time like 2025-05-21T15:00:00Z; fails on other forms. The session's zone must be UTC."""
    return F.unix_seconds(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def to_iso_jst(seconds: Column) -> Column:
    """The time nine hours ahead of UTC, as in 2025-05-22T00:00:00+09:00."""
    return F.concat(F.date_format(F.timestamp_seconds(seconds + 32_400), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def key_bits(side: str = "") -> Column:
    """Bits of a cell's key: as bit_length, for cells whose axes are all active."""
    return bit_length(side)


def duration_s(zoom: Column) -> Column:
    """Seconds that a time prefix covers."""
    return shl(F.lit(1), F.lit(T_BITS) - zoom)
