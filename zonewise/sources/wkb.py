"""Polygons as hexadecimal well-known binary, read and written in built-in expressions.

The format is that of the Simple Features standard: a byte order, a type, then counts and coordinates as IEEE doubles. Types
with a third or fourth coordinate (the standard's thousands or the extended high bits) and reference system ids are
understood; only x and y are kept. A text is read by offsets: first where its rings lie, then each ring's points, so after the
text itself no polygon stands whole in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of the standard and of its extended form.
POLYGON, MULTIPOLYGON = 3, 6
HAS_Z, HAS_M, HAS_REFERENCE = 0x80000000, 0x40000000, 0x20000000
HEADER = 5


def _swapped(digits: Column, n: int) -> Column:
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))))


def _number(data: Column, at: Column, n: int, little: Column) -> Column:
    """The ``n`` bytes from offset ``at`` as an integer (of eight bytes: with its sign)."""
    digits = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(n)))
    return F.conv(F.when(little, _swapped(digits, n)).otherwise(digits), 16, -10 if n == 8 else 10).cast("bigint")


def double_of_bits(bits: Column) -> Column:
    """The IEEE double of 64 bits."""
    power = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF))
    rest = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    normal = (1 + rest / float(1 << 52)) * F.pow(F.lit(2.0), power - 1023)
    # Below the normal range the leading 1 is missing; 2**-1074 in two steps, which stay exact.
    small = rest / float(1 << 52) * F.pow(F.lit(2.0), F.lit(-1022))
    special = F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    size = F.when(power == 0, small).when(power == 0x7FF, special).otherwise(normal)
    return F.when(bits < 0, -size).otherwise(size)


def bits_of_double(value: Column) -> Column:
    """The 64 bits of a finite double outside the subnormal range."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    power = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    rest = ((size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("bigint")
    bits = F.when(size == 0, F.lit(0).cast("bigint")).otherwise(F.shiftleft((power + 1023).cast("bigint"), 52).bitwiseOR(rest))
    return F.when(value < 0, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)


def _header(data: Column, at: Column) -> dict[str, Column]:
    """Of the geometry at an offset: byte order, plain type, bytes of a point, and where its content begins."""
    little = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1))) == "01"
    code = _number(data, at + 1, 4, little)

    def flag(bit: int) -> Column:
        return (code.bitwiseAND(F.lit(bit)) != 0).cast("int")

    plain = code.bitwiseAND(F.lit(0x1FFFFFFF))
    thousands = F.floor(plain / 1000).cast("int")
    more = flag(HAS_Z) + flag(HAS_M) + F.when(thousands == 3, 2).when(thousands > 0, 1).otherwise(0)
    return {
        "little": little,
        "type": plain % 1000,
        "width": (2 + more) * 8,
        "content": at + HEADER + 4 * flag(HAS_REFERENCE),
    }


_RING = "struct<little:boolean,width:int,part:int,ring:int,first:bigint,n:bigint>"
_STATE = f"struct<at:bigint,rings:array<{_RING}>>"


def _state(at: Column, rings: Column) -> Column:
    return F.struct(at.cast("bigint").alias("at"), rings.cast(f"array<{_RING}>").alias("rings")).cast(_STATE)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _polygon(data: Column, state: Column, part: Column) -> Column:
    """The state after the polygon that begins at its offset."""
    head = _header(data, state["at"])

    def ring(now: Column, number: Column) -> Column:
        n = _number(data, now["at"], 4, head["little"])
        found = F.struct(head["little"], head["width"], part, number, now["at"] + 4, n)
        return _state(now["at"] + 4 + n * head["width"], F.concat(now["rings"], F.array(found.cast(_RING))))

    n_rings = _number(data, head["content"], 4, head["little"])
    return F.aggregate(_upto(n_rings), _state(head["content"] + 4, state["rings"]), ring)


def vertices_from_hex_wkb(df: DataFrame, column: str, keep: Sequence[str] = ("id",)) -> DataFrame:
    """(keep..., part, ring, seq, x, y) of polygons and multipolygons in a column of hexadecimal digits.

    Ring 0 of a part is its outer one. NULL, digits that are no bytes, and geometries of other types have no rows; so have
    empty ones.
    """
    data = F.unhex(F.col(column))
    start = F.lit(0).cast("bigint")
    named = df.select(*keep, data.alias("__data")).where("__data is not null and octet_length(__data) >= 9")
    data = F.col("__data")
    head = _header(data, start)
    empty = F.array().cast(f"array<{_RING}>")
    one = _polygon(data, _state(start, empty), F.lit(0))
    n_parts = _number(data, head["content"], 4, head["little"])
    many = F.aggregate(_upto(n_parts), _state(head["content"] + 4, empty), lambda now, part: _polygon(data, now, part))
    rings = F.when(head["type"] == POLYGON, one["rings"]).when(head["type"] == MULTIPOLYGON, many["rings"])
    each = named.select(*keep, "__data", F.explode(rings).alias("g"))
    points = each.select(*keep, "__data", "g", F.explode(_upto(F.col("g.n"))).alias("seq"))
    at = F.col("g.first") + F.col("seq") * F.col("g.width")
    x, y = (double_of_bits(_number(data, at + 8 * k, 8, F.col("g.little"))) for k in (0, 1))
    return points.select(*keep, "g.part", "g.ring", "seq", x.alias("x"), y.alias("y"))


def hex_wkb_from_vertices(vertices: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """(by..., geom_wkb): the multipolygon of each id's rings, big-endian. Rings are closed, parts and rings in order.

    The format holds a polygon in one text, so this gathers one polygon's vertices; it is a sink, no step of other work.
    """

    def word(n: Column) -> Column:
        return F.lpad(F.hex(n.cast("bigint")), 8, "0")

    point = F.concat(*(F.lpad(F.hex(bits_of_double(F.col(c))), 16, "0") for c in ("x", "y")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda s: s["p"])
    rings = vertices.groupBy(*by, "part", "ring").agg(ordered.alias("p"))
    closed = F.when(F.element_at("p", 1) == F.element_at("p", -1), F.col("p")).otherwise(F.concat("p", F.slice("p", 1, 1)))
    rings = rings.withColumn("p", closed).withColumn("p", F.concat(word(F.size("p")), F.array_join("p", "")))
    parts = rings.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("ring", "p"))).alias("r"))
    polygon = F.concat(F.lit(f"00{POLYGON:08X}"), word(F.size("r")), F.array_join("r.p", ""))
    parts = parts.select(*by, "part", polygon.alias("p"))
    whole = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part", "p"))).alias("r"))
    return whole.select(
        *by, F.concat(F.lit(f"00{MULTIPOLYGON:08X}"), word(F.size("r")), F.array_join("r.p", "")).alias("geom_wkb")
    )
