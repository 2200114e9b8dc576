"""Implicit-tiling arithmetic: Morton order, levels, bits, cell regions, tile coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The masks that spread 32 bits over the even places of 64.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
MERCATOR_HALF = 20037508.342789244


def _spread(v: Column) -> Column:
    out = v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def morton(x: Column, y: Column) -> Column:
    """Z-order index of two 32-bit numbers (as a signed long)."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def level_offset(level: Column) -> Column:
    """Cells of all coarser levels: (4^level - 1) / 3."""
    return F.floor((F.pow(F.lit(4.0), level) - 1) / 3).cast("long")


def bit_at(data: Column, index: Column) -> Column:
    """Bit ``index`` of a binary column, lowest bit of each byte first."""
    byte = F.conv(F.hex(F.substring(data, (F.floor(index / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (index % 8).cast("int")).cast("int")


def child(root: Column, level: Column, rest: Column) -> Column:
    """Coordinate ``level`` levels below ``root``."""
    return F.call_function("shiftleft", root.cast("long"), level.cast("int")).bitwiseOR(rest.cast("long"))


def cell_region(level: Column, x: Column, y: Column, region: Column) -> Column:
    """Degrees (west, south, east, north) of a cell; ``region`` is west, south, east, north in radians."""
    n = F.pow(F.lit(2.0), level)
    dx, dy = (region[2] - region[0]) / n, (region[3] - region[1]) / n
    return F.struct(
        F.degrees(region[0] + x * dx).alias("west"), F.degrees(region[1] + y * dy).alias("south"),
        F.degrees(region[0] + (x + 1) * dx).alias("east"), F.degrees(region[1] + (y + 1) * dy).alias("north"),
    )


def uri(template: Column, level: Column, x: Column, y: Column) -> Column:
    """A URI template with its {level}, {x} and {y} filled in."""
    for name, v in (("level", level), ("x", x), ("y", y)):
        template = F.replace(template, F.lit("{" + name + "}"), v.cast("string"))
    return template


def mercator_tile(x: Column, y: Column, zoom: Column) -> Column:
    """Tile (z, x, y) that holds a Web-Mercator point, rows from the top."""
    size = F.lit(2 * MERCATOR_HALF) / F.pow(F.lit(2.0), zoom)
    return F.struct(zoom.cast("int").alias("z"), F.floor((x + MERCATOR_HALF) / size).alias("x"), F.floor((MERCATOR_HALF - y) / size).alias("y"))


def within_tile(x: Column, y: Column, zoom: Column) -> Column:
    """A Web-Mercator point in its tile's 0-1 space from the tile's lower left, six decimals."""
    size = F.lit(2 * MERCATOR_HALF) / F.pow(F.lit(2.0), zoom)
    t = mercator_tile(x, y, zoom)
    return F.struct(F.round((x - (t["x"] * size - MERCATOR_HALF)) / size, 6).alias("x"), F.round((y - (MERCATOR_HALF - (t["y"] + 1) * size)) / size, 6).alias("y"))


def tile_root(path: Column) -> Column:
    """The folder three levels above a z/x/y.ext file."""
    return F.regexp_extract(path, r"^(.*)/[^/]+/[^/]+/[^/]+$", 1)
