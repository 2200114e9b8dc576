"""Mapbox vector tiles: a small protobuf reader."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tilewright.sources.decode import decoded

FEATURE_SCHEMA = "path string, layer string, nth int, extent int, gtype string, coordinates string, props map<string,string>, error string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; length-delimited and fixed values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
            continue
        if kind == 2:
            size, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")
        if at + size > len(data):
            raise ValueError("message is cut off")
        yield key >> 3, data[at : at + size]
        at += size


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append(v)
    return out


def _zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _value(data: bytes) -> str | None:
    for field, v in _fields(data):
        if field == 1:
            return v.decode()
        if field in (2, 3):
            return repr(struct.unpack("<f" if field == 2 else "<d", v)[0])
        if field == 4:
            return str(v - (1 << 64) if v >> 63 else v)
        if field == 5:
            return str(v)
        if field == 6:
            return str(_zigzag(v))
        if field == 7:
            return "true" if v else "false"
    return None


def _parts(commands: list[int]) -> list[list[list[int]]]:
    """Point lists of MoveTo and LineTo commands; ClosePath repeats a ring's first point."""
    parts, at, x, y = [], 0, 0, 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == 7:
            parts[-1].append(parts[-1][0])
            continue
        for _ in range(count):
            x, y = x + _zigzag(commands[at]), y + _zigzag(commands[at + 1])
            at += 2
            if command == 1:
                parts.append([])
            parts[-1].append([x, y])
    return parts


def _area(ring: list[list[int]]) -> int:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _geometry(kind: int, commands: list[int]) -> tuple[str, list]:
    parts = _parts(commands)
    if kind == 1:
        points = [p for part in parts for p in part]
        return ("Point", points[0] if points else []) if len(points) <= 1 else ("MultiPoint", points)
    if kind == 2:
        return ("LineString", parts[0] if parts else []) if len(parts) <= 1 else ("MultiLineString", parts)
    if kind == 3:
        polygons: list[list] = []
        for ring in parts:
            # A ring turned like the first one starts a polygon; others are its holes.
            if not polygons or (_area(ring) > 0) == (_area(polygons[0][0]) > 0):
                polygons.append([])
            polygons[-1].append(ring)
        return ("Polygon", polygons[0] if polygons else []) if len(polygons) <= 1 else ("MultiPolygon", polygons)
    return "Unknown", parts


def _tile(path: str, data: bytes) -> Iterator[dict]:
    row = {"path": path, "layer": None, "nth": None, "extent": None, "gtype": None, "coordinates": None, "props": None, "error": None}
    try:
        found = []
        for field, layer in _fields(data):
            if field != 3:
                continue
            name, extent, keys, values, features = "", 4096, [], [], []
            for f, v in _fields(layer):
                if f == 1:
                    name = v.decode()
                elif f == 2:
                    features.append(v)
                elif f == 3:
                    keys.append(v.decode())
                elif f == 4:
                    values.append(_value(v))
                elif f == 5:
                    extent = v
            for nth, feature in enumerate(features):
                kind, tags, commands = 0, [], None
                for f, v in _fields(feature):
                    if f == 2:
                        tags = _packed(v)
                    elif f == 3:
                        kind = v
                    elif f == 4:
                        commands = _packed(v)
                gtype, coords = (None, None) if commands is None else _geometry(kind, commands)
                props = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=False)}
                found.append(
                    row | {
                        "layer": name, "nth": nth, "extent": extent, "gtype": gtype,
                        "coordinates": None if coords is None else json.dumps(coords, separators=(",", ":")), "props": [*props.items()]
                    }
                )
        yield from found
    except (ValueError, IndexError, struct.error) as wrong:
        yield row | {"error": f"{type(wrong).__name__}: {wrong}"}


def read_mvt(contents: DataFrame) -> DataFrame:
    """One row per feature, coordinates as JSON; a tile that cannot be read is one row with an error."""
    return decoded(contents, _tile, FEATURE_SCHEMA)
