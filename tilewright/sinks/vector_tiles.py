"""Mapbox vector tiles from features: the writer beside the reader, for round trips and subsets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tilewright.plans import ship

#: The format's geometry type numbers.
KINDS = {"Point": 1, "MultiPoint": 1, "LineString": 2, "MultiLineString": 2, "Polygon": 3, "MultiPolygon": 3}


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value: int | bytes) -> bytes:
    """A protobuf field: a number, or bytes with their length."""
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def commands(gtype: str, coordinates: list) -> Iterator[int]:
    """MoveTo, LineTo and ClosePath with zigzag steps; a ring's repeated last point gives way to its ClosePath."""
    parts = {
        "Point": lambda c: [c] if c else [], "LineString": lambda c: [c] if c else [], "MultiPolygon": lambda c: [r for p in c for r in p]
    }.get(gtype, lambda c: c)(coordinates)
    at = [0, 0]

    def steps(points: list) -> Iterator[int]:
        for p in points:
            for i in (0, 1):
                d, at[i] = int(p[i]) - at[i], int(p[i])
                yield d << 1 if d >= 0 else (-d << 1) - 1

    if KINDS[gtype] == 1:
        if parts:
            yield len(parts) << 3 | 1
            yield from steps(parts)
        return
    for part in parts:
        closed = KINDS[gtype] == 3
        points = part[:-1] if closed and len(part) > 1 and part[0] == part[-1] else part
        if not points:
            continue
        yield 1 << 3 | 1
        yield from steps(points[:1])
        if len(points) > 1:
            yield (len(points) - 1) << 3 | 2
            yield from steps(points[1:])
        if closed:
            yield 1 << 3 | 7


def tile(features: list[dict], extent: int = 4096) -> bytes:
    """A tile of features (layer, gtype, coordinates as JSON or None, props), layers and features in the order given."""
    layers: dict[str, list[dict]] = {}
    for f in features:
        layers.setdefault(f["layer"], []).append(f)
    out = b""
    for name, own in layers.items():
        keys: dict[str, int] = {}
        values: dict[str, int] = {}
        body = field(15, 2) + field(1, name.encode())
        for f in own:
            tags = b"".join(varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(v, len(values))) for k, v in f["props"].items())
            shape = b""
            if f["gtype"] is not None:
                drawn = [] if f["coordinates"] is None else [*commands(f["gtype"], json.loads(f["coordinates"]))]
                shape = field(3, KINDS[f["gtype"]]) + field(4, b"".join(map(varint, drawn)))
            body += field(2, field(2, tags) + shape)
        body += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, field(1, v.encode())) for v in values) + field(5, extent)
        out += field(3, body)
    return out


def write_mvt(features: DataFrame) -> DataFrame:
    """(path, content) of tiles from (path, layer, nth, gtype, coordinates, props) rows, features by number; a null type has no geometry.

    A tile is one value: its features have to fit in a task.
    """
    ship(features.sparkSession)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["layer", "nth"]).to_dict("records")
        for r in rows:
            r["props"] = dict(r["props"]) if r["props"] is not None else {}
            r["gtype"], r["coordinates"] = (None if v is None or v != v else v for v in (r["gtype"], r["coordinates"]))
        return pd.DataFrame({"path": [key[0]], "content": [tile(rows)]})

    return features.select("path", "layer", "nth", "gtype", "coordinates", "props").groupBy("path").applyInPandas(one, "path string, content binary")
