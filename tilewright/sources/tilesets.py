"""Implicit tilesets: tileset JSON and subtree files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.sources.decode import decoded

SUBTREE_SCHEMA = "path string, kind string, slot int, constant int, bits binary, error string"


def parse_tileset(texts: DataFrame, col: str = "value") -> DataFrame:
    """region (west, south, east, north in radians), subtree_levels, subtree_uri and content_uris of tilesets' JSON."""
    root = "$.root"
    get = lambda p: F.get_json_object(col, root + p)
    region = F.slice(F.from_json(get(".boundingVolume.region"), "array<double>"), 1, 4)
    many = F.transform(F.from_json(get(".contents"), "array<struct<uri:string>>"), lambda c: c["uri"])
    return texts.select(
        region.alias("region"), get(".implicitTiling.subtreeLevels").cast("int").alias("subtree_levels"),
        get(".implicitTiling.subtrees.uri").alias("subtree_uri"), F.coalesce(many, F.array(get(".content.uri"))).alias("content_uris"),
    )


def read_tileset(spark: SparkSession, path: str) -> DataFrame:
    """The parsed tileset of a file."""
    return parse_tileset(spark.read.text(path, wholetext=True))


def _subtree(path: str, data: bytes) -> Iterator[dict]:
    row = {"path": path, "kind": None, "slot": None, "constant": None, "bits": None, "error": None}
    try:
        magic, version, json_length, bin_length = struct.unpack_from("<4sIQQ", data)
        if magic != b"subt" or version != 1:
            raise ValueError(f"not a subtree of version 1: {magic!r} {version}")
        doc, binary = json.loads(data[24 : 24 + json_length]), data[24 + json_length : 24 + json_length + bin_length]

        def stream(kind: str, slot: int, entry: dict) -> dict:
            if entry.get("constant") is not None:
                return row | {"kind": kind, "slot": slot, "constant": int(entry["constant"])}
            view = doc["bufferViews"][entry["bitstream"]]
            at = view.get("byteOffset", 0)
            return row | {"kind": kind, "slot": slot, "bits": binary[at : at + view["byteLength"]] if "byteLength" in view else binary[at:]}

        found = [stream("tile", 0, doc["tileAvailability"])]
        found += [stream("content", i, e) for i, e in enumerate(doc.get("contentAvailability", []))]
        found += [stream("child", 0, e) for e in [doc.get("childSubtreeAvailability")] if e]
        yield from found
    except (ValueError, KeyError, struct.error) as wrong:
        yield row | {"error": f"{type(wrong).__name__}: {wrong}"}


def read_subtrees(contents: DataFrame) -> DataFrame:
    """One row per availability of a subtree: its kind, slot, and a constant or a bitstream."""
    return decoded(contents, _subtree, SUBTREE_SCHEMA)
