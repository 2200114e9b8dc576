"""GLB and B3DM containers, their JSON, images and property tables."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tilewright.sources.decode import Guarded, decoded

GLB_MAGIC, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
#: Struct codes by glTF component type.
COMPONENTS = {5120: "b", 5121: "B", 5122: "h", 5123: "H", 5125: "I", 5126: "f"}
GLB_SCHEMA = "path string, version long, json string, bin binary, error string"
B3DM_SCHEMA = "path string, version long, byte_length long, feature_json_length long, feature_bin_length long, batch_json_length long, batch_bin_length long, gltf_length long, feature_json string, batch_json string, glb binary, error string"
IMAGE_SCHEMA = "path string, nth int, name string, mime string, uri string, data binary, error string"
PROPERTY_SCHEMA = "path string, table_idx int, feature_id long, property string, value string, error string"
VERTEX_SCHEMA = "path string, mesh int, primitive int, vertex long, offset long, component int, feature_id long, error string"


def chunks(data: bytes) -> tuple[int, bytes, bytes | None]:
    """Version, JSON and BIN of a GLB: every chunk to the end is read, of several of a kind the last counts."""
    magic, version, _ = struct.unpack_from("<III", data)
    if magic != GLB_MAGIC:
        raise ValueError("not a GLB")
    text, binary, at = None, None, 12
    while at + 8 <= len(data):
        length, kind = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + length]
        if kind == JSON_CHUNK:
            text = body
        elif kind == BIN_CHUNK:
            binary = body
        at += 8 + length
    if text is None:
        raise ValueError("no JSON chunk")
    return version, text, binary


def _glb(path: str, data: bytes) -> Iterator[dict]:
    try:
        version, text, binary = chunks(data)
        yield {"path": path, "version": version, "json": text.decode().rstrip("\x00 "), "bin": binary, "error": None}
    except (ValueError, struct.error) as wrong:
        yield {"path": path, "version": None, "json": None, "bin": None, "error": str(wrong) or "not a GLB"}


def _glb_json(path: str, data: bytes) -> Iterator[dict]:
    """The first chunk alone; BIN bytes are never copied."""
    try:
        (length,) = struct.unpack_from("<I", data, 12)
        yield {"path": path, "version": None, "json": data[20 : 20 + length].decode().rstrip("\x00 "), "bin": None, "error": None}
    except (ValueError, struct.error) as wrong:
        yield {"path": path, "version": None, "json": None, "bin": None, "error": str(wrong)}


def read_glb(contents: DataFrame, json_only: bool = False) -> DataFrame:
    """One row per GLB; a file that cannot be read has an error and nulls."""
    return decoded(contents, _glb_json if json_only else _glb, GLB_SCHEMA)


def _b3dm(path: str, data: bytes) -> Iterator[dict]:
    row = dict.fromkeys([c.split()[0] for c in B3DM_SCHEMA.split(", ")]) | {"path": path}
    if len(data) < 28:
        yield row | {"error": "too small for a B3DM"}
        return
    magic, version, total, *lengths = struct.unpack_from("<4s6I", data)
    if magic != b"b3dm":
        yield row | {"error": f"magic {magic!r}"}
        return
    starts = [28]
    for n in lengths:
        starts.append(starts[-1] + n)
    texts, errors = [], []
    for k, name in ((0, "feature"), (2, "batch")):
        text = data[starts[k] : starts[k] + lengths[k]].rstrip(b"\x00\x20").decode("utf-8", "replace")
        try:
            json.loads(text or "null")
        except ValueError as wrong:
            errors.append(f"{name} table: {wrong}: {text[:200]}")
        texts.append(text or None)
    names = ["feature_json_length", "feature_bin_length", "batch_json_length", "batch_bin_length"]
    yield row | dict(zip(names, lengths, strict=True)) | {
        "version": version, "byte_length": total, "gltf_length": total - starts[4], "feature_json": texts[0], "batch_json": texts[1], "glb": data[starts[4] : total], "error": "; ".join(errors) or None,
    }


def read_b3dm(contents: DataFrame) -> DataFrame:
    """Header lengths, both JSON tables and the inner GLB of each B3DM; JSON faults are reported with an excerpt."""
    return decoded(contents, _b3dm, B3DM_SCHEMA)


def _images(path: str, data: bytes) -> Iterator[dict]:
    _, text, binary = chunks(data)
    doc = json.loads(text)
    for nth, image in enumerate(doc.get("images", [])):
        row = {"path": path, "nth": nth, "name": image.get("name", f"texture_{nth}"), "mime": image.get("mimeType", "image/png"), "uri": None, "data": None}
        uri = image.get("uri", "")
        if "bufferView" in image:
            view = doc["bufferViews"][image["bufferView"]]
            at = view.get("byteOffset", 0)
            yield row | {"data": binary[at : at + view["byteLength"]]}
        elif uri.startswith("data:"):
            yield row | {"data": base64.b64decode(uri.split(",", 1)[1])}
        else:
            yield row | {"uri": f"{path.rsplit('/', 1)[0]}/{uri}"}


def glb_images(contents: DataFrame) -> DataFrame:
    """Images by buffer view (offset 0 where absent) or data URI; for files beside the GLB, ``uri`` is their path and data null.

    A file that cannot be read is one row with an error, here and in the two decoders below.
    """
    return decoded(contents, Guarded(_images), IMAGE_SCHEMA)


def with_external_images(images: DataFrame, contents: DataFrame) -> DataFrame:
    """Fills the data of images that are files of their own from (path, content) rows."""
    beside = contents.selectExpr("path AS _path", "content AS _content")
    joined = images.join(beside, images["uri"] == beside["_path"], "left")
    return joined.selectExpr("path", "nth", "name", "mime", "uri", "coalesce(data, _content) AS data", "error")


def _values(binary: bytes, view: dict, component: int, count: int, extra: int = 0) -> list:
    code = COMPONENTS[component]
    size = struct.calcsize(code)
    at, step = view.get("byteOffset", 0) + extra, view.get("byteStride") or size
    return [struct.unpack_from("<" + code, binary, at + i * step)[0] for i in range(count)]


def _properties(path: str, data: bytes) -> Iterator[dict]:
    _, text, binary = chunks(data)
    doc = json.loads(text)
    views = doc.get("bufferViews", [])
    for idx, tab in enumerate(doc.get("extensions", {}).get("EXT_structural_metadata", {}).get("propertyTables", [])):
        for name, prop in tab.get("properties", {}).items():
            view, count = views[prop["values"]], tab["count"]
            if "stringOffsets" in prop:
                offsets, start = _values(binary, views[prop["stringOffsets"]], 5125, count + 1), view.get("byteOffset", 0)
                values = [binary[start + a : start + b].decode() for a, b in zip(offsets, offsets[1:], strict=False)]
            else:
                values = [repr(v) if isinstance(v, float) else str(v) for v in _values(binary, view, prop["componentType"], count)]
            yield from ({"path": path, "table_idx": idx, "feature_id": i, "property": name, "value": v} for i, v in enumerate(values))


def glb_properties(contents: DataFrame) -> DataFrame:
    """One row per feature and property of the property tables; numbers as text."""
    return decoded(contents, Guarded(_properties), PROPERTY_SCHEMA)


def _vertices(path: str, data: bytes) -> Iterator[dict]:
    _, text, binary = chunks(data)
    doc = json.loads(text)
    for m, mesh in enumerate(doc.get("meshes", [])):
        for p, primitive in enumerate(mesh.get("primitives", [])):
            if "_FEATURE_ID_0" not in primitive.get("attributes", {}):
                continue
            accessor = doc["accessors"][primitive["attributes"]["_FEATURE_ID_0"]]
            view, code = doc["bufferViews"][accessor["bufferView"]], COMPONENTS[accessor["componentType"]]
            size = struct.calcsize(code)
            at, step = view.get("byteOffset", 0) + accessor.get("byteOffset", 0), view.get("byteStride") or size
            for i in range(accessor["count"]):
                yield {
                    "path": path, "mesh": m, "primitive": p, "vertex": i, "offset": at + i * step, "component": accessor["componentType"],
                    "feature_id": int(struct.unpack_from("<" + code, binary, at + i * step)[0])
                }


def glb_feature_ids(contents: DataFrame) -> DataFrame:
    """Feature id of each vertex, with the place of its bytes in BIN; primitives without feature ids have none."""
    return decoded(contents, Guarded(_vertices), VERTEX_SCHEMA)
