"""GLB, ZIP, PNG and XML writers: rows in, (path, content) rows out."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Iterator
from functools import partial
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans import ship
from tilewright.sources.gltf import BIN_CHUNK, COMPONENTS, GLB_MAGIC, JSON_CHUNK
from tilewright.sources.rasters import write_png

CONTENT = "path string, content binary"


def build_glb(text: str, binary: bytes | None) -> bytes:
    """A GLB of version 2: compact JSON padded with spaces, BIN with zeros, to multiples of four."""
    body = json.dumps(json.loads(text), separators=(",", ":")).encode()
    body += b" " * (-len(body) % 4)
    parts = [struct.pack("<II", len(body), JSON_CHUNK), body]
    if binary is not None:
        padded = binary + b"\x00" * (-len(binary) % 4)
        parts += [struct.pack("<II", len(padded), BIN_CHUNK), padded]
    whole = b"".join(parts)
    return struct.pack("<III", GLB_MAGIC, 2, 12 + len(whole)) + whole


def write_glb(glbs: DataFrame) -> DataFrame:
    """GLB contents of (path, json, bin) rows; also the way to replace a JSON chunk."""
    ship(glbs.sparkSession)

    @F.pandas_udf("binary")
    def build(text: pd.Series, binary: pd.Series) -> pd.Series:
        return pd.Series([build_glb(t, b) for t, b in zip(text, binary, strict=True)])

    return glbs.select("path", build("json", "bin").alias("content"))


def _patch(frame: pd.DataFrame) -> pd.DataFrame:
    binary = bytearray(frame["bin"].iloc[0])
    for at, component, value in zip(frame["offset"], frame["component"], frame["new_id"], strict=True):
        if not pd.isna(at):
            struct.pack_into("<" + COMPONENTS[int(component)], binary, int(at), int(value))
    return pd.DataFrame({"path": [frame["path"].iloc[0]], "content": [build_glb(frame["json"].iloc[0], bytes(binary))]})


def masked_glbs(glbs: DataFrame, masked: DataFrame) -> DataFrame:
    """GLBs with the changed feature ids of ``mask_features`` written into BIN; a file's vertices fit in a task as the file does.

    Files without a changed id come back rebuilt with the ids they had.
    """
    ship(glbs.sparkSession)
    changed = masked.where("new_id <> feature_id").groupBy("path").agg(F.collect_list(F.struct("offset", "component", "new_id")).alias("changes"))
    rows = glbs.select("path", "json", "bin").join(changed, "path", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                changes = r.changes if r.changes is not None else []
                frame = pd.DataFrame(
                    [{"path": r.path, "json": r.json, "bin": r.bin, **c} for c in changes] or [
                        {"path": r.path, "json": r.json, "bin": r.bin, "offset": None, "component": None, "new_id": None}
                    ]
                )
                out.append(_patch(frame))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(run, CONTENT)


def image_files(images: DataFrame, by_mime: bool = False) -> DataFrame:
    """(path, content) of embedded images: ``stem-name.subtype``, or ``name.ext`` with bin for unknown kinds."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    kind = F.substring_index("mime", "/", -1)
    ext = F.when(kind == "webp", "webp").when(kind == "jpeg", "jpg").when(kind == "png", "png").otherwise("bin")
    name = F.concat(F.col("name"), F.lit("."), ext) if by_mime else F.concat(stem, F.lit("-"), F.col("name"), F.lit("."), kind)
    return images.where("data IS NOT NULL").select(name.alias("path"), F.col("data").alias("content"))


def _zip(batch_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, content in sorted(zip(frame["path"], frame["content"], strict=True)):
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return pd.DataFrame({"path": [batch_key[0]], "content": [out.getvalue()]})


def zip_archives(rows: DataFrame) -> DataFrame:
    """One archive per ``archive`` of (archive, path, content) rows, members by name with a fixed date, so that reruns agree.

    An archive is one value: its members have to fit in a task, as in any writer of single ZIP files.
    """
    ship(rows.sparkSession)
    return rows.select("archive", "path", "content").groupBy("archive").applyInPandas(_zip, CONTENT)


def _picture(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    pixels = np.zeros((int(frame["y"].max()) + 1, int(frame["x"].max()) + 1, 3), np.uint8)
    pixels[frame["y"], frame["x"]] = frame[["red", "green", "blue"]].to_numpy()
    return pd.DataFrame({"path": [key[0]], "content": [write_png(pixels)]})


def diff_pictures(pixels: DataFrame) -> DataFrame:
    """One RGB picture per ``path`` of (path, y, x, red, green, blue) rows."""
    ship(pixels.sparkSession)
    return pixels.select("path", "y", "x", "red", "green", "blue").groupBy("path").applyInPandas(_picture, CONTENT)


def serialize(rows: list[dict], header: str = '<?xml version="1.0" encoding="UTF-8"?>') -> str:
    """XML of node rows in document order: elements that hold text alone on one line, a line end after each close.

    Text after an element (``tail``) follows its close, so that mixed content keeps its order.
    """
    parents = {r["parent_pre"] for r in rows}
    out, open_ = [header + "\n"], []
    after = lambda r: escape((r.get("tail") or "").strip())

    def close(until: int | None) -> None:
        while open_ and open_[-1]["pre"] != until:
            r = open_.pop()
            out.append(f"</{r['qname']}>\n{after(r)}")

    for r in rows:
        close(r["parent_pre"])
        attrs = "".join(f" {k}={quoteattr(v)}" for k, v in (dict(r["attrs"]) if r["attrs"] is not None else {}).items())
        out.append(f"<{r['qname']}{attrs}>{escape((r['text'] or '').strip())}")
        if r["pre"] in parents:
            out.append("\n")
            open_.append(r)
        else:
            out.append(f"</{r['qname']}>\n{after(r)}")
    close(None)
    return "".join(out)


def _xml(key: tuple, frame: pd.DataFrame, header: str) -> pd.DataFrame:
    rows = frame.sort_values("pre").astype(object).where(lambda d: d.notna(), None).to_dict("records")
    return pd.DataFrame({"path": [key[0]], "content": [serialize(rows, header).encode()]})


def write_xml(nodes: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """(path, content) of documents from their nodes; with namespaces, the root declares them again."""
    ship(nodes.sparkSession)
    rows = nodes.where("error IS NULL").select("path", "pre", "parent_pre", "qname", "attrs", "text", "tail")
    if namespaces is not None:
        declared = F.transform_keys("namespaces", lambda k, _: F.when(k == "_default", F.lit("xmlns")).otherwise(F.concat(F.lit("xmlns:"), k)))
        rows = rows.join(namespaces.select("path", declared.alias("_ns")), "path", "left").withColumn(
            "attrs",
            F.when(F.col("parent_pre").isNull(), F.map_concat(F.coalesce("_ns", F.create_map().cast("map<string,string>")), F.col("attrs"))).otherwise(F.col("attrs"))
        ).drop("_ns")
    rows = rows.withColumn("attrs", F.map_entries("attrs"))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame["attrs"] = [[(e["key"], e["value"]) for e in a] for a in frame["attrs"]]
        return _xml(key, frame, '<?xml version="1.0" encoding="UTF-8"?>')

    return rows.groupBy("path").applyInPandas(run, CONTENT)


build_zip = partial(_zip, ("archive.zip",))
