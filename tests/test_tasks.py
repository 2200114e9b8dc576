"""Whole tasks end to end on small files."""

import io
import json
import zipfile

import numpy as np
from pyspark.sql import functions as F

from tests.test_sources import CITY, contents, depth_png, make_glb, make_subtree, make_tile
from tilewright.plans import tasks
from tilewright.sources import gltf, xml_nodes


def test_subset(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in {"codelists/a.xml": b"<a/>", "udx/m.gml": CITY.encode(), "udx/t/one.jpg": b"1", "udx/t/two.jpg": b"2", "udx/dem/x.gml": b"<x/>", "udx/dem/y.gml": b"<y/>"}.items():
            z.writestr(name, data)
    got = {
        (r.place, r.path): bytes(r.content) for r in tasks.subset_citygml(
            spark, contents(spark, {"z": buffer.getvalue()}), {"udx/m.gml": ["D"], "udx/dem/": ["x"], "other": 3}
        ).collect()
    }
    assert set(got) == {("artifacts", "codelists/a.xml"), ("testcase", "udx/m.gml"), ("testcase", "udx/t/two.jpg"), ("testcase", "udx/dem/x.gml")}
    assert b'gml:id="D"' in got[("testcase", "udx/m.gml")] and b'gml:id="A"' not in got[("testcase", "udx/m.gml")]
    assert xml_nodes.read_nodes(contents(spark, {"m": got[("testcase", "udx/m.gml")]})).where("error IS NOT NULL").count() == 0


def test_glb_tasks(spark):
    files = contents(spark, {"a.glb": make_glb(), "b.glb": make_glb(strings=("x", "y"))})
    masked = tasks.mask_glbs(files, ["roof"])
    assert [r.path for r in masked.collect()] == ["a.glb"]
    assert [r.feature_id for r in gltf.glb_feature_ids(masked).orderBy("vertex").collect()] == [0, 65535, 2, 65535]
    texts = tasks.dump_glb_json(files)
    assert {r.path for r in texts.collect()} == {"a.json", "b.json"}
    again = tasks.load_glb_json(files.unionByName(texts.where("path = 'a.json'"))).collect()
    assert [(r.path, bytes(r.content)) for r in again] == [("a.glb", make_glb())]


def test_tileset_report(spark, tmp_path):
    for d in ("s", "c/0/0"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "s/0.0.0.subtree").write_bytes(make_subtree({"bufferViews": [], "tileAvailability": {"constant": 1}, "contentAvailability": [{"constant": 1}]}))
    (tmp_path / "c/0/0/0.glb").write_bytes(make_glb())
    (tmp_path / "tileset.json").write_text(
        json.dumps(
            {
                "root": {
                    "boundingVolume": {"region": [0, 0, 1, 1, 0, 0]}, "content": {"uri": "c/{level}/{x}/{y}.glb"},
                    "implicitTiling": {"subtreeLevels": 2, "subtrees": {"uri": "s/{level}.{x}.{y}.subtree"}}
                }
            }
        )
    )
    report = tasks.tileset_report(spark, str(tmp_path))
    assert [(r.level, r.features) for r in report["cells"].collect()] == [(0, 3)]
    assert report["totals"].first().all_tiles == 1 and report["warnings"].count() == 4


def test_reports(spark):
    types = tasks.mvt_report(contents(spark, {"t/1/2/3.mvt": make_tile(), "bad": b"\x1a\xff"}))
    assert types["types"].count() == 5 and types["errors"].count() == 1 and types["invalid"].first().invalid == 2
    picture, summary = tasks.raster_report(contents(spark, {"p": depth_png(np.array([[1.0, np.inf]]))}), contents(spark, {"q": depth_png(np.array([[2.0, np.inf]]))}), "d.png", 2.0)
    assert picture.first().path == "d.png" and summary.first().max_abs_diff == 1.0


def test_pack(spark):
    meta = json.dumps({"json": json.dumps({"vector_layers": [{"id": "l"}]}), "bounds": "1,2,3,4", "center": "1,2,3"}).encode()
    rows = spark.createDataFrame(
        [
            ("tran_lod1", "0/0/0.mvt", bytearray(b"t")), ("tran_lod1", "metadata.json", bytearray(meta)), ("bldg", "tileset.json", bytearray(b"{}")),
            ("bldg", "a.b3dm", bytearray(b"b")), ("none", "x.txt", bytearray(b"x"))
        ],
        "dir string, path string, content binary"
    )
    got = {r.path: sorted(zipfile.ZipFile(io.BytesIO(bytes(r.content))).namelist()) for r in tasks.pack_outputs(rows, "city_op_1.zip").collect()}
    assert got == {"city_op_tran_mvt_lod1.zip": ["0/0/0.mvt", "metadata.json", "tilejson.json"], "city_op_bldg_3dtiles.zip": ["tileset.json"]}


def test_load_summary(spark):
    frames = spark.createDataFrame(
        [(c, r, float(t), int(t < 3), 0, int(t > 1)) for c in "ab" for r in (0, 1) for t in range(1, 6)],
        "codec string, rep int, t double, pending int, processing int, ready int"
    )
    gpu = spark.createDataFrame([("a", 0, 2.5), ("a", 0, 3.5)], "codec string, rep int, gpu_ms double")
    requests = spark.createDataFrame(
        [("a", 0, 0.0, 1.0, 2.0, 4.0, 10.0, 20.0), ("a", 0, 1.5, 1.0, 3.0, 4.0, 10.0, 20.0)],
        "codec string, rep int, request_start double, fetch_start double, response_start double, response_end double, transfer_size double, encoded_size double"
    )
    runs, stats = tasks.load_summary(frames, gpu, requests, ["frame_ms_p50", "frames"])
    row = runs.where("codec = 'a' AND rep = 0").first()
    assert (row.first_content_ms, row.requests_done_ms, row.gpu_ms_total, row.peak_concurrency, row.avg_queued_ms) == (2, 2, 6.0, 2, 0.25)
    assert {(r.codec, r.metric, r.n, r["mean"]) for r in stats.collect()} == {(c, m, 2, v) for c in "ab" for m, v in (("frame_ms_p50", 1.0), ("frames", 5.0))}
