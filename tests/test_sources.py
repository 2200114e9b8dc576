"""Decoders, operators on their rows and writers, on small files with known contents."""

import io
import json
import re
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import citygml, features, models, packing, rasters, repositories, tiles, vector_tiles, workflows
from tilewright.sinks import containers, reports
from tilewright.sinks import files as file_sink
from tilewright.sources import archives, decode, gltf, synthetic, text_logs, tilesets, vector_tiles as mvt, workflows as wf, xml_nodes
from tilewright.sources.rasters import image_headers, read_depth, read_png, write_png


def contents(spark, files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")


# GLB


def make_glb(extra=None, strings=("wall", "roof", "wall"), ids=(0, 1, 2, 1)):
    values = "".join(strings).encode()
    offsets = np.cumsum([0, *map(len, strings)]).astype("<u4").tobytes()
    number = np.array([1.5, 2.5, -1.0], "<f4").tobytes()
    vertex = np.array(ids, "<u2").tobytes()
    image = b"\x89PNGdata"
    parts, views, at = [values, offsets, number, vertex, image], [], 0
    body = b""
    for k, p in enumerate(parts):
        views.append({"buffer": 0, "byteLength": len(p)} | ({"byteOffset": at} if k else {}))
        body += p
        at += len(p)
    table = {"class": "c", "count": len(strings), "properties": {"feature_type": {"values": 0, "stringOffsets": 1}, "height": {"values": 2, "componentType": 5126}}}
    doc = {"bufferViews": views, "images": [{"bufferView": 4, "mimeType": "image/png", "name": "a"}, {"uri": "data:image/webp;base64,QUJD", "mimeType": "image/webp"}, {"uri": "side.jpg", "mimeType": "image/jpeg"}],
           "accessors": [{"bufferView": 3, "componentType": 5123, "count": len(ids)}], "meshes": [{"primitives": [{"attributes": {"_FEATURE_ID_0": 0}}]}],
           "extensions": {"EXT_structural_metadata": {"propertyTables": [table]}}} | (extra or {})
    return containers.build_glb(json.dumps(doc), body)


def test_glb(spark):
    good = make_glb()
    files = contents(spark, {"d/a.glb": good, "d/bad.glb": b"nope", "d/side.jpg": b"JPEG"})
    rows = {r.path: r for r in gltf.read_glb(files).collect()}
    assert rows["d/a.glb"].version == 2 and json.loads(rows["d/a.glb"].json)["accessors"] and rows["d/bad.glb"].error
    assert gltf.read_glb(files, json_only=True).where("path = 'd/a.glb'").first().bin is None
    counts = dict(gltf.read_glb(files).select("path", tiles.feature_count()).collect())
    assert counts["d/a.glb"] == 3 and counts["d/bad.glb"] is None
    images = gltf.with_external_images(gltf.glb_images(files.where("path = 'd/a.glb'")), files)
    assert {(r.nth, r.name, r.mime, bytes(r.data)) for r in images.collect()} == {
        (0, "a", "image/png", b"\x89PNGdata"), (1, "texture_1", "image/webp", b"ABC"), (2, "texture_2", "image/jpeg", b"JPEG")
    }
    assert {r.path for r in containers.image_files(images).collect()} == {"a-a.png", "a-texture_1.webp", "a-texture_2.jpeg"}
    assert {r.path for r in containers.image_files(images, by_mime=True).collect()} == {"a.png", "texture_1.webp", "texture_2.jpg"}
    assert [r.b64 for r in reports.image_payloads(images.where("nth = 1")).collect()] == ["QUJD"]
    props = gltf.glb_properties(files.where("path = 'd/a.glb'"))
    assert {(r.feature_id, r.property, r.value) for r in props.collect()} == {
        (0, "feature_type", "wall"), (1, "feature_type", "roof"), (2, "feature_type", "wall"), (0, "height", "1.5"), (1, "height", "2.5"),
        (2, "height", "-1.0")
    }
    assert models.pooled_tables(props).count() == 0

    masked = models.mask_features(gltf.glb_feature_ids(files.where("path = 'd/a.glb'")), models.excluded_ids(props, ["roof"]))
    assert [r.new_id for r in masked.orderBy("vertex").collect()] == [0, 65535, 2, 65535]
    written = containers.masked_glbs(gltf.read_glb(files.where("path = 'd/a.glb'")), masked)
    again = gltf.glb_feature_ids(written).orderBy("vertex").collect()
    assert [r.feature_id for r in again] == [0, 65535, 2, 65535]
    unchanged = containers.masked_glbs(
        gltf.read_glb(files.where("path = 'd/a.glb'")),
        models.mask_features(gltf.glb_feature_ids(files.where("path = 'd/a.glb'")), models.excluded_ids(props, ["none"]))
    )
    assert bytes(unchanged.first().content) == good
    replaced = gltf.read_glb(files.where("path = 'd/a.glb'")).withColumn("json", F.lit('{"x": 1}'))
    new = gltf.chunks(bytes(containers.write_glb(replaced).first().content))
    assert json.loads(new[1]) == {"x": 1} and len(new[1]) % 4 == 0 and new[2] == gltf.chunks(good)[2]


def test_b3dm(spark):
    glb, feature, batch = make_glb(), b'{"BATCH_LENGTH":2}  ', b'{"id":["a","b"],"n":3,"s":"t"}\x00\x00'
    make = lambda batch: struct.pack("<4s6I", b"b3dm", 1, 28 + len(feature) + len(batch) + len(glb), len(feature), 0, len(batch), 0) + feature + batch + glb
    files = contents(spark, {"ok.b3dm": make(batch), "broken.b3dm": make(b'{"id":'), "short.b3dm": b"b3dm", "other.b3dm": b"x" * 40})
    rows = {r.path: r for r in gltf.read_b3dm(files).collect()}
    assert rows["ok.b3dm"].gltf_length == len(glb) and bytes(rows["ok.b3dm"].glb) == glb and rows["ok.b3dm"].error is None
    assert '{"id":' in rows["broken.b3dm"].error and rows["short.b3dm"].error and rows["other.b3dm"].error
    table = {(r.property, r["values"]) for r in models.batch_table(gltf.read_b3dm(files).where("path = 'ok.b3dm'")).collect()}
    assert table == {("id", "2"), ("n", "bigint"), ("s", "string")}
    assert models.payload_share(gltf.read_b3dm(files)).where("path = 'ok.b3dm'").first().percent == round(len(glb) / rows["ok.b3dm"].byte_length * 100, 1)
    inner = gltf.read_b3dm(files).where("path = 'ok.b3dm'").selectExpr("path", "glb AS content")
    assert gltf.glb_images(inner).count() == 3


def test_broken_files_are_rows(spark):
    """A file cut off anywhere, or of another kind, is a row with an error; good files beside it are read."""
    glb, png, zipped, tile = make_glb(), write_png(np.zeros((2, 2, 4))), io.BytesIO(), make_tile()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", "b" * 50)
    readers = {
        "glb": (glb, [gltf.read_glb, gltf.glb_images, gltf.glb_properties, gltf.glb_feature_ids]), "png": (png, [read_depth]), "zip": (zipped.getvalue(), [archives.zip_listing, archives.zip_members]),
        "mvt": (tile, [mvt.read_mvt]), "subtree": (make_subtree({"bufferViews": [], "tileAvailability": {"constant": 1}}), [tilesets.read_subtrees]), "gml": (CITY.encode(), [xml_nodes.read_nodes]),
    }
    for good, decoders in readers.values():
        cuts = {f"{n}": good[:n] for n in (0, 3, 9, 13, 21, len(good) // 2, len(good) - 7)} | {"good": good, "noise": bytes(range(256)) * 3}
        files = contents(spark, cuts)
        for decoder in decoders:
            rows = decoder(files).collect()
            name = "archive" if "archive" in rows[0].asDict() else "path"
            assert any(r[name] == "good" and r.error is None for r in rows), decoder
            assert all(r.error for r in rows if r[name] in ("9", "noise")) and {r[name] for r in rows if r.error} >= {"3", "9", "noise"}, decoder
    bare = containers.build_glb(json.dumps({"meshes": [{"primitives": [{"attributes": {}}, {}]}]}), None)
    assert gltf.glb_feature_ids(contents(spark, {"x": bare})).count() == 0
    assert mvt.read_mvt(contents(spark, {"x": b""})).count() == 0


# Tilesets


def make_subtree(doc, binary=b""):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 8)
    return struct.pack("<4sIQQ", b"subt", 1, len(text), len(binary)) + text + binary


def test_walk(spark, tmp_path):
    # Two levels per subtree: root tile and its four children; one child subtree at (1, 0).
    root = make_subtree({"bufferViews": [{"byteOffset": 0, "byteLength": 1}, {"byteOffset": 8, "byteLength": 1}, {"byteOffset": 16, "byteLength": 2}], "tileAvailability": {"constant": 1}, "contentAvailability": [{"bitstream": 0}, {"bitstream": 1}], "childSubtreeAvailability": {"bitstream": 2}},
                        bytes([0b00011]) + b"\0" * 7 + bytes([0b00010]) + b"\0" * 7 + bytes([0b10000010, 0]))
    leaf = make_subtree({"bufferViews": [], "tileAvailability": {"constant": 1}, "contentAvailability": [{"constant": 1}, {"constant": 0}]})
    (tmp_path / "tileset.json").write_text(
        json.dumps(
            {
                "root": {
                    "boundingVolume": {"region": [0.0, 0.0, 0.4, 0.4, -1, 9]},
                    "contents": [{"uri": "c/{level}/{x}/{y}.glb"}, {"uri": "d/{level}/{x}/{y}.glb"}],
                    "implicitTiling": {"subtreeLevels": 2, "subtrees": {"uri": "s/{level}.{x}.{y}.subtree"}}
                }
            }
        )
    )
    subtrees = tilesets.read_subtrees(contents(spark, {"/t/s/0.0.0.subtree": root, "/t/s/2.1.0.subtree": leaf}))
    spec = tilesets.read_tileset(spark, str(tmp_path / "tileset.json"))
    assert spec.first()["content_uris"] == ["c/{level}/{x}/{y}.glb", "d/{level}/{x}/{y}.glb"]
    listing = spark.createDataFrame(
        [("/t/c/0/0/0.glb", 10, 3), ("/t/c/1/0/0.glb", 20, None), ("/t/d/1/0/0.glb", 5, 2), ("/t/c/2/1/0.glb", 7, 1)],
        "path string, size long, features long"
    )
    found, warnings = tiles.walk_tileset(spec, subtrees, listing, "/t")
    assert {(r.level, r.x, r.y, r.slot, r.size, r.features) for r in found.collect()} == {(0, 0, 0, 0, 10, 3), (1, 0, 0, 0, 20, None), (1, 0, 0, 1, 5, 2), (2, 1, 0, 0, 7, 1)}
    west = {(r.level, r.x): round(r.region.west, 6) for r in found.collect()}
    assert west[(2, 1)] == round(np.degrees(0.1), 6)
    said = {(r.warning, r.uri) for r in warnings.collect()}
    assert ("missing subtree file", "s/2.3.1.subtree") in said and ("missing content file", "c/3/2/0.glb") in said and len(said) == 5
    cells = {(r.level, r.x): (r.features, r.known_slots, r.size) for r in tiles.merge_cells(found).collect()}
    assert cells[(1, 0)] == (2, 1, 25)
    top, more = tiles.first_with_rest(warnings, ["uri"], 2)
    assert top.count() == 2 and more == 3
    bad = tilesets.read_subtrees(contents(spark, {"x": b"subt" + b"\0" * 30, "y": b""})).collect()
    assert all(r.error for r in bad)


# Vector tiles


def varint(n):
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(n, value):
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def commands(*groups):
    zig, out, at = lambda v: (v << 1) ^ (v >> 31), [], (0, 0)
    for command, points in groups:
        out.append(len(points) << 3 | command if command != 7 else 15)
        for p in points if command != 7 else []:
            out += [zig(p[0] - at[0]) & 0xFFFFFFFF, zig(p[1] - at[1]) & 0xFFFFFFFF]
            at = p
    return b"".join(map(varint, out))


def make_tile():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    hole = [(2, 2), (2, 4), (4, 4), (4, 2)]
    shape = lambda ring: [(1, ring[:1]), (2, ring[1:]), (7, [None])]
    far = [(x + 50, y) for x, y in square]
    geometries = [
        (3, commands(*shape(square), *shape(hole))), (3, commands(*shape(square), *shape(far))), (2, commands((1, [(1, 1)]), (2, [(3, 4)]))),
        (1, commands((1, [(5, 6)]))), (1, commands((1, [(5, 6), (7, 8)]))), (2, commands((1, [(1, 1)]))), (1, None)
    ]
    out = field(1, b"layer") + b"".join(
        field(2, field(2, varint(0) + varint(0)) * (k == 0) + field(3, kind) + (field(4, geo) if geo is not None else b"")) for k,
        (kind, geo) in enumerate(geometries)
    )
    out += field(3, b"gml_id") + field(4, field(1, b"id1")) + field(5, 4096)
    return field(3, out)


def test_mvt(spark):
    rows = mvt.read_mvt(contents(spark, {"t/1/2/3.mvt": make_tile(), "t/bad.mvt": b"\x1a\xff"}))
    by = {r.nth: r for r in rows.where("error IS NULL").collect()}
    assert [by[i].gtype for i in range(7)] == ["Polygon", "MultiPolygon", "LineString", "Point", "MultiPoint", "LineString", None]
    assert len(json.loads(by[0].coordinates)) == 2 and json.loads(by[0].coordinates)[0][0] == [0, 0] and json.loads(by[2].coordinates) == [[1, 1], [3, 4]]
    assert by[0].props == {"gml_id": "id1"} and rows.where("error IS NOT NULL").count() == 1
    found = {(r.gml_id, r.reason) for r in vector_tiles.mvt_findings(rows).collect()}
    assert found == {("<no gml_id #5>", "linestring with 1 points"), ("<no gml_id #6>", "null geometry")}
    assert vector_tiles.invalid_counts(vector_tiles.mvt_findings(rows)).first().invalid == 2
    assert vector_tiles.compare_tiles(rows, rows).count() == 0 and vector_tiles.compare_tiles(rows, rows.where("nth = 0")).count() == 4


@pytest.mark.parametrize(
    ("gtype", "coords", "reason"),
    [("Point", "[]", "empty point"), ("Point", "[1,2]", None), ("Polygon", "[]", "empty polygon"), ("Polygon", "[[[0,0],[1,1],[2,2]],[[1,1]]]", "polygon ring 1 has 1 points (need >= 3)"), ("Polygon", "[null]", "polygon ring 0 has 0 points (need >= 3)"),
     ("MultiPolygon", "[[[[0,0],[1,1],[2,2]]],[]]", "multipolygon[1] is empty"), ("MultiPolygon", "[[[[0,0],[1,1],[2,2]],[[1,1]]]]", "multipolygon[0] ring 1 has 1 points"), ("MultiPolygon", "[]", "empty multipolygon"),
     ("MultiLineString", "[[[0,0],[1,1]],[[1,1]]]", "multilinestring[1] has 1 points"), ("MultiPoint", "[]", None), (None, None, "null geometry"), ("Point", None, "null coordinates"), ("LineString", "[]", "linestring with 0 points")],
)
def test_validity(spark, gtype, coords, reason):
    df = spark.createDataFrame([(gtype, coords)], "g string, c string")
    assert df.select(vector_tiles.invalid_reason(F.col("g"), F.col("c"))).first()[0] == reason


# Rasters


def depth_png(depth):
    return write_png(np.ascontiguousarray(depth.astype("<f4")).view(np.uint8).reshape(*depth.shape, 4))


def test_raster(spark):
    a = np.array([[1.0, np.inf, 3.0], [np.nan, 5.0, 6.0]])
    b = np.array([[1.5, 2.0, np.inf], [np.nan, 4.0, 6.0]])
    truth, flow = (read_depth(contents(spark, {"p": depth_png(x)})) for x in (a, b))
    assert rasters.same_shape(truth, flow)
    pixels = rasters.diff_pixels(truth, flow, 2.0)
    got = {(r.y, r.x): (r.kind, r.red, r.green, r.blue) for r in pixels.collect()}
    assert got == {
        (0, 0): ("both", 0, 63, 0), (0, 1): ("only_flow", 0, 255, 0), (0, 2): ("only_truth", 255, 0, 0), (1, 0): ("neither", 0, 0, 0),
        (1, 1): ("both", 127, 0, 0), (1, 2): ("both", 0, 0, 0)
    }
    s = rasters.diff_summary(pixels).first()
    assert (s.both, s.only_truth, s.only_flow, s.max_abs_diff) == (3, 1, 1, 1.0)
    picture = containers.diff_pictures(pixels.withColumn("path", F.lit("d.png"))).first()
    assert read_png(bytes(picture.content))[0, 0].tolist() == [0, 63, 0]


def test_png_filters():
    import zlib

    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (6, 5, 4)).astype(np.uint8)
    lines, above = b"", np.zeros(20, int)
    for y in range(6):
        now, kind = image[y].reshape(-1).astype(int), y % 5
        left = np.concatenate([np.zeros(4, int), now[:-4]])
        corner = np.concatenate([np.zeros(4, int), above[:-4]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        lines += bytes([kind]) + ((now - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        above = now
    whole = write_png(image)
    at = whole.index(b"IDAT")
    (size,) = struct.unpack_from(">I", whole, at - 4)
    body = zlib.compress(lines)
    patched = whole[: at - 4] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + whole[at + 8 + size :]
    assert (read_png(patched) == image).all()


# XML

CITY = """<?xml version="1.0" encoding="UTF-8"?>
<core:CityModel xmlns:core="urn:core" xmlns:bldg="urn:bldg" xmlns:gml="http://www.opengis.net/gml" xmlns:app="urn:app" xmlns="urn:plain">
<!-- a > b --><core:cityObjectMember><bldg:Building gml:id="A"><bldg:boundedBy><bldg:Wall gml:id="B"><bldg:part><bldg:Piece gml:id="C"><bldg:lod2Geometry>
<gml:Polygon gml:id="p1"><gml:exterior><gml:LinearRing gml:id="r1"><gml:posList>0 0 0 1 0 0 1 1 0 0 0 0</gml:posList></gml:LinearRing></gml:exterior><gml:interior><gml:LinearRing gml:id="r2"><gml:posList>0 0 0 1 0 0 1 1 0</gml:posList></gml:LinearRing></gml:interior></gml:Polygon>
</bldg:lod2Geometry></bldg:Piece></bldg:part></bldg:Wall></bldg:boundedBy><bldg:lod1Geometry><gml:Polygon gml:id="p2"><gml:exterior><gml:LinearRing gml:id="r3"><gml:posList>0 0 0 1 0 0 1 1 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></bldg:lod1Geometry></bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building gml:id="D"><bldg:name>n &amp; m</bldg:name><bldg:lod1Geometry><gml:Polygon gml:id="p3"/></bldg:lod1Geometry></bldg:Building></core:cityObjectMember>
<app:appearanceMember><app:Appearance><app:surfaceDataMember><app:ParameterizedTexture><app:imageURI>t/one.jpg</app:imageURI>
<app:target uri="#p1">#p1<app:TexCoordList><app:textureCoordinates ring="#r1">0 0 1 0 1 1 0 0</app:textureCoordinates><app:textureCoordinates ring="#r2">0 0 1 0</app:textureCoordinates><app:textureCoordinates ring="#nowhere">0 0</app:textureCoordinates></app:TexCoordList></app:target>
<app:target uri="#gone"><app:TexCoordList><app:textureCoordinates ring="#r1">0 0</app:textureCoordinates></app:TexCoordList></app:target></app:ParameterizedTexture></app:surfaceDataMember>
<app:surfaceDataMember><app:ParameterizedTexture><app:imageURI>t/two.jpg</app:imageURI><app:target uri="#p3"/></app:ParameterizedTexture></app:surfaceDataMember></app:Appearance></app:appearanceMember>
</core:CityModel>"""


@pytest.fixture(scope="module")
def city(spark):
    return xml_nodes.read_nodes(contents(spark, {"x/a.gml": CITY.encode(), "x/bad.gml": b"<a><b></a>"})).cache()


def test_nodes(spark, city):
    rows = {r.gml_id: r for r in city.where("gml_id IS NOT NULL").collect()}
    assert rows["A"].ns == "urn:bldg" and rows["A"].local == "Building" and rows["A"].depth == 2 and rows["A"].pre < rows["p1"].pre <= rows["A"].last
    assert city.where("error IS NOT NULL").count() == 1
    ns = xml_nodes.read_namespaces(contents(spark, {"x/a.gml": CITY.encode()})).first().namespaces
    assert ns["_default"] == "urn:plain" and ns["gml"].endswith("/gml")


def test_textured(city):
    found = lambda **k: [tuple(r)[1:] for r in citygml.textured_features(city, **k).collect()]
    assert found() == [("B", "Wall", "A"), ("C", "Piece", "A")]
    assert found(strict=True) == [("C", "Piece", "A")]
    assert found(target_from="uri", strict=True) == [("C", "Piece", "A"), ("D", "Building", "")]
    mapping = {(r.object, r.lod): r.textures for r in citygml.texture_mapping(city).collect()}
    assert mapping == {("A", "LOD1"): "", ("D", "LOD1"): "t/two.jpg"}


def test_alignment(city):
    rows = {(r.target, r.ring): r.finding for r in citygml.alignment_findings(city).where("finding <> 'parse_error'").collect()}
    assert rows == {("p1", "r1"): "ok", ("p1", "r2"): "count_mismatch", ("p1", "nowhere"): "no_ring", ("gone", "r1"): "no_polygon"}
    totals = {r.path: (r.polygons, r.textures, r.errors) for r in citygml.alignment_summary(city).collect()}
    assert totals == {"x/a.gml": (3, 4, 3), "x/bad.gml": (0, 0, 1), None: (3, 4, 4)}


def kept_ids(spark, city, ids):
    kept = citygml.keep_objects(city.where("error IS NULL"), spark.createDataFrame([(i,) for i in ids], "id string"))
    return kept, {r.gml_id for r in kept.where("gml_id IS NOT NULL").collect()}


def test_subset(spark, city):
    whole, ids = kept_ids(spark, city, ["D"])
    assert ids == {"D", "p3"}
    counts = citygml.member_counts(city, whole).first()
    assert (counts.kept, counts.removed) == (1, 1)
    final = citygml.keep_appearances(whole)
    assert {r.image for r in citygml.referenced_images(final).collect()} == {"x/t/two.jpg"}
    nested, ids = kept_ids(spark, city, ["B"])
    assert ids == {"A", "B", "p2", "r3"}  # the wanted wall's own piece goes, geometry off the path stays
    assert {r.image for r in citygml.referenced_images(citygml.keep_appearances(nested)).collect()} == set()
    deep, ids = kept_ids(spark, city, ["C"])
    assert ids == {"A", "B", "C", "p1", "r1", "r2", "p2", "r3"}
    text = containers.write_xml(citygml.keep_appearances(deep), xml_nodes.read_namespaces(contents(spark, {"x/a.gml": CITY.encode()}))).first().content
    again = xml_nodes.read_nodes(contents(spark, {"x/a.gml": bytes(text)}))
    assert again.where("error IS NOT NULL").count() == 0 and {r.gml_id for r in again.where("gml_id IS NOT NULL").collect()} == ids
    assert again.where("local = 'imageURI'").first().text == "t/one.jpg"


def test_generated_walls(spark):
    files = synthetic.wall_case(spark, walls=20, side=8).cache()
    again = {r.path: bytes(r.content) for r in synthetic.wall_case(spark, walls=20, side=8).collect()}
    assert {r.path: bytes(r.content) for r in files.collect()} == again and len(again) == 21
    nodes = xml_nodes.read_nodes(files.where("path LIKE '%.gml'")).cache()
    assert [r.finding for r in citygml.alignment_findings(nodes).collect()] == ["ok"] * 20
    assert {r.texture for r in citygml.texture_targets(nodes).collect()} == {p for p in again if p.endswith(".png")}
    assert {(r.width, r.height) for r in image_headers(files.where("path LIKE '%.png'")).collect()} == {(8, 8)}
    assert len({read_png(c)[0, 0].tobytes() for p, c in again.items() if p.endswith(".png")}) > 15
    said = {r.local: r.text for r in nodes.where("local LIKE '%Corner'").collect()}
    assert said == {"lowerCorner": "35.000 135.000 0.0", "upperCorner": "35.001 135.001 1.0"}


# Archives


def test_zip(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a/", "")
        z.writestr("a/x.txt", "hello " * 100)
        z.writestr(zipfile.ZipInfo("b/y.bin"), b"stored")
    data = buffer.getvalue()
    files = contents(spark, {"z.zip": data})
    assert {(r.member, r.size) for r in archives.zip_listing(files).collect()} == {("a/x.txt", 600), ("b/y.bin", 6)}
    assert [r.path for r in archives.zip_members(files, ["b/"]).collect()] == ["b/y.bin"]
    read = lambda at, n: data[at : at + n]
    entries = {e[0]: e for e in archives.central_directory(read, len(data))}
    assert archives.range_member(read, entries["a/x.txt"]) == b"hello " * 100 and archives.range_member(read, entries["b/y.bin"]) == b"stored"
    (tmp_path / "r.zip").write_bytes(data)
    named = spark.createDataFrame([(f"file://{tmp_path}/r.zip",), (f"file://{tmp_path}/none.zip",)], "archive string")
    remote = {(r.path, r.size, r.content and bytes(r.content), bool(r.error)) for r in archives.remote_members(named, r"\.bin$", archives.file_ranges).collect()}
    assert remote == {("a/x.txt", 600, None, False), ("b/y.bin", 6, b"stored", False), (None, None, None, True)}
    packed = containers.zip_archives(archives.zip_members(files)).first()
    with zipfile.ZipFile(io.BytesIO(bytes(packed.content))) as z:
        assert sorted(z.namelist()) == ["a/x.txt", "b/y.bin"]
    wrote = file_sink.write_files(archives.zip_members(files), f"file://{tmp_path}/out").collect()
    assert len(wrote) == 2 and (tmp_path / "out/b/y.bin").read_bytes() == b"stored"
    assert {r.path.rsplit("/", 1)[-1] for r in decode.listing(spark, str(tmp_path), "*.bin").collect()} == {"y.bin"}


def test_fetch(spark, tmp_path):
    (tmp_path / "src.txt").write_text("data")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/have.txt").write_text("old")
    rows = spark.createDataFrame([(f"file://{tmp_path}/src.txt", "a/new.txt"), (f"file://{tmp_path}/src.txt", "have.txt"), (f"file://{tmp_path}/gone.txt", "gone.txt")], "url string, path string")
    got = {r.path: (r.state, r.size, bool(r.error)) for r in file_sink.fetch_artifacts(rows.coalesce(1), f"file://{tmp_path}/out", pause=0.01).collect()}
    assert got == {"a/new.txt": ("fetched", 4, False), "have.txt": ("present", 3, False), "gone.txt": ("failed", None, True)}
    assert (tmp_path / "out/a/new.txt").read_text() == "data" and (tmp_path / "out/have.txt").read_text() == "old"


# Text logs


def test_logs(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "2024-05-02T10:00:00+09:00 refs/remotes/origin/dev\nsrc/a.py\nhyphen-ated name.txt\n\n2024-05-01T10:00:00+09:00 refs/remotes/origin/main\nsrc/a.py\n2024-04-01T10:00:00+09:00 refs/remotes/origin/dev\nsrc/a.py\n"
    )
    rows = text_logs.log_rows(text_logs.numbered_lines(spark, str(tmp_path / "log.txt")))
    assert [tuple(r) for r in repositories.recent_files(rows).collect()] == [
        ("2024-05-01T10:00:00+09:00", "main", "src/a.py"), ("2024-05-02T10:00:00+09:00", "dev", "hyphen-ated name.txt"),
        ("2024-05-02T10:00:00+09:00", "dev", "src/a.py")
    ]
    (tmp_path / "tree.txt").write_text("100644 blob aa 10\tx y\n040000 tree bb -\td\n100644 blob cc 5\tz\n")
    tree = text_logs.tree_rows(text_logs.numbered_lines(spark, str(tmp_path / "tree.txt")))
    assert repositories.tree_size(tree).first()["size"] == 15 and {r.file for r in tree.collect()} == {"x y", "d", "z"}
    (tmp_path / "stacks.txt").write_text("dtrace: x\n\n  lib`inner+0x1\n  app`outer(int)+0x2\n  3\n\n lib`inner+0x9\n app`outer(int)\n 2\n 7\n app`lone\n")
    stacks = repositories.collapse_stacks(text_logs.stack_rows(text_logs.numbered_lines(spark, str(tmp_path / "stacks.txt"))))
    assert [tuple(r) for r in stacks.collect()] == [("outer;inner", 5)]
    assert reports.stack_lines(stacks).first()[0] == "outer;inner 5"


def test_lines_are_numbered_over_splits(spark, tmp_path):
    said = [("x" * (i % 90)) if i % 7 else "" for i in range(5000)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(said).encode() + b"\r\n")
    (tmp_path / "b.txt").write_text("\n".join(said[:100]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = text_logs.numbered_lines(spark, str(tmp_path), "*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, n in (("a.txt", 5000), ("b.txt", 100)):
        assert [(r.line_no, r.value) for r in sorted(rows, key=lambda r: r.line_no) if r.path.endswith(name)] == [*enumerate(said[:n])]


def test_one_feature_is_found_alone(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 3}", i, f'{{"n":{i}.50}}') for i in range(300)], "port string, line_no long, feature string")
    text_logs.write_features(rows, str(tmp_path / "s"), lines=50)
    found = text_logs.feature_at(spark, str(tmp_path / "s"), "p1", 100, lines=50)
    assert [tuple(r) for r in found.collect()] == [("p1", 100, '{"n":100.50}')] and len(found.inputFiles()) > 0
    assert text_logs.feature_at(spark, str(tmp_path / "s"), "p1", 101, lines=50).count() == 0


def test_configuration(spark, tmp_path):
    (tmp_path / "c.toml").write_text('name = "x"\n[filter.tree]\n"a/" = ["b"]\n')
    assert text_logs.toml_config(spark, str(tmp_path / "c.toml")) == {"name": "x", "filter": {"tree": {"a/": ["b"]}}}


def test_boxes_meet_over_cells(spark):
    rng = np.random.default_rng(1)
    at, size = rng.uniform(-50, 50, (400, 2)), rng.uniform(0, 30, (400, 2))
    extents = [(i, [*p, *(p + s)]) for i, (p, s) in enumerate(zip(at, size, strict=True))]
    boxes = [(j, [*p, *(p + s)]) for j, (p, s) in enumerate(zip(rng.uniform(-60, 60, (25, 2)), rng.uniform(0, 12, (25, 2)), strict=True))] + [(25, [0.0, 0.0, 0.0, 0.0])]
    rows = spark.createDataFrame([(i, [float(x) for x in e], i % 5 > 0) for i, e in extents], "id long, extent array<double>, visible boolean")
    got = sorted(
        (r.id, r.sel) for r in vector_tiles.select_box(rows, spark.createDataFrame([(j, [float(x) for x in b]) for j, b in boxes], "sel long, box array<double>")).collect()
    )
    assert got == sorted((i, j) for i, e in extents for j, b in boxes if i % 5 and e[0] <= b[2] and e[2] >= b[0] and e[1] <= b[3] and e[3] >= b[1])
    assert vector_tiles.select_box(rows, spark.createDataFrame([], "sel long, box array<double>")).count() == 0


def test_feature_store(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    (store / "g.n.port.jsonl").write_text(
        '{"attributes":{"gml_id":"i","lod":0},"pos":[1,2,3],"list":[1,2,3,4,5,6]}\n\n{"attributes":{"lod":"2"},"metadata":{"featureType":"t"},"exterior":[{"x":1,"y":2}]}\n'
    )
    (store / "empty.jsonl").write_text("\n")
    lines = text_logs.feature_lines(text_logs.numbered_lines(spark, str(store), "*.jsonl"))
    index = features.port_index(lines).collect()
    assert [(r.port, r["count"], [tuple(f) for f in r.features]) for r in index] == [("g.n.port", 2, [(0, "i", "", ""), (2, "", "t", "2")])]
    sample = features.edge_samples(lines).first()
    assert sample.attributes == ["gml_id", "lod"] and sample["count"] == 2
    short = [json.loads(r.simplified) for r in features.simplified(lines).orderBy("line_no").collect()]
    assert short[0]["list"] == [1, 2, 3, 4, 5, "... and 1 more items"]
    gone = [json.loads(r.elided) for r in features.elided(lines).orderBy("line_no").collect()]
    assert gone[0]["pos"] == "(3 coordinates)" and gone[1]["exterior"] == "(1 coordinates)"
    reports.feature_files(features.simplified(lines), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_dependencies(spark, tmp_path):
    text = 'a = { git = "https://h/x", tag = "v1", features = ["p", "q"], optional = true }\nb = "1"\nc = {\n git = "https://h/x",\n branch = "old"\n}\nd = { git = "https://other" }\n'
    (tmp_path / "c.toml").write_text(text)
    texts = spark.read.text(str(tmp_path / "c.toml"), wholetext=True).select(F.lit("c.toml").alias("path"), "value")
    blocks = text_logs.dependency_blocks(texts)
    branch = repositories.rewrite_dependencies(blocks, "https://h/x", "new")
    assert {r.name: r.rewritten for r in branch.collect()} == {
        "a": 'a = { git = "https://h/x", features = ["p", "q"], optional = true, branch = "new" }',
        "c": 'c = { git = "https://h/x", branch = "old" }', "d": None
    }
    local = repositories.apply_rewrites(texts, repositories.rewrite_dependencies(blocks, "https://h/x", local_root="../lib")).first()["value"]
    assert local == 'a = { features = ["p", "q"], optional = true, path = "../lib/a" }\nb = "1"\nc = { path = "../lib/c" }\nd = { git = "https://other" }\n'


def test_workflow(spark):
    doc = {"entryGraphId": "g", "graphs": [{"id": "g", "name": "G", "nodes": [{"id": "n1", "name": "a", "action": "act"}, {"id": "n2", "name": "b", "type": "subGraph", "subGraphId": "subgraph-12345678"}, {"id": "n3", "name": "c", "type": "subGraph", "subGraphId": "subgraph-12345678"}], "edges": [{"id": "e1", "from": "n1", "to": "missing-node-99", "fromPort": "o", "toPort": "i"}]},
                                           {"id": "subgraph-12345678", "nodes": [{"id": "m", "name": "m"}], "edges": [{"id": "e2", "from": "m", "to": "m"}]}, None]}
    nodes, edges = wf.workflow_tables(spark, wf.parse_workflow(json.dumps(doc)))
    assert {r.edge for r in workflows.edge_ids(nodes, edges).collect()} == {"e1", "n2.e2", "n3.e2"}
    assert workflows.topology(nodes, edges).where("graph = 'g'").first().dst == "-node-99"[-8:]
    assert {r.label for r in workflows.labelled(nodes).collect()} == {"act", "subGraph:12345678", "subGraph:?"}
    assert {r.port for r in workflows.port_ids(nodes, edges).collect()} == {"n1.o", "n3.m.default"}
    have = spark.createDataFrame([("f/e1.jsonl.zst",)], "path string")
    assert {r.edge for r in workflows.missing_stores(workflows.edge_ids(nodes, edges), have).collect()} == {"n2.e2", "n3.e2"}
    assert wf.graphs_of(wf.parse_workflow("nodes: [{id: x, name: y}]\nedges: []\nother: !include z\n")) != []


def test_packing(spark):
    listing = spark.createDataFrame([("r/a/tileset.json",), ("r/a/deep/x.b3dm",), ("r/b/tileset.json",), ("r/b/y.glb",)], "path string")
    assert [r.path for r in packing.upgradable(listing).collect()] == ["r/a/tileset.json"]
    assert packing.packed_files(listing).count() == 3 and models.to_pack(listing).count() == 4
    inputs = spark.createDataFrame([("a.csv", False), ("b.txt", False), ("d", True)], "path string, is_dir boolean")
    assert {r.path: r.step for r in packing.split_inputs(inputs).collect()} == {"a.csv": None, "b.txt": "copy", "d": "pack"}
    moved = packing.relocated(spark.createDataFrame([("x/jobs/j1/artifacts/o.zip",), ("x/jobs/j1/feature-store/e.jsonl",)], "path string"))
    assert {(r.moved_to, r.jobs) for r in moved.collect()} == {("artifacts/o.zip", 1), ("runtime/feature-store/e.jsonl", 1)}


def test_reports(spark):
    shapes = [("Polygon", "[[[0,0],[10,0],[10,5],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]"), ("Point", "[3,4]"), ("Point", "[]"), ("Unknown", "[]"), (None, None)]
    drawn = [r[0] for r in spark.createDataFrame(shapes, "g string, c string").select(reports.geometry_svg(F.col("g"), F.col("c"))).collect()]
    assert 'd="M50.0,550.0 L750.0,550.0' in drawn[0] and drawn[0].count("<path") == 2 and reports.STYLES["hole"] in drawn[0]
    assert 'cx="50.0" cy="550.0"' in drawn[1] and drawn[2:] == ["", "", ""]
    pages = reports.html_pages("t<", spark.range(25), ["id"], rows=4).orderBy("path").collect()
    assert sum(r.rows for r in pages) == 25 and max(r.rows for r in pages) == 4 and b"t&lt;" in bytes(pages[0].content)
    said = [int(x) for r in pages for x in re.findall(rb"<td>(\d+)</td>", bytes(r.content))]
    assert said == [*range(25)]
    toml = spark.createDataFrame([("c", "m", 1.0)], "codec string, metric string, mean double").withColumns(
        {"n": F.lit(1), "std": F.lit(0.0), "min": F.lit(1.0), "max": F.lit(1.0)}
    )
    assert json.loads(reports.bench_json(toml).first()["value"]) == {"codec": "c", "metrics": {"m": {"n": 1, "mean": 1.0, "std": 0.0, "min": 1.0, "max": 1.0}}}
    page = reports.html_report("t<", {"x": spark.range(2)}, {"k": "</script>"})
    assert "t&lt;" in page and "</script>" in page and "<\\/script>" in page
    assert reports.fill_template("a {{X}}", {"X": [1]}) == "a [1]"
    with pytest.raises(KeyError):
        reports.fill_template("a", {"X": 1})


def test_small_functions(spark):
    from tilewright.functions import text

    images = {
        "a.png": write_png(np.zeros((2, 3, 4))), "b.jpg": b"\xff\xd8\xff\xe0\x00\x04zz\xff\xc0\x00\x11\x08\x00\x05\x00\x07\x03",
        "c.ktx2": b"\xabKTX 20\xbb\r\n\x1a\n" + b"\0" * 8 + struct.pack("<II", 9, 8),
        "d.webp": b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0\x03\0\0\x04\0\0", "e": b"?"
    }
    assert {r.path: (r.width, r.height) for r in image_headers(contents(spark, images)).collect()} == {
        "a.png": (3, 2), "b.jpg": (7, 5), "c.ktx2": (9, 8), "d.webp": (4, 5), "e": (None, None)
    }
    df = spark.createDataFrame([('{"a":[1,{"b":"x"}],"c":{}}',), ("no",)], "feature string")
    assert [(r.path, r.value) for r in features.flattened(df).orderBy("nth").collect()] == [(".a[0]", "1"), (".a[1].b", '"x"'), (".c", "{}")]
    one = spark.range(1)
    point = one.select(vector_tiles.to_tile_space(F.expr("array(array(0D, 0D), array(-20037508.342789244D, 10018754.171394622D))"), F.lit(1), 1)).first()[0]
    assert point == [[0.0, 1.0], [0.0, 0.5]]
    row = one.select(
        text.log_hue(F.lit(9), F.lit(0), F.lit(99)), text.legend(F.lit(0), F.lit(99)), text.hsv_rgb(F.lit(1 / 3), F.lit(1.0), F.lit(1.0)),
        text.kib(F.lit(1536)), text.bytes_short(F.lit(3 << 30)), text.bytes_text(F.lit(-2048)), text.stamp(F.expr("TIMESTAMP '2024-01-02 03:04:05'"))
    ).first()
    assert round(row[0], 6) == 120 and [round(v, 3) for v in row[1]] == [0.0, 2.162, 9.0, 30.623, 99.0] and row[2] == [0, 255, 0] and list(row)[3:] == ["1.5 KiB", "3.0 GB", "-2.00KB", "2024-01-02 03:04:05"]
    assert [
        r[0] for r in spark.createDataFrame([('{"a":{"b":[7]},"z":0}',)], "j string").select(text.dot_get(F.col("j"), ".a.b[0]")).union(spark.createDataFrame([("",)], "j string")).collect()
    ] == ["7", ""]
