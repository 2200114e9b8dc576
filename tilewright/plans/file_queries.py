"""Queries over files that are made of the tables' rows: city models, tilesets, models, tiles, rasters, archives.

Each file holds a bounded number of rows, so that there are more of them, not
larger ones, as the tables grow. The SQL tells from the rows what they hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import citygml, models, packing, rasters, tiles, vector_tiles
from tilewright.plans import cut, shared_dir, ship, tasks
from tilewright.plans.core_queries import brand_glbs, order_geometries, query
from tilewright.plans.tables import table
from tilewright.sinks import containers, files as file_sink, reports, vector_tiles as tile_sink
from tilewright.sources import archives, decode, gltf, rasters as raster_source, synthetic, tilesets, vector_tiles as tile_source, xml_nodes


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _in_order(by: str, value: Column) -> Column:
    """Values of a group, joined in the order of a key."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), value.alias("v")))), lambda x: x["v"]), "")


# City models: nested buildings with textures, one document per nation and 500 customer keys


def town_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as buildings: a part with a ring of 4 to 6 points, a wall, and a texture of both.

    Of the textures some name a polygon or a ring that is not there, or have a
    pair of coordinates too many.
    """
    c = F.col("c_custkey")
    name = c.cast("string")
    n = (4 + c % 3).cast("int")
    numbers = lambda k: F.array_join(F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("string")), " ")
    building = _text(
        '<core:cityObjectMember><bldg:Building gml:id="b', name, '"><bldg:consistsOf><bldg:BuildingPart gml:id="bp', name, '"><bldg:lod2Solid><gml:Polygon gml:id="p', name, '"><gml:exterior><gml:LinearRing gml:id="r', name, '"><gml:posList>',
        numbers(n * 3), '</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></bldg:lod2Solid></bldg:BuildingPart></bldg:consistsOf><bldg:boundedBy><bldg:WallSurface gml:id="w', name,
        '"><bldg:lod2MultiSurface><gml:Polygon gml:id="q', name, '"/></bldg:lod2MultiSurface></bldg:WallSurface></bldg:boundedBy></bldg:Building></core:cityObjectMember>',
    )
    target = F.when(c % 11 == 0, _text("zz", name)).otherwise(_text("p", name))
    ring = F.when(c % 13 == 0, _text("nr", name)).otherwise(_text("r", name))
    pairs = n + F.when(c % 10 == 0, 1).otherwise(0)
    surface = _text(
        "<app:surfaceDataMember><app:ParameterizedTexture><app:imageURI>img", c % 7, '.jpg</app:imageURI><app:target uri="#', target, '"><app:TexCoordList><app:textureCoordinates ring="#', ring, '">', numbers((pairs * 2).cast("int")),
        '</app:textureCoordinates></app:TexCoordList></app:target><app:target uri="#q', name, '"/></app:ParameterizedTexture></app:surfaceDataMember>',
    )
    docs = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(c / 500).alias("part")).agg(
        _in_order("c_custkey", building).alias("buildings"), _in_order("c_custkey", surface).alias("surfaces")
    )
    head = '<core:CityModel xmlns:core="urn:c" xmlns:bldg="urn:b" xmlns:gml="http://www.opengis.net/gml" xmlns:app="urn:a">'
    whole = _text(head, F.col("buildings"), "<app:appearanceMember><app:Appearance>", F.col("surfaces"), "</app:Appearance></app:appearanceMember></core:CityModel>")
    return docs.select(_text("udx/n", F.col("c_nationkey"), "-", F.col("part"), ".gml").alias("path"), F.encode(whole, "utf-8").alias("content"))


def town_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(xml_nodes.read_nodes(town_documents(spark, sf_dir)), "town-nodes")


def town_wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five customers one is wanted whole, one as its part, one as a polygon, and two not at all."""
    c = F.col("c_custkey")
    wish = F.when(c % 5 == 0, _text("b", c)).when(c % 5 == 1, _text("bp", c)).when(c % 5 == 2, _text("p", c))
    return table(spark, sf_dir, "customer").select(wish.alias("id")).where("id IS NOT NULL")


def town_subset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = town_nodes(spark, sf_dir)
    return nodes, citygml.keep_objects(nodes, town_wishes(spark, sf_dir))


_TOWN = "WITH t AS (SELECT *, 'udx/n' || c_nationkey || '-' || (c_custkey // 500) || '.gml' AS path FROM customer)"


@query(f"""{_TOWN}
SELECT path, k || c_custkey AS gml_id FROM t, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['b', 'bp', 'p', 'r', 'w', 'q'] WHEN c_custkey % 5 < 3 THEN ['b', 'bp', 'p', 'r'] ELSE [] END) AS u(k)
""")
def subset_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return town_subset(spark, sf_dir)[1].where("gml_id IS NOT NULL").select("path", "gml_id")


@query(f"{_TOWN} SELECT path, count(*) FILTER (c_custkey % 5 < 3) AS kept, count(*) FILTER (c_custkey % 5 >= 3) AS removed FROM t GROUP BY path")
def subset_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citygml.member_counts(*town_subset(spark, sf_dir))


@query(f"""{_TOWN}
SELECT path, '#p' || c_custkey AS uri FROM t WHERE c_custkey % 5 < 3 AND c_custkey % 11 <> 0 UNION ALL SELECT path, '#q' || c_custkey FROM t WHERE c_custkey % 5 = 0
""")
def subset_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citygml.keep_appearances(town_subset(spark, sf_dir)[1]).where("local = 'target'").select("path", F.col("attrs")["uri"].alias("uri"))


@query(f"""{_TOWN}
SELECT DISTINCT path, 'udx/img' || (c_custkey % 7) || '.jpg' AS image FROM t WHERE c_custkey % 5 = 0 OR (c_custkey % 5 < 3 AND c_custkey % 11 <> 0)
""")
def subset_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citygml.referenced_images(citygml.keep_appearances(town_subset(spark, sf_dir)[1]))


#: Ids that the archive's subset asks for in the first document of each nation.
_ASKED = [f"b{i}" for i in range(60)]


@query(f"""{_TOWN}, k AS (SELECT * FROM t WHERE c_custkey < 60)
SELECT 'artifacts' AS place, 'codelists/a.xml' AS path, CAST(NULL AS BIGINT) AS buildings, CAST(NULL AS BIGINT) AS targets FROM (SELECT 1 WHERE EXISTS (FROM customer))
UNION ALL SELECT 'testcase', path, count(*) FILTER (c_custkey < 60), count(*) FILTER (c_custkey < 60) + count(*) FILTER (c_custkey < 60 AND c_custkey % 11 <> 0) FROM t WHERE c_custkey // 500 = 0 GROUP BY path
UNION ALL SELECT DISTINCT 'testcase', 'udx/img' || (c_custkey % 7) || '.jpg', NULL::BIGINT, NULL::BIGINT FROM k
UNION ALL SELECT DISTINCT 'testcase', 'udx/dem/x' || c_nationkey || '.gml', NULL::BIGINT, NULL::BIGINT FROM t WHERE CAST(c_nationkey AS VARCHAR) LIKE '1%'
""")
def subset_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive per document, cut down as a whole task and read again."""
    docs = town_documents(spark, sf_dir).withColumn("archive", F.regexp_replace("path", r"^udx/(.*)\.gml$", "$1.zip"))
    same = F.array(
        *(F.struct(F.lit(p).alias("path"), F.lit(v.encode()).alias("content")) for p, v in [("codelists/a.xml", "<a/>")] + [(f"udx/img{i}.jpg", f"{i}") for i in range(7)])
    )
    beside = docs.select(
        "archive",
        F.inline(F.array_append(same, F.struct(_text("udx/dem/x", F.regexp_extract("path", r"n(\d+)-", 1), ".gml").alias("path"), F.lit(b"<x/>").alias("content"))))
    )
    zips = containers.zip_archives(docs.select("archive", "path", "content").unionByName(beside))
    tree = {f"udx/n{k}-0.gml": _ASKED for k in range(25)} | {"udx/dem/": ["x1"]}
    got = cut(tasks.subset_citygml(spark, zips, tree), "subset-files")
    again = xml_nodes.read_nodes(got.where("path LIKE 'udx/n%.gml'")).groupBy("path").agg(
        F.count_if(F.col("local") == "Building").alias("buildings"), F.count_if(F.col("local") == "target").alias("targets")
    )
    return got.select("place", "path").join(again, "path", "left")


@query(f"""{_TOWN}, f AS (SELECT path, CASE WHEN c_custkey % 11 = 0 THEN 'zz' ELSE 'p' END || c_custkey AS target, CASE WHEN c_custkey % 13 = 0 THEN 'nr' ELSE 'r' END || c_custkey AS ring, 4 + c_custkey % 3 + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS uv_pairs,
  CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 THEN 4 + c_custkey % 3 END AS vertices, c_custkey AS c FROM t)
SELECT path, target, ring, CAST(uv_pairs AS INTEGER) AS uv_pairs, CAST(vertices AS INTEGER) AS vertices, CASE WHEN c % 11 = 0 THEN 'no_polygon' WHEN c % 13 = 0 THEN 'no_ring' WHEN uv_pairs <> vertices THEN 'count_mismatch' ELSE 'ok' END AS finding FROM f
""")
def alignment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citygml.alignment_findings(town_nodes(spark, sf_dir)).drop("at")


@query(f"""{_TOWN}
SELECT path, CAST(2 * count(*) AS BIGINT) AS polygons, count(*) AS textures, count(*) FILTER (c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 10 = 0) AS errors, CAST(0 AS BIGINT) AS warnings FROM t GROUP BY ROLLUP (path)
""")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citygml.alignment_summary(town_nodes(spark, sf_dir))


@query(f"{_TOWN} SELECT path, 'p' || c_custkey AS polygon, 'r' || c_custkey AS ring, CAST(4 + c_custkey % 3 AS INTEGER) AS vertices FROM t")
def polygon_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citygml.rings(town_nodes(spark, sf_dir))


@query(f"{_TOWN} SELECT path, k || c_custkey AS gml_id, l AS local FROM t, (VALUES ('b', 'Building'), ('bp', 'BuildingPart'), ('w', 'WallSurface')) AS v(k, l)")
def sub_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return town_nodes(spark, sf_dir).where(citygml.is_subfeature()).select("path", "gml_id", "local")


@query("SELECT 's' || s_suppkey AS path, p AS prefix, u AS uri FROM supplier, (VALUES ('_default', 'urn:d' || s_suppkey), ('p', 'urn:b' || s_suppkey)) AS v(p, u)")
def document_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    docs = table(spark, sf_dir, "supplier").select(
        _text("s", k).alias("path"),
        F.encode(_text('<a xmlns="urn:d', k, '" xmlns:p="urn:x"><p:b xmlns:p="urn:b', k, '"/></a>'), "utf-8").alias("content")
    )
    return xml_nodes.read_namespaces(docs).select("path", F.explode("namespaces").alias("prefix", "uri"))


@query("SELECT 'm' || s_suppkey AS path, 'one ' || s_suppkey || '|b:two|c:|tail of c' AS said FROM supplier")
def mixed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text before, between and after child elements, written and read again."""
    k = F.col("s_suppkey")
    docs = table(spark, sf_dir, "supplier").select(_text("m", k).alias("path"), F.encode(_text("<a>one ", k, "<b>two</b><c/>tail of c</a>"), "utf-8").alias("content"))
    nodes = cut(xml_nodes.read_nodes(containers.write_xml(xml_nodes.read_nodes(docs))), "mixed")
    said = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pre", "local", "text", "tail"))),
            lambda n: F.concat(
                F.when(n["pre"] > 0, F.concat(n["local"], F.lit(":"))).otherwise(""),
                F.trim(F.regexp_replace(F.coalesce(n["text"], F.lit("")), r"\s+$", "")),
                F.coalesce(F.concat(F.lit("|"), F.regexp_replace(n["tail"], r"^\s+|\s+$", "")), F.lit(""))
            )
        ),
        "|"
    )
    return nodes.groupBy("path").agg(said.alias("said"))


@query("""
SELECT 'face' || i AS polygon, printf('appearance/wall_%05d.png', i) AS texture, '35.001 135.001 1.0' AS upper FROM range(64) AS r(i)
""")
def generated_walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up model of walls that lie on one another, read again; it needs no table."""
    nodes = cut(xml_nodes.read_nodes(synthetic.wall_case(spark).where("path LIKE '%.gml'")), "walls")
    upper = nodes.where("local = 'upperCorner'").select("path", F.col("text").alias("upper"))
    return citygml.texture_targets(nodes).join(upper, "path").select("polygon", "texture", "upper")


# Tilesets: parts as content cells of an implicit quadtree with subtrees of two levels


_LEVELS, _SLOTS = 2, 3


def _subtree(key: tuple, frame):  # noqa: ANN001, ANN202
    """A subtree file of one root's cells (rel, rx, ry, slot) and children (rel null); runs on the executors."""
    import json
    import struct

    import pandas as pd

    spread = lambda v: (v & 1) | (v & 2) << 1 | (v & 4) << 2
    own = frame[frame["rel"].notna()]
    index = [((1 << 2 * int(rel)) - 1) // 3 + (spread(int(x)) | spread(int(y)) << 1) for rel, x, y in zip(own["rel"], own["rx"], own["ry"], strict=True)]
    child = frame[frame["rel"].isna()]
    bits = [set(index)] + [
        {i for i, s in zip(index, own["slot"], strict=True) if s == slot} for slot in range(_SLOTS)
    ] + [{spread(int(x)) | spread(int(y)) << 1 for x, y in zip(child["rx"], child["ry"], strict=True)}]
    streams = [sum(1 << i for i in b).to_bytes(2, "little") for b in bits]
    views = [{"byteOffset": 8 * i, "byteLength": 2} for i in range(len(streams))]
    doc = {
        "bufferViews": views, "tileAvailability": {"bitstream": 0}, "contentAvailability": [{"bitstream": 1 + s} for s in range(_SLOTS)],
        "childSubtreeAvailability": {"bitstream": 1 + _SLOTS}
    }
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 8)
    binary = b"".join(s.ljust(8, b"\0") for s in streams)
    level, x, y = key
    return pd.DataFrame({"path": [f"/t/s/{level}.{x}.{y}.subtree"], "content": [struct.pack("<4sIQQ", b"subt", 1, len(text), len(binary)) + text + binary]})


def part_tileset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tileset, subtree files, listing): some subtree and content files are missing."""
    ship(spark)
    level = (F.col("p_size") % 4).cast("int")
    n = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    part = table(spark, sf_dir, "part").select(
        level.alias("level"), (F.col("p_partkey") % n).alias("x"), (F.floor(F.col("p_partkey") / 8) % n).alias("y"),
        (F.col("p_partkey") % _SLOTS).cast("int").alias("slot"), "p_size", "p_retailprice"
    )
    cells = cut(part.groupBy("level", "x", "y", "slot").agg(F.sum("p_size").alias("features"), F.sum(F.floor("p_retailprice")).alias("size")), "cells")
    root_level = F.floor(F.col("level") / _LEVELS).cast("int") * _LEVELS
    rel = F.col("level") - root_level
    rooted = cells.select(
        root_level.alias("level"), F.expr("shiftright(x, level % 2)").alias("x"), F.expr("shiftright(y, level % 2)").alias("y"), rel.alias("rel"),
        F.expr("x & (shiftleft(1, level % 2) - 1)").alias("rx"), F.expr("y & (shiftleft(1, level % 2) - 1)").alias("ry"), "slot"
    )
    children = rooted.where("level = 2").select("x", "y").distinct().select(
        F.lit(0).alias("level"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.lit(None).cast("int").alias("rel"),
        F.col("x").alias("rx"), F.col("y").alias("ry"), F.lit(None).cast("int").alias("slot")
    )
    children = children.withColumnsRenamed({"x0": "x", "y0": "y"})
    files = rooted.unionByName(children).groupBy("level", "x", "y").applyInPandas(_subtree, "path string, content binary")
    kept = files.where("path = '/t/s/0.0.0.subtree' OR (CAST(regexp_extract(path, '2\\\\.(.)', 1) AS INT) + CAST(regexp_extract(path, '2\\\\..\\\\.(.)', 1) AS INT)) % 4 <> 3")
    listing = cells.where("(x + y + slot) % 7 <> 6").select(
        _text("/t/c", F.col("slot"), "/", F.col("level"), "/", F.col("x"), "/", F.col("y"), ".glb").alias("path"), "size", "features"
    )
    text = '{"root":{"boundingVolume":{"region":[2.42,0.6,2.46,0.64,0,9]},"contents":[{"uri":"c0/{level}/{x}/{y}.glb"},{"uri":"c1/{level}/{x}/{y}.glb"},{"uri":"c2/{level}/{x}/{y}.glb"}],"implicitTiling":{"subtreeLevels":2,"subtrees":{"uri":"s/{level}.{x}.{y}.subtree"}}}}'
    return tilesets.parse_tileset(spark.createDataFrame([(text,)], "value string")), kept, listing


_TILESET = """
WITH c AS (SELECT p_size % 4 AS level, p_partkey % (1 << (p_size % 4)) AS x, (p_partkey // 8) % (1 << (p_size % 4)) AS y, p_partkey % 3 AS slot, CAST(sum(p_size) AS BIGINT) AS features, CAST(sum(floor(p_retailprice)) AS BIGINT) AS size FROM part GROUP BY ALL),
r AS (SELECT *, x >> (level % 2) AS sx, y >> (level % 2) AS sy, (x + y + slot) % 7 <> 6 AS listed, 'c' || slot || '/' || level || '/' || x || '/' || y || '.glb' AS uri FROM c),
w AS (SELECT * FROM r WHERE level < 2 OR (sx + sy) % 4 <> 3)
"""


@query(_TILESET + "SELECT CAST(level AS INTEGER) AS level, x, y, CAST(slot AS INTEGER) AS slot, size, features, uri, round(degrees(2.42 + x * (0.04 / pow(2, level))), 6) AS west FROM w WHERE listed")
def tileset_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, files, listing = part_tileset(spark, sf_dir)
    found, _ = tiles.walk_tileset(spec, cut(tilesets.read_subtrees(files), "subtree-rows"), listing, "/t")
    return found.withColumn("west", F.round("region.west", 6)).drop("region")


@query(_TILESET + """
SELECT 'missing content file' AS warning, uri FROM w WHERE NOT listed UNION ALL SELECT DISTINCT 'missing subtree file', 's/2.' || sx || '.' || sy || '.subtree' FROM r WHERE level >= 2 AND (sx + sy) % 4 = 3
""")
def tileset_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, files, listing = part_tileset(spark, sf_dir)
    return tiles.walk_tileset(spec, cut(tilesets.read_subtrees(files), "subtree-rows"), listing, "/t")[1]


@query("SELECT p_partkey, k AS i, (p_size >> (k % 8)) & 1 AS bit FROM part, unnest(range(8)) AS u(k)")
def bit_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.functions.tiles import bit_at

    rows = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.lpad(F.hex("p_size"), 2, "0")).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("i"), bit_at(F.col("b"), F.col("i")).alias("bit"))


@query("""
WITH w AS (SELECT 'missing ' || CASE WHEN p_size % 2 = 0 THEN 'glb' ELSE 'subtree' END AS warning, p_partkey FROM part)
SELECT warning, p_partkey, (SELECT greatest(count(*) - 50, 0) FROM w) AS more FROM w ORDER BY p_partkey LIMIT 50
""")
def first_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first fifty warnings and how many more there are."""
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("missing "), F.when(F.col("p_size") % 2 == 0, "glb").otherwise("subtree")).alias("warning"), "p_partkey")
    top, more = tiles.first_with_rest(rows, ["p_partkey"], 50)
    return top.withColumn("more", F.lit(more).cast("long"))


# Models


def brand_b3dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands' GLBs within the old container, with their part keys as a batch table."""
    keys = table(spark, sf_dir, "part").groupBy(
        F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 5000).cast("string")).alias("name")
    ).agg(F.array_sort(F.collect_list("p_partkey")).alias("id"))
    glbs = brand_glbs(spark, sf_dir).withColumnsRenamed({"path": "_path", "content": "glb"})
    rows = keys.join(glbs, F.concat("name", F.lit(".glb")) == F.col("_path"))
    feature = _text('{"BATCH_LENGTH":', F.size("id"), "}")
    batch = F.to_json(F.struct("id", F.col("name").alias("brand"), F.size("id").alias("n")))
    return rows.select(_text(F.col("name"), ".b3dm").alias("path"), _b3dm(F.encode(feature, "utf-8"), F.encode(batch, "utf-8"), F.col("glb")).alias("content"))


def _b3dm(feature: Column, batch: Column, glb: Column) -> Column:
    """Header, both JSON tables padded by blanks, and the model."""
    number = lambda n: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n.cast("long")), 8, "0"), F.lit("(..)"), F.lit(1))), ""))
    padded = lambda b: F.concat(b, F.encode(F.repeat(F.lit(" "), F.pmod(8 - F.octet_length(b) % 8, F.lit(8))), "utf-8"))
    f, b = padded(feature), padded(batch)
    total = F.lit(28) + F.octet_length(f) + F.octet_length(b) + F.octet_length(glb)
    zero = F.lit(0)
    return F.concat(F.lit(b"b3dm"), number(F.lit(1)), number(total), number(F.octet_length(f)), number(zero), number(F.octet_length(b)), number(zero), f, b, glb)


_BRANDS = "WITH b AS (SELECT p_brand || '-' || (p_partkey // 5000) AS name, count(*) AS n, '[' || string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) || ']' AS ids FROM part GROUP BY 1)"


@query(f"""{_BRANDS}, j AS (SELECT *, '{{"BATCH_LENGTH":' || n || '}}' AS f, '{{"id":' || ids || ',"brand":"' || name || '","n":' || n || '}}' AS b FROM b)
SELECT name || '.b3dm' AS path, CAST(1 AS BIGINT) AS version, f AS feature_json, b AS batch_json, CAST(ceil(strlen(f) / 8.0) * 8 AS BIGINT) AS feature_json_length, CAST(28 + ceil(strlen(f) / 8.0) * 8 + ceil(strlen(b) / 8.0) * 8 AS BIGINT) AS overhead FROM j
""")
def b3dm_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gltf.read_b3dm(brand_b3dms(spark, sf_dir))
    return rows.select("path", "version", "feature_json", "batch_json", "feature_json_length", (F.col("byte_length") - F.col("gltf_length")).alias("overhead"))


@query(f"{_BRANDS} SELECT name || '.b3dm' AS path, k AS property, v AS values FROM b, (VALUES ('id', CAST(n AS VARCHAR)), ('brand', 'string'), ('n', 'bigint')) AS u(k, v)")
def b3dm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.batch_table(gltf.read_b3dm(brand_b3dms(spark, sf_dir)))


@query(f"{_BRANDS} SELECT name || '.b3dm' AS path, CAST(2 AS BIGINT) AS version, CAST(n AS BIGINT) AS features FROM b")
def b3dm_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = gltf.read_b3dm(brand_b3dms(spark, sf_dir)).selectExpr("path", "glb AS content")
    return gltf.read_glb(inner).select("path", "version", tiles.feature_count().alias("features"))


@query("SELECT 'f' || p_partkey AS path, CAST(floor(p_retailprice) AS BIGINT) AS byte_length, CAST(p_size AS BIGINT) AS gltf_length, round(p_size / floor(p_retailprice) * 100, 1) AS percent FROM part")
def payload_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        _text("f", F.col("p_partkey")).alias("path"), F.floor("p_retailprice").alias("byte_length"), F.col("p_size").cast("long").alias("gltf_length")
    )
    return models.payload_share(rows)


def _image_glb(key, frame):  # noqa: ANN001, ANN202
    """A GLB with an image per supplier: in BIN, as a data URI, or beside the file; runs on the executors."""
    import base64
    import json

    import pandas as pd

    rows = frame.sort_values("s_suppkey")
    binary, views, images = b"", [], []
    for k, name in zip(rows["s_suppkey"], rows["s_name"], strict=True):
        data, image = name.encode(), {"name": f"n{k}"} if k % 2 == 0 else {}
        if k % 3 == 0:
            views.append({"byteLength": len(data)} | ({"byteOffset": len(binary)} if binary else {}))
            binary += data
            image["bufferView"] = len(views) - 1
        elif k % 3 == 1:
            image |= {"uri": "data:image/jpeg;base64," + base64.b64encode(data).decode(), "mimeType": "image/jpeg"}
        else:
            image |= {"uri": f"t{k}.webp", "mimeType": "image/webp"}
        images.append(image)
    return pd.DataFrame({"path": [f"m/{key[0]}.glb"], "content": [containers.build_glb(json.dumps({"bufferViews": views, "images": images}), binary)]})


def supplier_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    supplier = table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", F.concat_ws("-", F.col("s_nationkey").cast("string"), F.floor(F.col("s_suppkey") / 1000).cast("string")).alias("name")
    )
    glbs = cut(supplier.groupBy("name").applyInPandas(_image_glb, "path string, content binary"), "image-glbs")
    beside = supplier.where("s_suppkey % 3 = 2").select(_text("m/t", F.col("s_suppkey"), ".webp").alias("path"), F.encode("s_name", "utf-8").alias("content"))
    return gltf.with_external_images(gltf.glb_images(glbs), beside)


_IMAGES = """
WITH s AS (SELECT *, s_nationkey || '-' || (s_suppkey // 1000) AS file, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 1000 ORDER BY s_suppkey) - 1 AS nth FROM supplier),
i AS (SELECT 'm/' || file || '.glb' AS path, file, CAST(nth AS INTEGER) AS nth, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_suppkey ELSE 'texture_' || nth END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'image/webp' END AS mime, s_name FROM s)
"""


@query(_IMAGES + "SELECT path, nth, name, mime, md5(s_name) AS digest FROM i")
def glb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_images(spark, sf_dir).select("path", "nth", "name", "mime", F.md5("data").alias("digest"))


@query(_IMAGES + "SELECT file || '-' || name || '.' || split_part(mime, '/', 2) AS path, md5(s_name) AS digest FROM i")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.image_files(supplier_images(spark, sf_dir)).select("path", F.md5("content").alias("digest"))


@query(_IMAGES + "SELECT path, name, mime, CAST(strlen(s_name) AS INTEGER) AS bytes, to_base64(encode(s_name)) AS b64 FROM i")
def image_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.image_payloads(supplier_images(spark, sf_dir))


def _vertex_glb(key, frame):  # noqa: ANN001, ANN202
    """A GLB whose vertices are lines, with their part's remainder as feature id; runs on the executors."""
    import json

    import numpy as np
    import pandas as pd

    rows = frame.sort_values(["l_orderkey", "l_linenumber", "l_partkey"])
    ids = (rows["l_partkey"] % 40).to_numpy("<u2").tobytes()
    names = [f"t{i % 5}".encode() for i in range(40)]
    parts = [b"".join(names), np.cumsum([0, *map(len, names)]).astype("<u4").tobytes(), ids]
    starts = [sum(map(len, parts[:i])) for i in range(3)]
    doc = {
        "bufferViews": [{"byteOffset": a, "byteLength": len(p)} for a, p in zip(starts, parts, strict=True)], "accessors": [{"bufferView": 2, "componentType": 5123, "count": len(rows)}],
        "meshes": [{"primitives": [{"attributes": {"_FEATURE_ID_0": 0}}, {"attributes": {}}]}],
        "extensions": {"EXT_structural_metadata": {"propertyTables": [{"count": 40, "properties": {"feature_type": {"values": 0, "stringOffsets": 1}}}]}},
    }
    return pd.DataFrame({"path": [f"v{key[0]}.glb"], "content": [containers.build_glb(json.dumps(doc), b"".join(parts))]})


def line_glbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_orderkey") / 2000).alias("name"))
    return line.groupBy("name").applyInPandas(_vertex_glb, "path string, content binary")


@query("SELECT 'v' || (l_orderkey // 2000) || '.glb' AS path, count(*) AS vertices, CAST(sum(CASE WHEN (l_partkey % 40) % 5 IN (0, 2) THEN 65535 ELSE l_partkey % 40 END) AS BIGINT) AS ids FROM lineitem GROUP BY 1")
def masked_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with two feature types masked, written and read again."""
    masked = cut(tasks.mask_glbs(cut(line_glbs(spark, sf_dir), "line-glbs"), ["t0", "t2"]), "masked")
    return gltf.glb_feature_ids(masked).groupBy("path").agg(F.count("*").alias("vertices"), F.sum("feature_id").alias("ids"))


@query(f"{_BRANDS} SELECT name || '.glb' AS path, '{{\"n\":' || n || '}}' AS json, true AS same_bin FROM b")
def replaced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with another JSON chunk, loaded from files beside them; BIN stays as it was."""
    glbs = cut(brand_glbs(spark, sf_dir), "brand-glbs")
    dumped = tasks.dump_glb_json(glbs).select(
        "path",
        F.encode(_text('{ "n" : ', F.get_json_object(F.decode("content", "utf-8"), "$.extensions.EXT_structural_metadata.propertyTables[0].count"), " }"), "utf-8").alias("content")
    )
    new = gltf.read_glb(tasks.load_glb_json(glbs.unionByName(dumped)))
    old = gltf.read_glb(glbs).select("path", F.col("bin").alias("_bin"))
    return new.join(old, "path").select("path", "json", (F.col("bin") == F.col("_bin")).alias("same_bin"))


@query("SELECT 'b' || s_suppkey AS path, s_suppkey % 5 AS kind FROM supplier")
def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut off or of another kind are a row with an error for every decoder, never the end of a job."""
    k = F.col("s_suppkey")
    broken = table(spark, sf_dir, "supplier").select(
        _text("b", k).alias("path"),
        F.when(
            k % 3 == 0, F.unhex(F.lit("676C5446020000002000000008000000"))
        ).when(k % 3 == 1, F.encode(F.lit("not a file of any kind"), "utf-8")).otherwise(F.lit(b"PK\x05\x06")).alias("content"),
        (k % 5).alias("kind")
    )
    decoders = [gltf.glb_images, gltf.glb_properties, gltf.glb_feature_ids, archives.zip_listing, lambda c: raster_source.read_depth(c)]
    found = [d(broken.where(F.col("kind") == i)).where("error IS NOT NULL").select("path", F.lit(i).cast("long").alias("kind")) for i, d in enumerate(decoders)]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


# Vector tiles


def order_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile per 1000 order keys: points, lines and polygons of as many points as an order has lines; some have no geometry, some no id."""
    k = F.col("nth")
    rows = order_geometries(spark, sf_dir).where("gtype IS NULL OR gtype NOT LIKE 'Multi%'")
    props = F.when(k % 4 != 0, F.create_map(F.lit("gml_id"), _text("o", k))).otherwise(F.create_map().cast("map<string,string>"))
    nth = F.floor(F.col("nth") % 1000)
    return rows.select(
        _text("t/", F.floor(k / 1000), "/1/2.mvt").alias("path"), "layer", nth.alias("nth"), "gtype",
        F.when(F.col("gtype") == "Point", F.get(F.from_json("coordinates", "array<string>"), F.lit(0))).otherwise(F.coalesce("coordinates", F.lit("[]"))).alias("coordinates"),
        props.alias("props")
    )


_TILES = """
WITH g AS (SELECT o_orderkey AS k, o_orderkey % 6 AS kind, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT k, n, 't/' || (k // 1000) || '/1/2.mvt' AS path, 'layer' || (k % 3) AS layer, CASE WHEN k % 50 = 0 THEN NULL WHEN kind = 0 THEN 'Point' WHEN kind = 1 THEN 'LineString' ELSE 'Polygon' END AS gtype, kind FROM g WHERE kind IN (0, 1, 2, 5) OR k % 50 = 0),
m AS (SELECT *, row_number() OVER (PARTITION BY path, layer ORDER BY k) - 1 AS nth FROM r),
v AS (SELECT *, CASE WHEN gtype IS NULL THEN 'null geometry' WHEN kind = 0 AND n = 0 THEN 'empty point' WHEN kind = 1 AND n < 2 THEN 'linestring with ' || n || ' points'
  WHEN kind = 5 OR (kind = 2 AND n = 0) THEN 'empty polygon' WHEN kind = 2 AND n = 1 THEN 'polygon ring 0 has 2 points (need >= 3)' END AS reason FROM m)
"""


@query(_TILES + "SELECT path, layer, CAST(nth AS INTEGER) AS nth, CASE WHEN k % 4 <> 0 THEN 'o' || k ELSE '<no gml_id #' || nth || '>' END AS gml_id, gtype, reason FROM v WHERE reason IS NOT NULL")
def mvt_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tiles.mvt_findings(tile_source.read_mvt(tile_sink.write_mvt(order_tiles(spark, sf_dir))))


@query(_TILES + "SELECT path, layer, gtype, count(*) AS n FROM v WHERE gtype IS NOT NULL GROUP BY ALL")
def mvt_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tiles.type_counts(tile_source.read_mvt(tile_sink.write_mvt(order_tiles(spark, sf_dir))))


@query(_TILES + "SELECT path, layer, count(*) AS invalid FROM v WHERE reason IS NOT NULL GROUP BY ALL")
def mvt_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tiles.invalid_counts(vector_tiles.mvt_findings(tile_source.read_mvt(tile_sink.write_mvt(order_tiles(spark, sf_dir)))))


@query(_TILES + """
SELECT path, layer, gtype, count(*) AS n_a, count(*) FILTER (k % 7 <> 0) AS n_b FROM v WHERE gtype IS NOT NULL GROUP BY ALL HAVING n_a <> n_b
""")
def mvt_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of the same tiles, one without every seventh order."""
    rows = cut(order_tiles(spark, sf_dir).withColumn("k", F.col("nth") + 1000 * F.regexp_extract("path", r"t/(\d+)/", 1).cast("long")), "order-tiles")
    read = lambda df: tile_source.read_mvt(tile_sink.write_mvt(df))
    return vector_tiles.compare_tiles(read(rows), read(rows.where("k % 7 <> 0")))


# Rasters


def _depth_png(key, frame):  # noqa: ANN001, ANN202
    """A picture of 20 pixels a row whose four bytes a pixel are a float; pixels without an order are no hit; runs on the executors."""
    import numpy as np
    import pandas as pd

    depth = np.full(400, np.nan, "<f4")
    depth[frame["at"].to_numpy()] = frame["d"].to_numpy("<f4")
    rgba = np.ascontiguousarray(depth.reshape(20, 20)).view(np.uint8).reshape(20, 20, 4)
    return pd.DataFrame({"path": [f"{key[0]}.png"], "content": [raster_source.write_png(rgba)]})


def order_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.floor(k / 400).alias("name"), (k % 400).cast("int").alias("at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", float("inf")).otherwise(F.col("o_totalprice")).cast("float").alias("d")
    )
    return rows.groupBy("name").applyInPandas(_depth_png, "path string, content binary")


@query("""
SELECT (o_orderkey // 400) || '.png' AS path, CAST(20 AS INTEGER) AS height, CAST(20 AS INTEGER) AS width, CAST((o_orderkey % 400) // 20 AS INTEGER) AS y, CAST(o_orderkey % 20 AS INTEGER) AS x, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS depth
FROM orders WHERE o_orderpriority <> '1-URGENT'
""")
def depth_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = raster_source.read_depth(order_pictures(spark, sf_dir))
    return pixels.where("NOT isnan(depth) AND abs(depth) < double('inf')").select("path", "height", "width", "y", "x", F.col("depth").cast("double").alias("depth"))


@query("""
SELECT DISTINCT (o_orderkey // 400) || '-diff.png' AS path, CAST(20 AS INTEGER) AS width, CAST(20 AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS error FROM orders
""")
def diff_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of the difference between each raster and itself a little deeper, and the sizes that their headers tell."""
    pixels = cut(raster_source.read_depth(order_pictures(spark, sf_dir)), "pixels")
    deeper = pixels.withColumn("depth", F.col("depth") + 10)
    diff = rasters.diff_pixels(pixels, deeper, 100.0, ["path", "y", "x"]).withColumn("path", F.regexp_replace("path", r"\.png$", "-diff.png"))
    return raster_source.image_headers(containers.diff_pictures(diff)).drop("bytes")


# Archives


def document_zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        _text("z", F.floor(k / 500), ".zip").alias("archive"), _text("d", k % 3, "/", k, ".txt").alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")
    )
    return containers.zip_archives(rows)


@query("SELECT 'z' || (doc_id // 500) || '.zip' AS archive, 'd' || (doc_id % 3) || '/' || doc_id || '.txt' AS path, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 3 <> 1")
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of two of three folders, chosen before they are unpacked."""
    return archives.zip_members(document_zips(spark, sf_dir), ["d0/", "d2/"]).select("archive", "path", F.md5("content").alias("digest"))


@query("""
SELECT 'z' || (doc_id // 500) || '.zip' AS archive, 'd' || (doc_id % 3) || '/' || doc_id || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, CASE WHEN doc_id % 10 = 7 THEN md5(coalesce(text, '')) END AS digest FROM documents
""")
def remote_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives in a file system, listed and read by byte ranges: only wanted members are fetched."""
    root = f"{shared_dir(spark)}/zips-{uuid.uuid4().hex}"
    written = cut(file_sink.write_files(document_zips(spark, sf_dir), root), "written")
    found = archives.remote_members(written.select(_text(f"{root}/", F.col("path")).alias("archive")), r"7\.txt$", archives.file_ranges)
    return found.where("error IS NULL").select(F.substring_index("archive", "/", -1).alias("archive"), "path", "size", F.md5("content").alias("digest"))


@query("""
WITH r AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'bldg' || (page_id // 200) WHEN page_id % 3 = 1 THEN 'tran' || (page_id // 200) || '_lod1' ELSE 'misc' || (page_id // 200) END AS dir, page_id, page_id % 3 AS k FROM pages),
f AS (SELECT dir, CASE k WHEN 0 THEN 'c/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.glb' ELSE '.b3dm' END WHEN 1 THEN page_id || '/1/2.mvt' ELSE page_id || '.txt' END AS path, k FROM r),
t AS (SELECT dir, path, k FROM f UNION ALL SELECT DISTINCT dir, 'metadata.json', k FROM f UNION ALL SELECT DISTINCT dir, 'tilejson.json', k FROM f),
g AS (SELECT dir, bool_or(path LIKE '%.glb') AS has FROM f GROUP BY 1)
SELECT CASE k WHEN 0 THEN 'city_op_' || dir || '_3dtiles.zip' ELSE 'city_op_' || replace(dir, '_lod1', '') || '_mvt_lod1.zip' END AS archive, path AS member FROM t JOIN g USING (dir) WHERE k < 2 AND path NOT LIKE '%.b3dm' AND (k = 1 OR has)
""")
def packed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output folders as archives named by their format, each with the TileJSON of its metadata."""
    k, part = F.col("page_id") % 3, F.floor(F.col("page_id") / 200)
    folder = F.when(k == 0, _text("bldg", part)).when(k == 1, _text("tran", part, "_lod1")).otherwise(_text("misc", part))
    path = F.when(
        k == 0, F.concat(F.lit("c/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".glb").otherwise(".b3dm"))
    ).when(k == 1, _text(F.col("page_id"), "/1/2.mvt")).otherwise(_text(F.col("page_id"), ".txt"))
    rows = table(spark, sf_dir, "pages").select(folder.alias("dir"), path.alias("path"), F.encode("url", "utf-8").alias("content"))
    metadata = rows.select("dir").distinct().select(
        "dir", F.lit("metadata.json").alias("path"),
        F.lit(b'{"json":"{\\"vector_layers\\":[{\\"id\\":\\"l\\"}]}","bounds":"1,2,3,4","center":"1,2,3"}').alias("content")
    )
    zips = tasks.pack_outputs(cut(rows.unionByName(metadata), "outputs"), "city_op_1.zip")
    return archives.zip_listing(zips).select(F.col("path").alias("archive"), "member")


@query("""
SELECT path, CASE WHEN k = 0 THEN 'artifacts/' || n WHEN k = 1 THEN 'runtime/log/' || n END AS moved_to, (SELECT count(*) FROM (SELECT 1 FROM pages WHERE page_id % 3 < 2 LIMIT 1)) AS jobs
FROM (SELECT page_id % 3 AS k, page_id AS n, CASE page_id % 3 WHEN 0 THEN 'run/jobs/j1/artifacts/' WHEN 1 THEN 'run/jobs/j1/log/' ELSE 'run/other/' END || page_id AS path FROM pages)
""")
def relocated_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").select(
        F.concat(F.when(k == 0, "run/jobs/j1/artifacts/").when(k == 1, "run/jobs/j1/log/").otherwise("run/other/"), F.col("page_id").cast("string")).alias("path")
    )
    return packing.relocated(rows)


@query("SELECT DISTINCT 'a/' || (page_id % 40) || '/tileset.json' AS path FROM pages WHERE page_id % 3 = 0 AND EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 40 = pages.page_id % 40 AND p.page_id % 3 = 1)")
def upgradable_tilesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("page_id") % 40, F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").select(
        F.when(k == 0, _text("a/", n, "/tileset.json")).when(
            k == 1, _text("a/", n, "/deep/x/", F.col("page_id"), ".b3dm")
        ).otherwise(_text("a/", n, "/", F.col("page_id"), ".glb")).alias("path")
    )
    return packing.upgradable(rows.distinct())


@query("""
SELECT name, CASE WHEN is_dir THEN 'pack' WHEN NOT ends_with(name, '.csv') THEN 'copy' END AS step FROM (SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.csv' ELSE '.txt' END AS name, page_id % 3 = 0 AS is_dir FROM pages)
""")
def input_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(k == 0, "").when(k == 1, ".csv").otherwise(".txt")).alias("path"),
        (k == 0).alias("is_dir")
    )
    return packing.split_inputs(rows).select(F.col("path").alias("name"), "step")


@query("SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name")
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the data folder found by their suffix, named without it; a table is a file or a folder of files of any name."""
    found = decode.listing(spark, sf_dir).select(decode.entry(spark, sf_dir).alias("entry")).where("entry LIKE '%.parquet'")
    return found.select(decode.stem("entry").alias("name")).distinct()
