"""The tile and city-model operators as queries over the driver tables.

The driver tables hold no geodata, so each query reads them as rows of the
shape that its operator takes; the SQL beside it says the same independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import geometry, text, tiles as tile_functions
from tilewright.operators import citygml, features, load_bench, models, packing, rasters, repositories, tiles, vector_tiles, workflows
from tilewright.plans.cut import cut
from tilewright.plans.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a function under its name, with its SQL."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


# Tiles

_REGION = [2.42, 0.6, 2.46, 0.64]


def part_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as content tiles."""
    part = table(spark, sf_dir, "part")
    level = F.col("p_size") % 4
    n = F.call_function("shiftleft", F.lit(1).cast("long"), level)
    return part.select(
        level.alias("level"), (F.col("p_partkey") % n).alias("x"), (F.floor(F.col("p_partkey") / 8) % n).alias("y"), (F.col("p_partkey") % 3).cast("int").alias("slot"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("long")).alias("features"), F.floor("p_retailprice").alias("size"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("uri"),
    )


_PART_TILES = "SELECT p_size % 4 AS level, p_partkey % (1 << (p_size % 4)) AS x, (p_partkey // 8) % (1 << (p_size % 4)) AS y, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS features, CAST(floor(p_retailprice) AS BIGINT) AS size FROM part"


@query(f"""
WITH t AS ({_PART_TILES}), c AS (SELECT level, x, y, CAST(coalesce(sum(features), 0) AS BIGINT) AS features, count(features) AS known_slots, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_slots FROM t GROUP BY ALL)
SELECT *, round(degrees(2.42 + x * (0.04 / pow(2, level))), 6) AS west, round(degrees(0.6 + y * (0.04 / pow(2, level))), 6) AS south,
  round(degrees(2.42 + (x + 1) * (0.04 / pow(2, level))), 6) AS east, round(degrees(0.6 + (y + 1) * (0.04 / pow(2, level))), 6) AS north FROM c
""")
def tile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tiles.merge_cells(part_tiles(spark, sf_dir))
    region = tile_functions.cell_region(F.col("level"), F.col("x"), F.col("y"), F.array(*map(F.lit, _REGION)))
    return cells.withColumn("r", region).select(
        "level", "x", "y", "features", "known_slots", "size", F.size("slots").cast("long").alias("n_slots"),
        *(F.round(F.col("r")[s], 6).alias(s) for s in ("west", "south", "east", "north"))
    )


FLAGSHIP = tile_cells


@query(f"""
WITH t AS ({_PART_TILES}), v AS (SELECT * FROM t WHERE level BETWEEN 1 AND 2), c AS (SELECT level, x, y, coalesce(sum(features), 0) AS features, sum(size) AS size FROM v GROUP BY ALL)
SELECT CAST(coalesce(min(features), 0) AS BIGINT) AS low, CAST(coalesce(max(features), 1) AS BIGINT) AS high, count(*) AS tiles, CAST(sum(features) AS BIGINT) AS total_features, CAST(sum(size) AS BIGINT) AS total_size,
  (SELECT count(*) FROM (SELECT DISTINCT level, x, y FROM t)) AS all_tiles FROM c
""")
def tile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = part_tiles(spark, sf_dir)
    cells = tiles.merge_cells(tiles.within_levels(every, 2, 1))
    return tiles.cell_range(cells).crossJoin(tiles.cell_totals(cells, every))


@query(f"""
WITH t AS ({_PART_TILES}), c AS (SELECT level, x, y, CAST(sum(size) AS BIGINT) AS size FROM t GROUP BY ALL), r AS (SELECT ln(min(size) + 1) AS a, ln(max(size) + 1) AS b FROM c)
SELECT level, x, y, round(240 - 240 * ((ln(size + 1) - a) / (b - a)), 4) AS hue FROM c, r
""")
def tile_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.cell_colours(tiles.merge_cells(part_tiles(spark, sf_dir)), "size").select("level", "x", "y", F.round("hue", 4).alias("hue"))


@query("""
WITH e AS (SELECT event_id, event_id % 65536 AS x, (event_id * 7) % 65536 AS y FROM events),
b AS (SELECT event_id, x, y, unnest(range(16)) AS i FROM e)
SELECT event_id, CAST(sum((((x >> i) & 1) << (2 * i)) + (((y >> i) & 1) << (2 * i + 1))) AS BIGINT) AS morton, CAST((pow(4, event_id % 12) - 1) / 3 AS BIGINT) AS level_offset FROM b GROUP BY event_id, event_id % 12
""")
def morton_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", tile_functions.morton(F.col("event_id") % 65536, (F.col("event_id") * 7) % 65536).alias("morton"),
        tile_functions.level_offset(F.col("event_id") % 12).alias("level_offset")
    )


@query("""
WITH p AS (SELECT o_orderkey, (o_totalprice - 100000) * 50 AS mx, (o_custkey * 731.0) - 300000 AS my, o_orderkey % 15 AS z FROM orders),
s AS (SELECT *, 2 * 20037508.342789244 / pow(2, z) AS w FROM p), t AS (SELECT *, floor((mx + 20037508.342789244) / w) AS tx, floor((20037508.342789244 - my) / w) AS ty FROM s)
SELECT o_orderkey, CAST(z AS INTEGER) AS z, CAST(tx AS BIGINT) AS x, CAST(ty AS BIGINT) AS y, round((mx - (tx * w - 20037508.342789244)) / w, 6) AS u, round((my - (20037508.342789244 - (ty + 1) * w)) / w, 6) AS v FROM t
""")
def mercator_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = (F.col("o_totalprice") - 100000) * 50, (F.col("o_custkey") * F.lit(731.0)) - 300000, F.col("o_orderkey") % 15
    t, w = tile_functions.mercator_tile(x, y, z), tile_functions.within_tile(x, y, z)
    return table(spark, sf_dir, "orders").select("o_orderkey", t["z"].alias("z"), t["x"].alias("x"), t["y"].alias("y"), w["x"].alias("u"), w["y"].alias("v"))


@query("SELECT p_partkey, 'L' || CAST(p_size % 4 AS VARCHAR) || '/' || CAST(p_partkey AS VARCHAR) || '/' || CAST(p_size AS VARCHAR) || '.glb' AS uri, 'a/' || p_brand AS root, ((p_partkey << 2) | (p_size % 4)) AS child FROM part")
def tile_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = tile_functions.uri(F.lit("L{level}/{x}/{y}.glb"), F.col("p_size") % 4, F.col("p_partkey"), F.col("p_size"))
    root = tile_functions.tile_root(F.concat(F.lit("a/"), F.col("p_brand"), F.lit("/3/"), F.col("p_partkey").cast("string"), F.lit("/2.mvt")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", uri.alias("uri"), root.alias("root"), tile_functions.child(F.col("p_partkey"), F.lit(2), F.col("p_size") % 4).alias("child")
    )


# City models


@query("""
WITH c AS (SELECT l_orderkey + CASE WHEN l_suppkey % 50 = 0 THEN 100000000 ELSE 0 END AS target, l_linenumber + CASE WHEN l_partkey % 40 = 0 THEN 100 ELSE 0 END AS ring, CAST(l_quantity AS INTEGER) + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END AS uv_pairs FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, max(CAST(l_quantity AS INTEGER)) AS vertices FROM lineitem GROUP BY ALL)
SELECT CASE WHEN o_orderkey IS NULL THEN 'no_polygon' WHEN r.l_orderkey IS NULL THEN 'no_ring' WHEN vertices <> uv_pairs THEN 'count_mismatch' ELSE 'ok' END AS finding, count(*) AS n
FROM c LEFT JOIN orders ON target = o_orderkey LEFT JOIN r ON target = r.l_orderkey AND ring = r.l_linenumber GROUP BY 1
""")
def texture_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    uv = F.col("l_quantity").cast("int")
    shift = lambda c, n: F.when(c, n).otherwise(0)
    coords = line.select(
        (F.col("l_orderkey") + shift(F.col("l_suppkey") % 50 == 0, 100_000_000)).alias("target"),
        (F.col("l_linenumber") + shift(F.col("l_partkey") % 40 == 0, 100)).alias("ring"),
        (uv + shift(F.col("l_partkey") % 10 == 0, 1)).alias("uv_pairs")
    )
    rings = line.groupBy(F.col("l_orderkey").alias("polygon"), F.col("l_linenumber").alias("ring")).agg(F.max(uv).alias("vertices"))
    polygons = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("polygon"))
    return citygml.classify_alignment(coords, polygons, rings, []).groupBy("finding").agg(F.count("*").alias("n"))


def place_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a node table of one document, numbered in document order without gaps.

    Customers are counted by nation and block of keys first, so that whatever the keys
    each finds its number within its block and within the range of its own nation.
    """
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.lit(None).cast("int").alias("nation"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"))
    key = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(key / citygml.BIN).alias("block"), key)
    blocks = customer.groupBy("nation", "block").agg(F.count("*").alias("n"))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    held = F.lit(1) + F.coalesce("n", F.lit(0))
    upper = region.unionByName(nation).join(blocks.groupBy("nation").agg(F.sum("n").alias("n")), "nation", "left").withColumns({"path": F.lit("doc"), "held": held})
    upper = upper.withColumn("pre", before("held", earlier("path").orderBy("region", F.col("nation").asc_nulls_first())))
    upper = upper.withColumn("last", F.col("pre") + F.when(F.col("nation").isNull(), F.sum("held").over(Window.partitionBy("path", "region"))).otherwise(F.col("held")) - 1)
    nations = upper.where("nation IS NOT NULL")
    first = blocks.withColumn("first", before("n", earlier("nation").orderBy("block")))
    start = first.join(F.broadcast(nations.select("nation", "pre")), "nation").select("nation", "block", (F.col("pre") + F.col("first")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("nation", "block").orderBy(key))
    leaves = customer.withColumn("nth", nth).join(start, ["nation", "block"]).withColumn("pre", F.col("start") + F.col("nth"))
    row = lambda df, last, depth, kind, of: df.select(
        F.lit("doc").alias("path"), "pre", F.col(last).alias("last"), F.lit(depth).alias("depth"), F.lit(kind).alias("local"),
        F.concat(F.lit(kind[0]), F.col(of).cast("string")).alias("gml_id")
    )
    regions = row(upper.where("nation IS NULL"), "last", 0, "Region", "region")
    return regions.unionByName(row(nations, "last", 1, "Nation", "nation")).unionByName(row(leaves, "pre", 2, "Polygon", "c_custkey"))


def status_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a pending order, as textured polygons."""
    polygon = F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("polygon")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("doc").alias("path"), polygon).distinct()


@query("""
WITH t AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'P'), p AS (SELECT c_custkey, n_nationkey, n_regionkey FROM t JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 'R' || n_regionkey AS gml_id, 'Region' AS feature_type, '' AS parent, count(*) AS polygons FROM p GROUP BY ALL
UNION ALL SELECT 'N' || n_nationkey, 'Nation', 'R' || n_regionkey, count(*) FROM p GROUP BY ALL
""")
def textured_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = cut(citygml.textured_elements(place_tree(spark, sf_dir), status_polygons(spark, sf_dir)), "elements")
    named = citygml.with_parents(elements, citygml.outermost_parents(elements))
    return named.join(elements.select("path", "gml_id", "polygons"), ["path", "gml_id"]).drop("path")


@query("""
WITH t AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus = 'P')
SELECT DISTINCT 'N' || n_nationkey AS gml_id, 'R' || n_regionkey AS parent FROM t JOIN customer ON c = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def innermost_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = cut(citygml.textured_elements(place_tree(spark, sf_dir), status_polygons(spark, sf_dir)), "elements")
    parents = citygml.outermost_parents(elements)
    return citygml.with_parents(citygml.innermost(elements, parents), parents).select("gml_id", "parent")


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ', ' ORDER BY l_returnflag || l_linestatus) AS textures FROM lineitem GROUP BY 1")
def texture_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("texture"))
    return citygml.texture_names(mapped, ["l_orderkey"])


@query("""
SELECT o_orderstatus AS path, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS polygons, count(*) AS textures, count(*) FILTER (l_quantity > 45) AS errors, CAST(0 AS BIGINT) AS warnings
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ROLLUP (o_orderstatus)
""")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 45, "count_mismatch").otherwise("ok").alias("finding"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("path"))
    met = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return citygml.alignment_totals(met.select("path", "finding"), met.select("path", F.col("l_orderkey").alias("polygon")))


@query("""
SELECT n_nationkey, '{urn:x}' || n_name AS tag, n_name AS local, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN '#' || n_name END AS required,
  CASE WHEN n_nationkey % 3 = 2 THEN n_name ELSE n_name END AS stripped, CASE WHEN n_nationkey % 3 = 1 THEN '#' || n_name ELSE n_name END AS prefixed FROM nation
""")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit("{urn:x}"), F.col("n_name"))
    ref = F.concat(F.element_at(F.array(F.lit("#"), F.lit("##"), F.lit("")), F.col("n_nationkey") % 3 + 1), F.col("n_name"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", tag.alias("tag"), text.local_name(tag).alias("local"),
        *(text.reference(ref, r).alias(a) for r, a in (("require", "required"), ("strip", "stripped"), ("prefix", "prefixed")))
    )


@query("""
WITH m AS (SELECT url, regexp_extract(url, '://[^/]*/(.*)$', 1) AS path FROM pages)
SELECT split_part(path, '/', 1) AS folder, count(*) AS members FROM m WHERE starts_with(path, 'en/1') OR starts_with(path, 'en/2') OR starts_with(path, 'de/3') GROUP BY 1
""")
def included_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://[^/]*/(.*)$", 1).alias("path"))
    tree = spark.createDataFrame([("en/", "1"), ("en/", "2"), ("de/", "3")], "prefix string, item string")
    return citygml.included(members, tree).groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("members"))


# Vector tiles and rasters

_RING = "WITH g AS (SELECT o_orderkey, o_orderkey % 6 AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def order_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as features whose points are their lines."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("k")).join(line, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    points = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(
                F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>")),
                lambda i: F.concat(F.lit("["), i.cast("string"), F.lit(",1]"))
            ),
            ","
        ),
        F.lit("]")
    )
    wrap = lambda a, b: F.concat(F.lit(a), points, F.lit(b))
    kinds = ["Point", "LineString", "Polygon", "MultiPolygon", "MultiLineString"]
    gtype = F.element_at(F.array(*map(F.lit, [*kinds, "Polygon"])), (F.col("k") + 1).cast("int"))
    coords = F.when(F.col("k").isin(0, 1), points).when(F.col("k").isin(2, 4), wrap("[", "]")).when(F.col("k") == 3, wrap("[[", "]]"))
    return rows.select(
        F.lit("t").alias("path"), F.concat(F.lit("layer"), (F.col("o_orderkey") % 3).cast("string")).alias("layer"), F.col("o_orderkey").alias("nth"),
        F.when(F.col("o_orderkey") % 50 != 0, gtype).alias("gtype"), coords.alias("coordinates"),
        F.create_map().cast("map<string,string>").alias("props"), F.lit(None).cast("string").alias("error")
    )


@query(f"""
{_RING}, v AS (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN 'null geometry' WHEN k = 5 THEN 'null coordinates' WHEN k = 0 AND n = 0 THEN 'empty point' WHEN k = 1 AND n < 2 THEN 'linestring with ' || n || ' points'
  WHEN k = 2 AND n < 3 THEN 'polygon ring 0 has ' || n || ' points (need >= 3)' WHEN k = 3 AND n < 3 THEN 'multipolygon[0] ring 0 has ' || n || ' points' WHEN k = 4 AND n < 2 THEN 'multilinestring[0] has ' || n || ' points' END AS reason FROM g)
SELECT 'layer' || (o_orderkey % 3) AS layer, reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY ALL
""")
def geometry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tiles.mvt_findings(order_geometries(spark, sf_dir)).groupBy("layer", "reason").agg(F.count("*").alias("n"))


@query("""
SELECT 'layer' || (o_orderkey % 3) AS layer, ['Point', 'LineString', 'Polygon', 'MultiPolygon', 'MultiLineString', 'Polygon'][o_orderkey % 6 + 1] AS gtype, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL
""")
def geometry_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tiles.type_counts(order_geometries(spark, sf_dir)).drop("path")


@query("""
WITH f AS (SELECT p_partkey, p_retailprice AS x, p_size * 20.0 AS y FROM part WHERE p_type NOT LIKE 'PROMO%'), s(sel, x0, y0, x1, y1) AS (VALUES (0, 950.0, 100.0, 1000.0, 400.0), (1, 1500.0, 0.0, 1510.0, 2000.0))
SELECT sel, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS ids FROM f, s WHERE x <= x1 AND x + 5 >= x0 AND y <= y1 AND y + 5 >= y0 GROUP BY sel
""")
def box_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_retailprice"), F.col("p_size") * F.lit(20.0)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(x, y, x + 5, y + 5).alias("extent"), (~F.col("p_type").startswith("PROMO")).alias("visible"))
    boxes = spark.createDataFrame([(0, [950.0, 100.0, 1000.0, 400.0]), (1, [1500.0, 0.0, 1510.0, 2000.0])], "sel int, box array<double>")
    return vector_tiles.select_box(rows, boxes).groupBy("sel").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("ids"))


_RASTERS = """
WITH a AS (SELECT o_orderkey AS y, CASE WHEN o_orderpriority = '1-URGENT' THEN CAST('nan' AS DOUBLE) ELSE o_totalprice END AS d FROM orders),
b AS (SELECT l_orderkey + CASE WHEN l_orderkey % 10 = 0 THEN 100000000000 ELSE 0 END AS y, CASE WHEN max(l_quantity) >= 48 THEN CAST('inf' AS DOUBLE) ELSE max(l_extendedprice) END AS d FROM lineitem GROUP BY l_orderkey),
m AS (SELECT coalesce(a.y, b.y) AS y, a.d AS t, b.d AS f, coalesce(isfinite(a.d), false) AS ta, coalesce(isfinite(b.d), false) AS fb FROM a FULL JOIN b ON a.y = b.y),
k AS (SELECT *, CASE WHEN ta AND fb THEN 'both' WHEN ta THEN 'only_truth' WHEN fb THEN 'only_flow' ELSE 'neither' END AS kind, CASE WHEN ta AND fb THEN CAST(floor(least(1.0, abs(f - t) / 100000.0) * 255) AS BIGINT) END AS shade FROM m)
"""


def order_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a raster against their lines as another; each tenth order's lines lie on a pixel of their own."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("d"), F.max("l_quantity").alias("q"))
    truth = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("y"), F.when(F.col("o_orderpriority") == "1-URGENT", float("nan")).otherwise(F.col("o_totalprice")).alias("depth")
    )
    y = F.col("l_orderkey") + F.when(F.col("l_orderkey") % 10 == 0, 100_000_000_000).otherwise(0)
    flow = line.select(y.alias("y"), F.when(F.col("q") >= 48, float("inf")).otherwise(F.col("d")).alias("depth"))
    return rasters.diff_pixels(truth, flow, 100_000.0, ["y"])


@query(_RASTERS + """
SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'only_truth' THEN 255 WHEN kind = 'both' AND NOT f - t > 0 THEN shade ELSE 0 END) AS BIGINT) AS red, CAST(sum(CASE WHEN kind = 'only_flow' THEN 255 WHEN kind = 'both' AND f - t > 0 THEN shade ELSE 0 END) AS BIGINT) AS green,
  round(max(CASE WHEN kind = 'both' THEN abs(f - t) ELSE 0 END), 2) AS gap FROM k GROUP BY kind
""")
def raster_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = order_pixels(spark, sf_dir)
    gap = F.round(F.max(F.when(F.col("kind") == "both", F.abs(F.col("flow") - F.col("truth"))).otherwise(0.0)), 2)
    return pixels.groupBy("kind").agg(F.count("*").alias("n"), F.sum("red").alias("red"), F.sum("green").alias("green"), gap.alias("gap"))


@query(_RASTERS + """
SELECT count(*) FILTER (kind = 'both') AS both, count(*) FILTER (kind = 'only_truth') AS only_truth, count(*) FILTER (kind = 'only_flow') AS only_flow,
  round(coalesce(max(abs(f - t)) FILTER (kind = 'both'), 0), 2) AS max_abs_diff FROM k
""")
def raster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.diff_summary(order_pixels(spark, sf_dir)).withColumn("max_abs_diff", F.round("max_abs_diff", 2))


# Features and workflows


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feature store: a port per type, lines by event."""
    doc = F.concat(F.lit('{"attributes":'), F.col("props"), F.lit(',"id":"e'), F.col("event_id").cast("string"), F.lit('"}'))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("port"), F.col("event_id").alias("line_no"), doc.alias("feature"))


@query("""
SELECT event_type AS port, event_id AS _idx, CASE WHEN coalesce(props::JSON->>'$.k', '0') IN ('0', '', 'false') THEN '' ELSE props::JSON->>'$.k' END AS k, count(*) OVER (PARTITION BY event_type) AS count FROM events
""")
def feature_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_features(spark, sf_dir)
    return features.port_entries(rows, [".attributes.k"]).join(features.port_counts(rows), "port")


@query("""
SELECT 'u' || user_id AS port, count(*) AS count, string_agg(event_id || '=' || (CASE WHEN coalesce(props::JSON->>'$.k', '0') IN ('0', '', 'false') THEN '' ELSE props::JSON->>'$.k' END), ',' ORDER BY event_id) AS entries FROM events GROUP BY user_id
""")
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"))
    rows = event_features(spark, sf_dir).join(users, F.col("line_no") == F.col("event_id")).withColumn("port", F.col("user"))
    index = features.port_index(rows, [".attributes.k"])
    return index.select("port", "count", F.array_join(F.transform("features", lambda e: F.concat(e["_idx"].cast("string"), F.lit("="), e["k"])), ",").alias("entries"))


@query("""
WITH f AS (SELECT event_type AS port, min(event_id) AS first, count(*) AS count FROM events GROUP BY 1)
SELECT port, count, '{"attributes":' || props || ',"id":"e' || event_id || '"}' AS sample, array_to_string(json_keys(props::JSON)[1:10], ',') AS attributes FROM f JOIN events ON first = event_id
""")
def edge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.edge_samples(event_features(spark, sf_dir)).withColumn("attributes", F.array_join("attributes", ","))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com') AND contains(lower(html), 'lang=\"de\"')")
def filtered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.matching(table(spark, sf_dir, "pages"), [("url", "EXAMPLE.com"), ("html", 'LANG="DE"'), ("", "x"), ("url", "")]).select("page_id", "url")


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 50 OFFSET 50")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.page(table(spark, sf_dir, "events"), ["event_id"], 1).select("event_id", "user_id")


@query("""
WITH w AS (SELECT o_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, array_to_string(CASE WHEN len(items) > 5 THEN list_append(items[1:5], '... and ' || (len(items) - 5) || ' more items') ELSE items END, ';') AS items FROM w
""")
def truncated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(items.alias("items"))
    return rows.select("o_orderkey", F.array_join(features.truncated(F.col("items")), ";").alias("items"))


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as the nodes and edges of graphs, one per region; region 0 is the entry."""
    nation = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("node-0000-"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0"))
    other = F.concat(F.lit("node-0000-"), F.lpad(((F.col("n_nationkey") * 7 + 3) % 25).cast("string"), 4, "0"))
    graph = F.concat(F.lit("g"), F.col("n_regionkey").cast("string"))
    nodes = nation.select(graph.alias("graph"), (F.col("n_regionkey") == 0).alias("is_entry"), F.col("n_nationkey").alias("nth"), name.alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "act").alias("action"),
                          F.when(F.col("n_regionkey") == 0, "subGraph").alias("type"), F.when(F.col("n_regionkey") == 0, F.concat(F.lit("g"), (F.col("n_nationkey") % 5).cast("string"))).alias("subgraph"))
    edges = nation.select(graph.alias("graph"), (F.col("n_regionkey") == 0).alias("is_entry"), F.col("n_nationkey").alias("nth"), F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("id"), name.alias("src"), other.alias("dst"),
                          F.when(F.col("n_nationkey") % 3 == 0, "").when(F.col("n_nationkey") % 3 == 1, "out").alias("from_port"), F.lit("in").alias("to_port"))
    return nodes, edges


_GRAPH = "WITH n AS (SELECT 'g' || n_regionkey AS graph, n_nationkey AS k, 'node-0000-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS id, n_name AS name, 'node-0000-' || lpad(CAST((n_nationkey * 7 + 3) % 25 AS VARCHAR), 4, '0') AS dst FROM nation)"


@query(f"{_GRAPH} SELECT a.graph, a.k AS nth, a.name AS src, coalesce(b.name, right(a.dst, 8)) AS dst FROM n a LEFT JOIN n b ON a.graph = b.graph AND a.dst = b.id")
def graph_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.topology(*nation_graph(spark, sf_dir)).select("graph", "nth", "src", "dst")


@query(f"{_GRAPH}, i AS (SELECT id, 'g' || (k % 5) AS sub FROM n WHERE graph = 'g0') SELECT 'e' || k AS edge FROM n WHERE graph = 'g0' UNION ALL SELECT i.id || '.e' || k FROM n JOIN i ON n.graph = i.sub WHERE graph <> 'g0'")
def graph_edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.edge_ids(*nation_graph(spark, sf_dir))


@query(f"""{_GRAPH}, p AS (SELECT 'g' || (k % 5) AS sub, arg_max(id, k) AS parent FROM n WHERE graph = 'g0' GROUP BY 1)
SELECT 'e' || k AS id, concat_ws('.', parent, n.id, CASE WHEN k % 3 = 1 THEN 'out' ELSE 'default' END) AS port FROM n LEFT JOIN p ON graph = sub""")
def graph_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.port_ids(*nation_graph(spark, sf_dir)).select("id", "port")


@query("SELECT n_nationkey AS nth, CASE WHEN n_nationkey % 2 = 0 THEN 'act' WHEN n_regionkey = 0 THEN 'subGraph:g' || (n_nationkey % 5) ELSE 'subGraph:?' END AS label, ['#a', '#b', '#c'][n_nationkey % 3 + 1] AS colour, greatest(100, length(n_name) * 6 + 20) AS width FROM nation")
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = nation_graph(spark, sf_dir)
    return workflows.labelled(nodes).select("nth", "label", text.palette(F.col("nth"), ["#a", "#b", "#c"]).alias("colour"), geometry.node_width(F.col("name")).alias("width"))


@query("""
WITH p AS (SELECT n_nationkey * 40 AS x, n_regionkey * 90 AS y, greatest(100, length(n_name) * 6 + 20) AS w FROM nation), b AS (SELECT min(x - w / 2) AS min_x, min(y - 20.0) AS min_y, max(x + w / 2) AS max_x, max(y + 20.0) AS max_y FROM p)
SELECT *, round(least(800 / (max_x - min_x + 100), 600 / (max_y - min_y + 100), 1.0), 6) AS scale FROM b
""")
def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), (F.col("n_nationkey") * 40).alias("x"), (F.col("n_regionkey") * 90).alias("y"),
        F.lit(None).cast("int").alias("width"), F.lit(40.0).alias("height")
    )
    bounds = workflows.layout_bounds(placed)
    fit = geometry.fit_layout(F.lit(800), F.lit(600), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    return bounds.withColumn("scale", F.round(fit["scale"], 6))


# Repositories


@query("SELECT max(ts) AS date, 'u' || (user_id % 7) AS branch, event_type AS file FROM events GROUP BY user_id % 7, event_type")
def newest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("ts").alias("date"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("branch"), F.col("event_type").alias("file"),
        F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"), "event_id").alias("line_no")
    )
    return repositories.recent_files(rows)


@query("""
WITH c AS (SELECT conv_id, string_agg(role, ';' ORDER BY turn DESC) AS stack, count(*) AS n FROM conversations GROUP BY 1) SELECT stack, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY stack
""")
def collapsed_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("at"), "role")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(frames, lambda f: f["role"]), ";").alias("stack"), F.count("*").alias("count"))
    return repositories.collapse_stacks(rows)


@query("""
WITH s AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS size FROM documents WHERE lang <> 'de' GROUP BY 1)
SELECT a.size AS size_a, b.size AS size_b, a.size - b.size AS diff FROM (SELECT coalesce(sum(size), 0)::BIGINT AS size FROM s WHERE source = 'src1') a, (SELECT coalesce(sum(size), 0)::BIGINT AS size FROM s WHERE source = 'src2') b
""")
def tree_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("branch"), F.when(F.col("lang") != "de", "blob").otherwise("tree").alias("type"), F.col("n_chars").alias("size")
    )
    return repositories.tree_size_diff(rows, "src1", "src2").select("size_a", "size_b", "diff")


@query("""
SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.2f', n_chars::DOUBLE) || 'B' WHEN n_chars < 1048576 THEN printf('%.2f', round_even(n_chars / 1024.0, 2)) || 'KB' ELSE printf('%.2f', round_even(n_chars / 1048576.0, 2)) || 'MB' END AS long_text, CASE WHEN n_chars < 1024 THEN CAST(n_chars AS VARCHAR) || '.0 B' END AS short_text FROM documents
""")
def byte_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", text.bytes_text(n).alias("long_text"), F.when(n < 1024, text.bytes_short(n)).alias("short_text"))


@query("""
SELECT 'name' || n_nationkey AS name, 'name' || n_nationkey || ' = { git = "https://h/x", branch = "main" }' AS rewritten FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'name' || n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 1
""")
def dependency_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("n_nationkey") % 2 == 0, "https://h/x").otherwise("https://h/y")
    blocks = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("name"), F.col("n_nationkey").cast("string")).alias("name"),
        F.concat(F.lit(' git = "'), url, F.lit('", tag = "v1" ')).alias("body")
    )
    return repositories.rewrite_dependencies(blocks, "https://h/x", "main").select("name", "rewritten")


# Load benchmarks


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS nth, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(value, 1) AS value FROM r WHERE nth = floor((n - 1) * 0.95)
""")
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_bench.percentile_down(table(spark, sf_dir, "events"), ["event_type"], "value", 0.95)


@query("""
SELECT event_type AS codec, m AS metric, count(*) AS n, round(avg(v), 2) AS mean, round(stddev_pop(v), 2) AS std, round(min(v), 2) AS min, round(max(v), 2) AS max
FROM (SELECT event_type, unnest(['user_id', 'value']) AS m, unnest([user_id::DOUBLE, value]) AS v FROM events WHERE value >= 5) GROUP BY ALL
""")
def codec_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("codec"), "value", "user_id", F.when(F.col("value") < 5, "late").alias("error"))
    return load_bench.codec_stats(runs, ["value", "user_id"])


@query("""
WITH e AS (SELECT event_type, epoch_us(ts) / 1e6 AS a, value FROM events), s AS (SELECT event_type, a AS t, 1 AS d FROM e UNION ALL SELECT event_type, a + value, -1 FROM e),
r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM s) SELECT event_type, CAST(greatest(max(open), 0) AS BIGINT) AS peak FROM r GROUP BY 1
""")
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = table(spark, sf_dir, "events").select("event_type", at.alias("a"), (at + F.col("value")).alias("b"))
    return load_bench.peak_concurrency(spans, ["event_type"], "a", "b")


@query("""
WITH q AS (SELECT o_orderpriority AS codec, o_orderkey % 3 AS rep, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE o_custkey + 3.0 END AS rs, o_custkey::DOUBLE AS fs, o_custkey + (o_orderkey % 9)::DOUBLE AS s, o_custkey + (o_orderkey % 20)::DOUBLE AS e, o_totalprice AS tr FROM orders),
p AS (SELECT *, greatest(0, (CASE WHEN rs = 0 THEN fs ELSE rs END) - fs) AS queued, greatest(0, s - (CASE WHEN rs = 0 THEN fs ELSE rs END)) AS ttfb, greatest(0, e - s) AS dl FROM q),
i AS (SELECT codec, rep, fs AS t, 1 AS d FROM q UNION ALL SELECT codec, rep, e, -1 FROM q), m AS (SELECT codec, rep, CAST(greatest(max(o), 0) AS BIGINT) AS peak FROM (SELECT codec, rep, sum(d) OVER (PARTITION BY codec, rep ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM i) GROUP BY ALL)
SELECT codec, rep, count(*) AS requests, round(sum(tr) / 1048576, 1) AS transfer_mb, CAST(round(sum(queued)) AS BIGINT) AS total_queued_ms, CAST(round(sum(ttfb)) AS BIGINT) AS total_ttfb_ms, CAST(round(sum(dl)) AS BIGINT) AS total_download_ms,
  round(avg(queued), 2) AS avg_queued_ms, round(avg(ttfb), 2) AS avg_ttfb_ms, round(avg(dl), 2) AS avg_download_ms, any_value(peak) AS peak_concurrency FROM p JOIN m USING (codec, rep) GROUP BY ALL
""")
def network_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetch = F.col("o_custkey").cast("double")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("codec"), (F.col("o_orderkey") % 3).alias("rep"), F.when(F.col("o_orderkey") % 4 == 0, 0.0).otherwise(fetch + 3).alias("request_start"), fetch.alias("fetch_start"),
                                                 (fetch + F.col("o_orderkey") % 9).alias("response_start"), (fetch + F.col("o_orderkey") % 20).alias("response_end"), F.col("o_totalprice").alias("transfer_size"), F.lit(None).cast("double").alias("encoded_size"))
    return load_bench.network_stats(rows).drop("encoded_mb")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, a run per type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("codec"), F.lit(0).alias("rep"), F.col("event_id").cast("double").alias("t"), F.when(F.col("value") > 20, 1).otherwise(0).alias("pending"), F.when(F.col("value") > 60, 2).otherwise(0).alias("processing"), F.when(F.col("value") > 95, 1).otherwise(0).alias("ready")
    )


@query("""
WITH f AS (SELECT event_type AS codec, event_id AS t, CASE WHEN value > 20 THEN 1 ELSE 0 END AS busy FROM events), i AS (SELECT *, sum(busy) OVER (PARTITION BY codec ORDER BY t) AS isl FROM f),
n AS (SELECT codec, t, row_number() OVER (PARTITION BY codec, isl ORDER BY t) AS k FROM i WHERE busy = 0)
SELECT c.codec, min(t)::DOUBLE AS loaded_at FROM (SELECT DISTINCT event_type AS codec FROM events) c LEFT JOIN n ON c.codec = n.codec AND k = 4 GROUP BY 1
""")
def idle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_bench.idle_from(event_frames(spark, sf_dir), run=4).select("codec", "loaded_at")


@query("""
WITH d AS (SELECT event_type AS codec, event_id::DOUBLE AS t, event_id - lag(event_id, 1, 0) OVER (PARTITION BY event_type ORDER BY event_id) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events)
SELECT codec, t, ms::DOUBLE AS frame_ms FROM d WHERE nth > 1
""")
def frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_bench.without_first(load_bench.frame_durations(event_frames(spark, sf_dir))).select("codec", "t", "frame_ms")


@query("SELECT event_type AS codec, min(event_id)::DOUBLE AS t FROM events GROUP BY event_type, event_id // 250")
def frame_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_bench.timeline(event_frames(spark, sf_dir)).select("codec", "t")


@query("""
WITH f AS (SELECT event_type AS codec, event_id AS t, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth, event_id - lag(event_id, 1, 0) OVER (PARTITION BY event_type ORDER BY event_id) AS ms FROM events),
s AS (SELECT codec, list_sort(list(ms) FILTER (nth > 1)) AS ms, list_sort(list(round(value, 2))) AS gpu FROM f GROUP BY 1)
SELECT f.codec, min(t) FILTER (value > 95) AS first_content_ms, coalesce(max(t) FILTER (value > 20), 0) AS requests_done_ms, coalesce(max(t) FILTER (value > 60), 0) AS processing_done_ms, max(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS max_pending, max(CASE WHEN value > 60 THEN 2 ELSE 0 END) AS max_processing, count(*) AS frames,
  any_value(s.ms[CAST(floor((len(s.ms) - 1) * 0.5) AS INTEGER) + 1])::DOUBLE AS frame_ms_p50, any_value(s.ms[CAST(floor((len(s.ms) - 1) * 0.95) AS INTEGER) + 1])::DOUBLE AS frame_ms_p95, any_value(s.ms[len(s.ms)])::DOUBLE AS frame_ms_max,
  any_value(round(s.gpu[CAST(floor((len(s.gpu) - 1) * 0.5) AS INTEGER) + 1], 1)) AS gpu_ms_p50, any_value(round(s.gpu[CAST(floor((len(s.gpu) - 1) * 0.95) AS INTEGER) + 1], 1)) AS gpu_ms_p95, any_value(round(s.gpu[len(s.gpu)], 1)) AS gpu_ms_max,
  round(sum(round(value, 2)), 1) AS gpu_ms_total
FROM f JOIN s ON f.codec = s.codec GROUP BY f.codec
""")
def frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = load_bench.frame_durations(event_frames(spark, sf_dir))
    gpu = table(spark, sf_dir, "events").select(F.col("event_type").alias("codec"), F.lit(0).alias("rep"), F.round("value", 2).alias("gpu_ms"))
    return load_bench.frame_summary(frames, gpu).drop("rep", "gpu_supported")


@query("SELECT CAST(sum(event_id % 50) FILTER (event_id > 100 AND event_id <= 5000) AS DOUBLE) AS blocking_ms, count(*) FILTER (event_id % 3 = 0) AS done, count(*) AS total FROM events")
def blocking_and_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    tasks = events.select(F.col("event_id").alias("start"), (F.col("event_id") % 50).cast("double").alias("duration"))
    return load_bench.blocking_time(tasks, F.lit(100), F.lit(5000)).crossJoin(load_bench.progress(events.select((F.col("event_id") % 3 == 0).alias("done"))))


# Text functions, packing, models


@query("""
WITH RECURSIVE c AS (SELECT n_nationkey, n_name, 1 AS i, CAST(2166136261 AS BIGINT) AS h, CAST(0 AS BIGINT) AS g FROM nation
  UNION ALL SELECT n_nationkey, n_name, i + 1, CAST((CAST(xor(h, ascii(n_name[i])) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT), (g * 31 + ascii(n_name[i])) % 4294967296 FROM c WHERE i <= length(n_name)),
d AS (SELECT n_nationkey, xor(h, h >> 16) AS h, CASE WHEN g > 2147483647 THEN g - 4294967296 ELSE g END AS g FROM c WHERE i = length(n_name) + 1),
e AS (SELECT n_nationkey, g, CAST((CAST(h AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT) AS h FROM d), f AS (SELECT n_nationkey, g, CAST((CAST(xor(h, h >> 13) AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT) AS h FROM e)
SELECT n_nationkey, xor(h, h >> 16) AS mixed, xor(h, h >> 16) % 360 AS mixed_hue, g AS simple, abs(g) % 360 AS simple_hue FROM f
""")
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", text.mixed_hash(name).alias("mixed"), text.mixed_hue(name).alias("mixed_hue"), text.simple_hash(name).alias("simple"),
        text.simple_hue(name).alias("simple_hue")
    )


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'z_op_' || source || '.zip' ELSE 'z_op.zip' END AS base,
  CASE WHEN page_id % 3 = 0 THEN 'z_op' ELSE 'z_op' END || CASE WHEN page_id % 2 = 0 THEN '_a_lod1_mvt_lod' || page_id || '.zip' ELSE '_a_dm_geometric_attributes.zip' END AS name
FROM (SELECT page_id, 's' || (page_id % 4) AS source FROM pages)
""")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("z_op_s"), (F.col("page_id") % 4).cast("string"), F.lit(".zip"))).otherwise("z_op.zip")
    folder = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a_lod1_lod"), F.col("page_id").cast("string"))).otherwise("a_dm_geometric_attributes")
    return table(spark, sf_dir, "pages").select("page_id", base.alias("base"), packing.archive_name(base, folder, F.lit("mvt")).alias("name"))


@query("""
SELECT split_part(split_part(url, '://', 2), '/', 1) AS dir, CASE WHEN bool_or(url LIKE '%.html') THEN '3dtiles' WHEN bool_or(url LIKE '%#top') THEN 'mvt' END AS format FROM pages GROUP BY 1
""")
def directory_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", r"\.html$", ".glb"), "#top$", ".mvt")
    rows = table(spark, sf_dir, "pages").select(F.substring_index(F.substring_index("url", "://", -1), "/", 1).alias("dir"), path.alias("path"))
    return packing.directory_formats(rows)


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'missing vector_layers' WHEN n_nationkey % 5 = 1 THEN 'center must have 3 values' END AS finding,
  CASE WHEN n_nationkey % 5 > 1 THEN '{"tilejson":"3.0.0","tiles":["/{z}/{x}/{y}.mvt"],"vector_layers":[{"id":"' || n_name || '","fields":{}}],"name":"' || n_name || '","maxzoom":14,"bounds":[1.0,2.5,3.0,4.0],"center":[1.5,2.0,14.0]}' END AS tilejson FROM nation
""")
def tile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    inner = F.when(k % 5 == 0, F.lit('{"x":1}')).otherwise(F.to_json(F.struct(F.array(F.struct(name.alias("id"), F.lit("d").alias("description"))).alias("vector_layers"))))
    meta = F.to_json(
        F.struct(
            inner.alias("json"), F.lit("1, 2.5,3,4").alias("bounds"), F.when(k % 5 == 1, "1").otherwise("1.5,2").alias("center"),
            F.when(k % 5 != 1, 14).alias("maxzoom"), name.alias("name"), F.lit("").alias("description")
        )
    )
    return packing.to_tilejson(table(spark, sf_dir, "nation").select("n_nationkey", meta.alias("value"))).select("n_nationkey", "finding", "tilejson")


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS fid, CASE WHEN l_linenumber % 2 = 0 THEN 5121 ELSE 5122 END AS component FROM lineitem)
SELECT component, count(*) AS n, CAST(sum(CASE WHEN fid % 5 = 0 THEN CASE WHEN component = 5121 THEN 255 ELSE -1 END ELSE fid END) AS BIGINT) AS ids FROM x GROUP BY 1
""")
def masked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices = table(spark, sf_dir, "lineitem").select(
        F.lit("f").alias("path"), (F.col("l_partkey") % 40).alias("feature_id"),
        F.when(F.col("l_linenumber") % 2 == 0, 5121).otherwise(5122).alias("component")
    )
    types = spark.range(40).select(
        F.lit("f").alias("path"), F.lit(0).alias("table_idx"), F.col("id").alias("feature_id"), F.lit("feature_type").alias("property"),
        F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("value")
    )
    masked = models.mask_features(vertices, models.excluded_ids(types, ["t0"]))
    return masked.groupBy("component").agg(F.count("*").alias("n"), F.sum("new_id").alias("ids"))


@query("SELECT 'd/' || p_partkey || '.json' AS path, p_size % 3 = 0 AS paired FROM part")
def json_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = lambda tail: F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(tail)).alias("path")
    listing = part.select(name(".json")).unionByName(part.where("p_size % 3 = 0").select(name(".glb")))
    return models.json_with_glb(listing).withColumn("paired", F.lit(True)).unionByName(models.json_with_glb(listing, paired=False).withColumn("paired", F.lit(False)))


@query("SELECT event_id, props AS batch, 'k' AS property, typeof(props::JSON->'$.k') IS NOT NULL AS known FROM events")
def batch_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.col("props").alias("batch_json"))
    found = models.batch_table(rows).select(F.col("path").cast("long").alias("event_id"), "property", F.col("values").isNotNull().alias("known"))
    return found.join(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("batch")), "event_id").select("event_id", "batch", "property", "known")


@query("SELECT n_nationkey, '&lt;b&gt;' || n_name || '&amp;' AS html, 'a\\\\' || n_name || '\\`' AS script, (4 - length(n_name) % 4) % 4 AS padding FROM nation")
def escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", text.html_escape(F.concat(F.lit("<b>"), name, F.lit("&"))).alias("html"),
        text.template_escape(F.concat(F.lit("a\\"), name, F.lit("`"))).alias("script"), text.padding(F.length(name)).alias("padding")
    )


@query("""
SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("O").union(of("F")).distinct().subtract(of("P"))


@query("SELECT l_orderkey, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS first_part, count(*) AS listed FROM lineitem GROUP BY 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    first = features.one_per_port(line, ["l_orderkey"], ["l_linenumber", "l_partkey"]).select("l_orderkey", F.col("l_partkey").alias("first_part"))
    return first.join(line.groupBy("l_orderkey").agg(F.count("*").alias("listed")), "l_orderkey")


@query("""
SELECT s_suppkey, '[cameras.c' || s_suppkey || ']' || chr(10) || 'position = [' || printf('%.3f', s_nationkey::DOUBLE) || ', 0.000, 0.000]' || chr(10) || 'look_at = [' || printf('%.3f', s_nationkey::DOUBLE) || ', 500.000, 0.000]' || chr(10)
  || 'up = [0.000, 0.000, 1.000]' || chr(10) || 'fov_y_deg = 60.00' || chr(10) || 'near = 5.00' || chr(10) || 'far = 5000.00' || chr(10) AS camera FROM supplier
""")
def camera_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = lambda *v: F.array(*(F.lit(float(x)) if isinstance(x, int) else x for x in v))
    position = vector(F.col("s_nationkey").cast("double"), 0, 0)
    camera = geometry.camera_toml(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")), position, vector(0, 1, 0), vector(0, 0, 1), F.lit(1.0471975511965976),
        F.lit(None).cast("array<double>")
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", camera.alias("camera"))


@query("""
SELECT page_id, {'scheme': split_part(url, '://', 1)}.scheme AS scheme, regexp_replace(url, '/[^/]*/[^/]*$', '') AS api_base, regexp_extract(url, 'page=([0-9]+)', 1) AS page FROM pages
""")
def command_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sources.text_logs import command_parts as parts

    rows = table(spark, sf_dir, "pages").withColumn("command", F.concat(F.lit("run --var=page="), F.regexp_extract("url", "page=([0-9]+)", 1), F.lit(" "), F.col("url")))
    return parts(rows).select("page_id", F.substring_index("workflow_url", "://", 1).alias("scheme"), "api_base", F.col("variables")["page"].alias("page"))


# Decoders over files that are made of the tables' rows, so that SQL can tell what they hold


def brand_glbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GLB per brand and 5000 part keys: files stay bounded as the table grows."""
    from tilewright.plans.ship import ship

    ship(spark)
    parts = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 5000).cast("string")).alias("name"), "p_partkey", "p_type", "p_size")
    return parts.groupBy("name").applyInPandas(_brand_glb, "path string, content binary")


def _brand_glb(key, frame):  # noqa: ANN001, ANN202
    """A GLB whose property table holds some parts; runs on the executors."""
    import json

    import numpy as np
    import pandas as pd

    from tilewright.sinks.containers import build_glb

    rows = frame.sort_values("p_partkey")
    texts = [t.encode() for t in rows["p_type"]]
    parts = [b"".join(texts), np.cumsum([0, *map(len, texts)]).astype("<u4").tobytes(), rows["p_size"].to_numpy("<u2").tobytes()]
    starts = [sum(map(len, parts[:i])) for i in range(3)]
    views = [{"byteOffset": a, "byteLength": len(p)} for a, p in zip(starts, parts, strict=True)]
    tables = [{"count": len(rows), "properties": {"feature_type": {"values": 0, "stringOffsets": 1}, "size": {"values": 2, "componentType": 5123}}}]
    doc = {"bufferViews": views, "extensions": {"EXT_structural_metadata": {"propertyTables": tables}}}
    return pd.DataFrame({"path": [f"{key[0]}.glb"], "content": [build_glb(json.dumps(doc), b"".join(parts))]})


@query("""
WITH p AS (SELECT p_brand || '-' || (p_partkey // 5000) || '.glb' AS path, row_number() OVER (PARTITION BY p_brand, p_partkey // 5000 ORDER BY p_partkey) - 1 AS feature_id, p_type, p_size FROM part)
SELECT path, feature_id, 'feature_type' AS property, p_type AS value FROM p UNION ALL SELECT path, feature_id, 'size', CAST(p_size AS VARCHAR) FROM p
""")
def glb_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sources.gltf import glb_properties as decode

    return decode(brand_glbs(spark, sf_dir)).select("path", "feature_id", "property", "value")


@query("SELECT p_brand || '-' || (p_partkey // 5000) || '.glb' AS path, count(*) AS features FROM part GROUP BY 1")
def glb_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sources.gltf import read_glb

    return read_glb(brand_glbs(spark, sf_dir), json_only=True).select("path", tiles.feature_count().alias("features"))


def nation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city model per nation and 2000 customer keys: the customers are buildings with a polygon, those with a negative balance have a texture."""
    name = F.col("c_custkey").cast("string")
    building = F.concat(
        F.lit('<core:cityObjectMember><bldg:Building gml:id="b'), name, F.lit('"><bldg:lod1Geometry><gml:Polygon gml:id="p'), name,
        F.lit('"/></bldg:lod1Geometry></bldg:Building></core:cityObjectMember>')
    )
    target = F.when(F.col("c_acctbal") < 0, F.concat(F.lit('<app:target uri="#p'), name, F.lit('">#p'), name, F.lit("</app:target>")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", c.alias("s")))), lambda x: x["s"]), "")
    docs = table(spark, sf_dir, "customer").groupBy(
        "c_nationkey", F.floor(F.col("c_custkey") / 2000).alias("part")
    ).agg(joined(building).alias("buildings"), joined(F.coalesce(target, F.lit(""))).alias("targets"))
    head = '<core:CityModel xmlns:core="urn:c" xmlns:bldg="urn:b" xmlns:gml="http://www.opengis.net/gml" xmlns:app="urn:a">'
    texture = '<app:appearanceMember><app:Appearance><app:surfaceDataMember><app:ParameterizedTexture><app:imageURI>t.jpg</app:imageURI>'
    tail = "</app:ParameterizedTexture></app:surfaceDataMember></app:Appearance></app:appearanceMember></core:CityModel>"
    return docs.select(
        F.concat(F.lit("n"), F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("part").cast("string"))).alias("path"),
        F.encode(F.concat(F.lit(head), "buildings", F.lit(texture), "targets", F.lit(tail)), "utf-8").alias("content")
    )


@query("SELECT 'n' || c_nationkey || '-' || (c_custkey // 2000) AS path, 'b' || c_custkey AS gml_id, 'Building' AS feature_type, '' AS parent FROM customer WHERE c_acctbal < 0")
def xml_textured_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sources.xml_nodes import read_nodes

    return citygml.textured_features(cut(read_nodes(nation_documents(spark, sf_dir)), "nodes"))


@query("SELECT 'n' || c_nationkey || '-' || (c_custkey // 2000) AS path, 'b' || c_custkey AS object, 'LOD1' AS lod, CASE WHEN c_acctbal < 0 THEN 't.jpg' ELSE '' END AS textures FROM customer")
def xml_texture_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sources.xml_nodes import read_nodes

    return citygml.texture_mapping(cut(read_nodes(nation_documents(spark, sf_dir)), "nodes"))


@query("SELECT source || '-' || (doc_id // 500) || '.zip' AS archive, 'd/' || doc_id || '.txt' AS path, strlen(coalesce(text, '')) AS size FROM documents")
def zip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sinks.containers import zip_archives
    from tilewright.sources.archives import zip_listing

    rows = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 500).cast("string"), F.lit(".zip")).alias("archive"),
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")
    )
    return zip_listing(zip_archives(rows)).select(F.col("path").alias("archive"), F.col("member").alias("path"), "size")


@query("SELECT o_orderstatus AS stack, count(*) AS count FROM orders GROUP BY 1")
def stack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sources.text_logs import stack_rows

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    frame = F.concat(F.lit(" lib`"), F.col("o_orderstatus"), F.lit("(int)+0x"), F.col("o_orderkey").cast("string"))
    lines = orders.select(
        (F.col("o_orderkey") % 97).cast("string").alias("path"),
        F.inline(
            F.array(
                F.struct((F.col("o_orderkey") * 2).alias("line_no"), frame.alias("value")),
                F.struct((F.col("o_orderkey") * 2 + 1).alias("line_no"), F.lit(" 1 ").alias("value"))
            )
        )
    )
    return repositories.collapse_stacks(stack_rows(lines))


@query("""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'b' || (o_orderkey % 3) AS branch, 'f' || o_custkey AS file, count(*) AS n FROM orders GROUP BY ALL
""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.sources.text_logs import log_rows

    head = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" refs/remotes/origin/b"), (F.col("o_orderkey") % 3).cast("string"))
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 50).cast("string").alias("path"),
        F.inline(
            F.array(
                F.struct((F.col("o_orderkey") * 2).alias("line_no"), head.alias("value")),
                F.struct((F.col("o_orderkey") * 2 + 1).alias("line_no"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("value"))
            )
        )
    )
    return log_rows(rows).groupBy("date", "branch", "file").agg(F.count("*").alias("n"))
