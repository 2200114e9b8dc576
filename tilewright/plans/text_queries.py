"""Queries for feature stores, logs, configurations, benchmark samples, pictures and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geometry, text
from tilewright.operators import features, load_bench, repositories, vector_tiles, workflows
from tilewright.plans import shared_dir
from tilewright.plans.core_queries import event_features, nation_graph, query
from tilewright.plans.tables import table
from tilewright.sinks import reports
from tilewright.sources import browser_samples, text_logs, workflows as workflow_source


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Feature stores


@query("""
SELECT event_type AS port, event_id AS line_no, '{"id":' || event_id || '}' AS feature FROM events WHERE event_id % 5 <> 0
""")
def store_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a store, some of them blank: those are no features, but keep their number."""
    lines = table(spark, sf_dir, "events").select(
        _text("run/feature-store/", F.col("event_type"), ".jsonl").alias("path"), F.col("event_id").alias("line_no"),
        F.when(F.col("event_id") % 5 == 0, "  ").otherwise(_text(' {"id":', F.col("event_id"), "} ")).alias("value")
    )
    return text_logs.feature_lines(lines)


@query("""
SELECT event_type AS port, event_id AS line_no, '{"attributes":' || props || ',"id":"e' || event_id || '"}' AS feature FROM events
WHERE (event_type, event_id) IN (SELECT event_type, max(event_id) FROM events GROUP BY 1)
""")
def features_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each port's last feature, found again by port and line in a store that is laid out for it."""
    root = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    rows = event_features(spark, sf_dir)
    text_logs.write_features(rows, root)
    found = [text_logs.feature_at(spark, root, r.port, r.n) for r in rows.groupBy("port").agg(F.max("line_no").alias("n")).orderBy("port").limit(100).collect()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


@query("""
SELECT event_id AS line_no, '{"k":[' || array_to_string(list_transform(range(least(5, 1 + event_id % 9)), lambda i: CAST(i AS VARCHAR)), ',') || CASE WHEN 1 + event_id % 9 > 5 THEN ',"... and ' || (1 + event_id % 9 - 5) || ' more items"' ELSE '' END || '],"pos":[[1,2],[3,4]]}' AS simplified,
  '{"k":[' || array_to_string(list_transform(range(1 + event_id % 9), lambda i: CAST(i AS VARCHAR)), ',') || '],"pos":[[1,2],[3,4]]}' AS elided FROM events
""")
def simplified_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long lists cut with a note; lists under ring keys that are no points stay."""
    return features.elided(features.simplified(_listed(spark, sf_dir, "[[1,2],[3,4]]"))).select("line_no", "simplified", "elided")


def _listed(spark: SparkSession, sf_dir: str, pos: str) -> DataFrame:
    items = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("event_id") % 9).cast("int")), lambda i: i.cast("string")), ",")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("port"), _text('{"k":[', items, f'],"pos":{pos}}}').alias("feature"))


@query("""
SELECT event_id AS line_no, '{"k":[' || array_to_string(list_transform(range(1 + event_id % 9), lambda i: CAST(i AS VARCHAR)), ',') || '],"pos":"(3 coordinates)"}' AS elided FROM events
""")
def elided_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.elided(_listed(spark, sf_dir, "[1.5,2,3]")).select("line_no", "elided")


@query("""
SELECT event_id AS line_no, CAST(u.i AS INTEGER) AS nth, CASE WHEN u.i <= event_id % 9 THEN '.k[' || u.i || ']' ELSE '.pos' END AS path, CASE WHEN u.i <= event_id % 9 THEN CAST(u.i AS VARCHAR) ELSE '"x"' END AS value FROM events, unnest(range(2 + event_id % 9)) AS u(i)
""")
def feature_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.flattened(_listed(spark, sf_dir, '"x"')).select("line_no", "nth", "path", "value")


@query("""
SELECT event_type AS port, event_id AS line_no, '{"id":"e' || event_id || '"}' AS simplified FROM events
""")
def feature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simplified features as files per port, read again."""
    root = f"{shared_dir(spark)}/simplified-{uuid.uuid4().hex}"
    rows = event_features(spark, sf_dir).withColumn("feature", _text('{"id":"e', F.col("line_no"), '"}'))
    reports.feature_files(features.simplified(rows), root)
    return spark.read.schema("line_no long, simplified string, port string").json(root).select("port", "line_no", "simplified")


@query("SELECT event_id, 'v' || (event_id % 3) AS second, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 4 AS VARCHAR) END AS falsy, '' AS missing, hue FROM (SELECT event_id, NULL::BIGINT AS hue FROM events)")
def path_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by paths with indices; falsy and missing ones are empty, and a blank path styles nothing."""
    k = F.col("event_id")
    doc = _text('{"a":[{"b":"x"},{"b":"v', k % 3, '"}],"n":', k % 4, "}")
    return table(spark, sf_dir, "events").select(
        "event_id", text.dot_get(doc, "a[1].b").alias("second"), text.dot_get(doc, ".n").alias("falsy"), text.dot_get(doc, "a[7].b").alias("missing"),
        text.style_hue(doc, "  ").alias("hue")
    )


@query("""
SELECT 'e' || n_nationkey AS id, CASE WHEN n_nationkey % 3 = 1 THEN CAST(n_nationkey AS BIGINT) END AS count FROM nation
""")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the features that passed; stores are there for edges with a named port."""
    nodes, edges = nation_graph(spark, sf_dir)
    index = workflows.port_ids(nodes, edges).where("from_port = 'out'").select("port", F.col("nth").cast("long").alias("count"))
    return workflows.edge_counts(nodes, edges, index).select("id", "count")


@query("SELECT 'e' || n_nationkey AS edge FROM nation WHERE n_nationkey % 4 <> 0")
def missing_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = _text("e", F.col("n_nationkey"))
    nation = table(spark, sf_dir, "nation")
    return workflows.missing_stores(
        nation.select(edge.alias("edge")),
        nation.where("n_nationkey % 4 = 0").select(_text("f/", edge, F.when(F.col("n_nationkey") % 8 == 0, ".jsonl").otherwise(".jsonl.zst")).alias("path"))
    )


@query("""
SELECT * FROM (VALUES ('g1', 0, 'a', 'read', 'g1', true), ('g1', 1, 'b', NULL, 'g1', true), ('g2', 0, 'c', 'write', 'sub', false)) AS v(graph, nth, id, label, graph_name, is_entry)
""")
def workflow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a workflow document; a null graph is left out, a graph without a name goes by its id."""
    said = '{"entryGraphId":"g1","graphs":[{"id":"g1","nodes":[{"id":"a","name":"A","action":"read"},{"id":"b","name":"B","type":"subGraph","subGraphId":"g2"}]},null,{"id":"g2","name":"sub","nodes":[{"id":"c","name":"C","action":"write"}]}]}'
    nodes, _ = workflow_source.workflow_tables(spark, workflow_source.parse_workflow(said))
    return nodes.select("graph", "nth", "id", F.col("action").alias("label"), "graph_name", "is_entry")


@query("""
SELECT CASE WHEN page_id % 2 = 0 THEN 'd/' || page_id || '/x.gml' ELSE 'd/' || page_id || '/x.zip' END AS path, CASE WHEN page_id % 2 = 0 THEN 'd/' || page_id || '/../../codelists' END AS codelists FROM pages
""")
def default_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(_text("d/", F.col("page_id"), F.when(F.col("page_id") % 2 == 0, "/x.gml").otherwise("/x.zip")).alias("path"))
    return workflows.default_siblings(rows).select("path", F.col("beside.codelists").alias("codelists"))


# Repositories


@query("""
SELECT '100644' AS mode, CASE WHEN doc_id % 9 = 0 THEN 'tree' ELSE 'blob' END AS type, 's' || doc_id AS sha, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS size, 'dir with blank/' || doc_id || '.txt' AS file FROM documents
""")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    value = F.when(k % 9 == 0, _text("100644 tree s", k, "       -\tdir with blank/", k, ".txt")).otherwise(
        _text("100644 blob s", k, "  ", F.col("n_chars"), "\tdir with blank/", k, ".txt")
    )
    return text_logs.tree_rows(table(spark, sf_dir, "documents").select(value.alias("value")))


@query("""
SELECT 'f' || n_nationkey AS path, '[dependencies]' || chr(10) || 'one = { git = "https://h/' || (n_nationkey % 2) || '"' || CASE WHEN n_nationkey % 2 = 0 THEN ', branch = "main"' ELSE ', tag = "v' || n_nationkey || '"' END || ' }' || chr(10) || 'two = "1"' || chr(10) AS value FROM nation
""")
def edited_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations whose dependencies on one repository are set to a branch, in place."""
    k = F.col("n_nationkey")
    texts = table(spark, sf_dir, "nation").select(
        _text("f", k).alias("path"), _text('[dependencies]\none = { git = "https://h/', k % 2, '", tag = "v', k, '" }\ntwo = "1"\n').alias("value")
    )
    blocks = text_logs.dependency_blocks(texts)
    return repositories.apply_rewrites(texts, repositories.rewrite_dependencies(blocks, "https://h/0", "main"))


@query("SELECT 'f' || n_nationkey AS path, CAST(u.i AS INTEGER) AS nth, CASE u.i WHEN 0 THEN 'one' ELSE 'two-b' END AS name, CASE u.i WHEN 0 THEN ' git = \"g\" ' ELSE chr(10) || '  path = \"' || n_nationkey || '\",' || chr(10) END AS body FROM nation, unnest(range(2)) AS u(i)")
def dependency_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    texts = table(spark, sf_dir, "nation").select(_text("f", k).alias("path"), _text('one = { git = "g" }\nthree = "3"\ntwo-b = {\n  path = "', k, '",\n}\n').alias("value"))
    return text_logs.dependency_blocks(texts).drop("block")


@query("SELECT event_id FROM events WHERE user_id % 5 <> 0 AND ts >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 7 DAY")
def changes_by_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts"), _text("u", F.col("user_id") % 5).alias("author"))
    return repositories.by_others(rows, "u0", F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00'")).select("event_id")


@query("SELECT o_orderstatus || ';main ' || count(*) AS value FROM orders GROUP BY o_orderstatus")
def stack_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(_text(F.col("o_orderstatus"), ";main").alias("stack"), F.lit(1).alias("count"))
    return reports.stack_lines(repositories.collapse_stacks(rows))


# Load benchmarks


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a benchmark as JSON lines, one of fifty no JSON at all."""
    k = F.col("o_orderkey")
    line = _text(
        '{"codec":"', F.col("o_orderstatus"), '","rep":', k % 2, ',"name":"http://h/', F.when(k % 3 == 0, "tiles").otherwise("other"), "/", k,
        '","startTime":', k, ',"fetchStart":', k, ',"requestStart":', k + 1, ',"responseStart":', k + 3, ',"responseEnd":', k + 7,
        ',"transferSize":1048576}'
    )
    return table(spark, sf_dir, "orders").select(F.when(k % 50 == 0, "{broken").otherwise(line).alias("value"))


@query("""
SELECT o_orderstatus AS codec, CAST(o_orderkey % 2 AS INTEGER) AS rep, count(*) AS requests, CAST(count(*) AS DOUBLE) AS transfer_mb, 1.0 AS avg_queued_ms, 2.0 AS avg_ttfb_ms, 4.0 AS avg_download_ms FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 3 = 0 AND o_orderkey >= 99 GROUP BY ALL
""")
def sampled_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network statistics of the requests for one folder since a run began."""
    rows = browser_samples.parse_samples(order_samples(spark, sf_dir), "requests").where("error IS NULL")
    return load_bench.network_stats(load_bench.of_folder(rows, "/tiles/", 100)).select("codec", "rep", "requests", "transfer_mb", "avg_queued_ms", "avg_ttfb_ms", "avg_download_ms")


@query("SELECT count(*) AS broken FROM orders WHERE o_orderkey % 50 = 0")
def broken_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browser_samples.parse_samples(order_samples(spark, sf_dir), "requests").where("error IS NOT NULL").agg(F.count("*").alias("broken"))


@query("""
WITH s AS (SELECT event_type AS codec, count(*) AS n, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(min(value), 2) AS min, round(max(value), 2) AS max FROM events GROUP BY 1)
SELECT codec, n, mean, std, min, max FROM s
""")
def bench_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's metrics as one JSON object per codec, read again."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("codec"), "value", F.lit(None).cast("string").alias("error"))
    made = reports.bench_json(load_bench.codec_stats(runs, ["value"]))
    metric = "struct<n:long,mean:double,std:double,min:double,max:double>"
    return made.select(F.from_json("value", f"codec string, metrics struct<value:{metric}>").alias("j")).select("j.codec", "j.metrics.value.*")


# Pictures and scalar functions


@query("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS w, p_size / 2.0 AS h FROM part), s AS (SELECT *, least(700 / w, 500 / h) AS k FROM p)
SELECT p_partkey, '<path style="fill:none;stroke:#1f4e79" d="M50.0,550.0 L' || CAST((w - 0.0) * k + 50 AS VARCHAR) || ',' || CAST(600 - ((h - 0.0) * k + 50) AS VARCHAR) || '"/>' AS shape FROM s
""")
def line_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("p_size").cast("double")
    line = _text("[[0.0,0.0],[", w, ",", w / 2, "]]")
    return table(spark, sf_dir, "part").select("p_partkey", reports.geometry_svg(F.lit("LineString"), line).alias("shape"))


@query("""
SELECT p_partkey, p_size % 6 AS kind, CASE p_size % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 2 ELSE 4 END AS paths, CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS points FROM part
""")
def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every geometry type as shapes of a whole document: areas and holes, lines, points."""
    ring, hole = "[[0,0],[9,0],[9,9],[0,9],[0,0]]", "[[2,2],[4,2],[4,4],[2,2]]"
    made = [
        ("Point", "[1,2]"), ("MultiPoint", "[[1,2],[3,4]]"), ("LineString", ring), ("MultiLineString", f"[{ring},{hole}]"),
        ("Polygon", f"[{ring},{hole}]"), ("MultiPolygon", f"[[{ring},{hole}],[{ring},{hole}]]")
    ]
    pick = lambda i: F.element_at(F.array(*(F.lit(m[i]) for m in made)), (F.col("p_size") % 6 + 1).cast("int"))
    doc = reports.svg_document(F.col("p_name"), F.array(*(F.lit(float(v)) for v in (0, 0, 9, 9))), reports.geometry_svg(pick(0), pick(1)))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).cast("long").alias("kind"), doc.alias("doc"))
    count = lambda mark: F.regexp_count("doc", F.lit(mark)).cast("long")
    return rows.select("p_partkey", "kind", count("<path ").alias("paths"), count("<circle ").alias("points"))


@query("""
WITH p AS (SELECT o_orderkey, (o_totalprice - 100000) * 50 AS mx, (o_custkey * 731.0) - 300000 AS my, o_orderkey % 15 AS z FROM orders), s AS (SELECT *, 2 * 20037508.342789244 / pow(2, z) AS w FROM p),
t AS (SELECT o_orderkey, round((mx - (floor((mx + 20037508.342789244) / w) * w - 20037508.342789244)) / w, 6) AS u, round((my - (20037508.342789244 - (floor((20037508.342789244 - my) / w) + 1) * w)) / w, 6) AS v FROM s)
SELECT o_orderkey, u, v, o_orderkey % 3 AS depth FROM t
""")
def tile_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, lines and rings of orders in their tiles' space, each mapped by its type."""
    k = F.col("o_orderkey") % 3
    point = F.to_json(F.array((F.col("o_totalprice") - 100000) * 50, F.col("o_custkey") * F.lit(731.0) - 300000))
    gtype = F.when(k == 0, "Point").when(k == 1, "LineString").otherwise("Polygon")
    coords = F.when(k == 0, point).when(k == 1, _text("[", point, "]")).otherwise(_text("[[", point, "]]"))
    mapped = vector_tiles.geometry_to_tile_space(gtype, coords, F.col("o_orderkey") % 15)
    first = F.from_json(F.regexp_replace(mapped, r"^\[+(.*?)\]+$", "[$1]"), "array<double>")
    depth = F.length(F.regexp_extract(mapped, r"^(\[+)", 1)) - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", first[0].alias("u"), first[1].alias("v"), depth.cast("long").alias("depth"))


@query("""
SELECT p_partkey, p_retailprice / 2 AS cx, p_size / 2.0 AS cy, round(sqrt(p_retailprice * p_retailprice + p_size * p_size) / 2, 6) AS half, printf('%.1f', round(p_partkey / 1024.0, 1)) || ' KiB' AS kib,
  CASE p_size % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'line' WHEN 2 THEN 'other' ELSE 'other' END AS family, p_size AS numbers FROM part
""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    extent = F.array(F.lit(0.0), F.lit(0.0), F.col("p_retailprice"), F.col("p_size").cast("double"))
    kind = F.element_at(F.array(*map(F.lit, ["MultiPoint", "LineString", "Polygon", "Unknown"])), (F.col("p_size") % 4 + 1).cast("int"))
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), lambda i: _text(i, ".5")), " \n\t ")
    centre = geometry.extent_centre(extent)
    return table(spark, sf_dir, "part").select(
        "p_partkey", centre[0].alias("cx"), centre[1].alias("cy"), F.round(geometry.half_diagonal(extent), 6).alias("half"), text.kib(F.col("p_partkey")).alias("kib"), text.geometry_family(kind).alias("family"), F.size(text.floats(numbers)).alias("numbers"),
    )


@query("""
SELECT p_partkey, CASE WHEN s = 0 THEN 255 WHEN k = 0 OR k = 5 THEN 255 WHEN k = 2 OR k = 3 THEN 0 ELSE 127 END AS red, CASE WHEN s = 0 THEN 255 WHEN k = 1 OR k = 2 THEN 255 WHEN k = 4 OR k = 5 THEN 0 ELSE 127 END AS green
FROM (SELECT p_partkey, p_size % 6 AS k, p_partkey % 2 AS s FROM part)
""")
def hue_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in the middle of each sixth of the circle, half of them without saturation."""
    rgb = text.hsv_rgb((F.col("p_size") % 6 + 0.5) / 6, (F.col("p_partkey") % 2).cast("double"), F.lit(1.0))
    return table(spark, sf_dir, "part").select("p_partkey", rgb[0].alias("red"), rgb[1].alias("green"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, event_id * 2 AS k FROM events")
def stamps_and_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.create_map(F.lit("geometry"), F.lit("g"), F.lit("k"), (F.col("event_id") * 2).cast("string"))
    kept = vector_tiles.plain_properties(props)
    return table(spark, sf_dir, "events").select("event_id", text.stamp(F.col("ts")).alias("stamp"), F.when(F.size(kept) == 1, kept["k"].cast("long")).alias("k"))


@query("""
SELECT p_partkey, list_transform([0.0, 0.25, 0.5, 0.75, 1.0], lambda t: round(exp(ln(2) + t * (ln(p_size + 2) - ln(2))) - 1, 6)) AS steps FROM part
""")
def legends(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(text.legend(F.lit(1), F.col("p_size") + 1), lambda v: F.round(v, 6))
    return table(spark, sf_dir, "part").select("p_partkey", steps.alias("steps"))


@query("SELECT DISTINCT 'a/' || p_brand AS root FROM part")
def tile_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.functions.tiles import tile_root

    path = _text("a/", F.col("p_brand"), "/3/", F.col("p_partkey"), "/2.mvt")
    return table(spark, sf_dir, "part").select(tile_root(path).alias("root")).distinct().orderBy("root")
