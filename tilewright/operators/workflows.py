"""Workflow graphs: topology, subgraph edges, ports, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import node_width
from tilewright.functions.text import node_label


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, nth, src, from_port, dst, to_port) with node names; a node that is not there is named by its id's last eight characters."""
    names = nodes.select(F.col("graph").alias("_g"), F.col("id").alias("_id"), F.col("name").alias("_name"))
    for side in ("src", "dst"):
        own = names.withColumnsRenamed({"_g": f"_g_{side}", "_id": f"_id_{side}", "_name": f"_name_{side}"})
        edges = edges.join(own, (F.col("graph") == F.col(f"_g_{side}")) & (F.col(side) == F.col(f"_id_{side}")), "left")
    named = lambda side: F.coalesce(f"_name_{side}", F.right(F.col(side), F.lit(8))).alias(side)
    return edges.select("graph", "nth", named("src"), "from_port", named("dst"), "to_port")


def labelled(nodes: DataFrame) -> DataFrame:
    """Nodes with their label: the action, or the subgraph they stand for."""
    return nodes.withColumn("label", node_label(F.col("action"), F.col("subgraph")))


def edge_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge) ids of all edges, those of a subgraph once per node of the entry graph that stands for it; one level deep."""
    instances = nodes.where("is_entry AND type = 'subGraph'").select(F.col("subgraph").alias("_sub"), F.col("id").alias("_instance"))
    inner = edges.where("NOT is_entry").join(instances, F.col("graph") == F.col("_sub"))
    return edges.where("is_entry").select(F.col("id").alias("edge")).unionByName(inner.select(F.concat_ws(".", "_instance", "id").alias("edge")))


def port_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their port: ``parent.from.port`` in a subgraph, ``from.port`` else; the last parent counts, the port is ``default`` where none is named."""
    parents = nodes.where("type = 'subGraph'").groupBy(F.col("subgraph").alias("_sub")).agg(F.max_by("id", F.struct("graph", "nth")).alias("_parent"))
    port = F.coalesce(F.nullif(F.col("from_port"), F.lit("")), F.lit("default"))
    return edges.join(parents, F.col("graph") == F.col("_sub"), "left").withColumn("port", F.concat_ws(".", "_parent", "src", port)).drop("_sub", "_parent")


def edge_counts(nodes: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges with the number of features that passed, null where the store has none."""
    return port_ids(nodes, edges).join(index.select("port", "count"), "port", "left")


def layout_bounds(placed: DataFrame) -> DataFrame:
    """Bounding box of laid-out nodes (x, y at the centre, width or a label's width, height)."""
    w = F.coalesce("width", node_width(F.col("name")))
    return placed.agg(
        F.min(F.col("x") - w / 2).alias("min_x"), F.min(F.col("y") - F.col("height") / 2).alias("min_y"), F.max(F.col("x") + w / 2).alias("max_x"),
        F.max(F.col("y") + F.col("height") / 2).alias("max_y")
    )


def missing_stores(edge_rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Edges whose store file isn't there yet: what a fetch has still to bring."""
    have = listing.select(F.regexp_extract("path", r"([^/]+?)\.jsonl(?:\.zst)?$", 1).alias("_edge")).distinct()
    return edge_rows.join(have, F.col("edge") == F.col("_edge"), "left_anti")


def default_siblings(inputs: DataFrame) -> DataFrame:
    """Paths with the folders beside a ``.gml`` input that its run also reads."""
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    beside = F.when(
        F.col("path").endswith(".gml"),
        F.struct(F.concat(folder, F.lit("../../codelists")).alias("codelists"), F.concat(folder, F.lit("../../schemas")).alias("schemas"))
    )
    return inputs.withColumn("beside", beside)
