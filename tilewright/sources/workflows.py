"""Workflow graphs as node and edge tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

NODES = "graph string, graph_name string, is_entry boolean, nth int, id string, name string, action string, type string, subgraph string"
EDGES = "graph string, is_entry boolean, nth int, id string, src string, dst string, from_port string, to_port string"


def parse_workflow(text: str) -> dict:
    """A workflow document from JSON or, where PyYAML is there, YAML; ``!include`` items become null."""
    try:
        return json.loads(text)
    except ValueError:
        import yaml  # an optional reader for YAML documents

        class Loader(yaml.SafeLoader):
            pass

        Loader.add_constructor("!include", lambda loader, node: None)
        return yaml.load(text, Loader)  # noqa: S506  a subclass of the safe loader


def graphs_of(doc: dict) -> list[dict]:
    """The document's graphs, or the document itself if it has nodes."""
    return [g for g in doc.get("graphs") or ([doc] if "nodes" in doc else []) if g]


def workflow_tables(spark: SparkSession, doc: dict) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a workflow; a workflow is a small document."""
    entry, nodes, edges = doc.get("entryGraphId"), [], []
    for g in graphs_of(doc):
        gid = g.get("id")
        first = gid == entry or (entry is None and "graphs" not in doc)
        nodes += [(gid, g.get("name", gid), first, i, n["id"], n.get("name"), n.get("action"), n.get("type"), n.get("subGraphId")) for i, n in enumerate(g.get("nodes") or [])]
        edges += [(gid, first, i, e["id"], e["from"], e["to"], e.get("fromPort"), e.get("toPort")) for i, e in enumerate(g.get("edges") or [])]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def read_workflow(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return workflow_tables(spark, parse_workflow(spark.read.text(path, wholetext=True).first()[0]))
