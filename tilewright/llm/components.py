"""Connected components by alternating large and small stars.

Each round is a min-aggregate and a join on node keys; edges and minima are
written to the shared folder between steps, so lineage stays short, lost
executors cost one step, and both sides of each join come straight from files,
which lets the adaptive planner split a hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans import cut, forget


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step on (a, b) edges, which are deleted: each node's larger (or smaller) neighbours move to its least neighbour."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if not small:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "stars")
    met = both.join(least, "u")
    if small:
        moved = met.select(F.col("v").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("low").alias("b")))
    else:
        moved = met.where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))
    made = cut(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    forget(edges, least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the (a, b) edges other than a root; the root is the component's least node."""
    now = cut(edges.select("a", "b").where("a <> b"), "edges")
    # Unsigned sums of hashes, wrapped by xor, tell whether a round changed the edge set.
    mark = lambda df: df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    last = mark(now)
    while last[0]:
        now = _star(_star(now, small=False), small=True)
        this = mark(now)
        if this == last:
            break
        last = this
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
