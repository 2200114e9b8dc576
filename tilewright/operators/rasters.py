"""Depth rasters: pixel-wise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _hit(depth: Column) -> Column:
    return depth.isNotNull() & ~F.isnan(depth) & (F.abs(depth) < float("inf"))


def diff_pixels(truth: DataFrame, flow: DataFrame, scale: float = 1.0, by: list[str] = ("y", "x")) -> DataFrame:
    """(y, x, truth, flow, kind, red, green, blue): both, only_truth, only_flow or neither.

    Where both hit, the difference scaled to 0-255 is green if flow is farther,
    else red; only_truth is full red, only_flow full green, neither black.
    """
    a, b = (d.select(*by, F.col("depth").cast("double").alias(n)) for d, n in ((truth, "truth"), (flow, "flow")))
    met = a.join(b, list(by), "full_outer")
    ta, fb = _hit(F.col("truth")), _hit(F.col("flow"))
    kind = F.when(ta & fb, "both").when(ta, "only_truth").when(fb, "only_flow").otherwise("neither")
    apart = F.col("flow") - F.col("truth")
    shade = F.floor(F.least(F.lit(1.0), F.abs(apart) / scale) * 255).cast("int")
    marked = met.select(*by, "truth", "flow", kind.alias("kind"))
    return marked.withColumns({
        "red": F.when(F.col("kind") == "only_truth", 255).when((F.col("kind") == "both") & ~(apart > 0), shade).otherwise(0),
        "green": F.when(F.col("kind") == "only_flow", 255).when((F.col("kind") == "both") & (apart > 0), shade).otherwise(0),
        "blue": F.lit(0),
    })


def diff_summary(pixels: DataFrame) -> DataFrame:
    """Counts per kind and the greatest absolute difference, 0 without any."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(k)
    gap = F.max(F.when(F.col("kind") == "both", F.abs(F.col("flow") - F.col("truth"))))
    return pixels.agg(count("both"), count("only_truth"), count("only_flow"), F.coalesce(gap, F.lit(0.0)).alias("max_abs_diff"))


def same_shape(truth: DataFrame, flow: DataFrame) -> bool:
    """Whether two rasters have one height and width; callers stop otherwise."""
    size = lambda d: d.agg(F.max("y"), F.max("x"), F.count("*")).first()
    return size(truth) == size(flow)
