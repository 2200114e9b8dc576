"""Implicit tilesets: walking subtrees, merging cells, their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import log_hue
from tilewright.functions.tiles import bit_at, cell_region, child, level_offset, morton, uri
from tilewright.plans import cut


def _available(subtrees: DataFrame, kind: str, cells: DataFrame) -> DataFrame:
    """Cells (index) of each subtree where the availability of that kind is set."""
    rows = subtrees.where(F.col("kind") == kind).crossJoin(F.broadcast(cells))
    return rows.where(F.coalesce("constant", bit_at(F.col("bits"), F.col("index"))) == 1)


def walk_tileset(tileset: DataFrame, subtrees: DataFrame, listing: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(tiles, warnings) of an implicit quadtree tileset.

    ``subtrees`` are the decoded subtree files and ``listing`` (path, size,
    features) the files that exist, all below ``base``. One step per generation
    of subtrees: the frontier of roots joins the files by path; a generation is
    written before the next, so plans stay short. A content file counts once,
    where it comes first; files that lack are warnings.
    """
    spec = tileset.first()
    spark, levels, root = tileset.sparkSession, spec["subtree_levels"], base.rstrip("/")
    # One small relative grid of cells serves every subtree: its size is fixed by the tileset.
    axis = spark.range(1 << (levels - 1)).toDF("rx") if levels else spark.range(0).toDF("rx")
    cells = spark.range(levels).select(F.col("id").cast("int").alias("rel")).join(axis, F.expr("rx < shiftleft(1L, rel)")).join(axis.toDF("ry"), F.expr("ry < shiftleft(1L, rel)"))
    cells = cells.withColumn("index", level_offset(F.col("rel")) + morton(F.col("rx"), F.col("ry")))
    leaf = spark.range(1 << levels).toDF("rx").join(spark.range(1 << levels).toDF("ry"), F.lit(True)).withColumn("index", morton(F.col("rx"), F.col("ry")))
    frontier = spark.createDataFrame([(0, 0, 0)], "root_level int, root_x long, root_y long")
    content, warnings, templates = [], [], spec["content_uris"]
    while True:
        named = frontier.withColumn("uri", uri(F.lit(spec["subtree_uri"]), F.col("root_level"), F.col("root_x"), F.col("root_y")))
        found = cut(named.join(subtrees.where("error IS NULL").withColumnRenamed("path", "_path"), F.concat(F.lit(f"{root}/"), F.col("uri")) == F.col("_path"), "left"), "subtrees")
        warnings.append(found.where("_path IS NULL").select(F.lit("missing subtree file").alias("warning"), "uri"))
        tile = _available(found, "tile", cells).select("_path", "index")
        slots = _available(found, "content", cells).join(tile, ["_path", "index"], "left_semi")
        placed = slots.select(
            (F.col("root_level") + F.col("rel")).alias("level"), child(F.col("root_x"), F.col("rel"), F.col("rx")).alias("x"), child(F.col("root_y"), F.col("rel"), F.col("ry")).alias("y"), "slot",
        )
        template = F.element_at(F.array(*(F.lit(t) for t in templates)), F.col("slot") + 1)
        content.append(placed.withColumn("uri", uri(template, F.col("level"), F.col("x"), F.col("y"))))
        frontier = cut(
            _available(found, "child", leaf).select(
                (F.col("root_level") + levels).alias("root_level"), child(F.col("root_x"), F.lit(levels), F.col("rx")).alias("root_x"),
                child(F.col("root_y"), F.lit(levels), F.col("ry")).alias("root_y")
            ),
            "frontier"
        )
        if frontier.isEmpty():
            break
    rows = reduce(DataFrame.unionByName, content)
    once = rows.groupBy("uri").agg(F.min(F.struct("level", "y", "x", "slot")).alias("t")).select("t.level", "t.x", "t.y", "t.slot", "uri")
    there = listing.select(F.col("path").alias("_path"), "size", "features")
    met = once.join(there, F.concat(F.lit(f"{root}/"), F.col("uri")) == F.col("_path"), "left")
    warnings.append(met.where("_path IS NULL").select(F.lit("missing content file").alias("warning"), "uri"))
    region = F.array(*(F.lit(float(v)) for v in spec["region"]))
    tiles = met.where("_path IS NOT NULL").select("level", "x", "y", "slot", cell_region(F.col("level"), F.col("x"), F.col("y"), region).alias("region"), "size", "features", "uri")
    return tiles, reduce(DataFrame.unionByName, warnings)


def feature_count(json_col: str = "json"):  # noqa: ANN201
    """Features of a GLB: the sum of its property tables' counts, null without tables or JSON."""
    counts = F.from_json(F.get_json_object(json_col, "$.extensions.EXT_structural_metadata.propertyTables"), "array<struct<count:long>>")
    return F.when(F.size(counts) > 0, F.aggregate(counts, F.lit(0).cast("long"), lambda s, t: s + F.coalesce(t["count"], F.lit(0).cast("long"))))


def within_levels(tiles: DataFrame, a: int, b: int) -> DataFrame:
    """Tiles of the levels from the lesser to the greater bound."""
    return tiles.where(F.col("level").between(min(a, b), max(a, b)))


def merge_cells(tiles: DataFrame) -> DataFrame:
    """One row per (level, x, y): features (0 if all unknown), known_slots, size and its slots in order."""
    slot = F.struct(*(F.col(c) for c in tiles.columns if c not in ("level", "x", "y", "region")))
    return tiles.groupBy("level", "x", "y").agg(
        F.coalesce(F.sum("features"), F.lit(0)).cast("long").alias("features"), F.count("features").alias("known_slots"), F.sum("size").cast("long").alias("size"), F.array_sort(F.collect_list(slot)).alias("slots"),
    )


def cell_colours(cells: DataFrame, measure: str = "features") -> DataFrame:
    """Cells with the hue of their measure on the log scale from the least to the greatest."""
    span = cell_range(cells, measure)
    return cells.crossJoin(F.broadcast(span)).withColumn("hue", log_hue(F.col(measure), F.col("low"), F.col("high"))).drop("low", "high")


def cell_range(cells: DataFrame, measure: str = "features") -> DataFrame:
    """One row: least and greatest measure, 0 and 1 without any."""
    return cells.agg(F.coalesce(F.min(measure), F.lit(0)).alias("low"), F.coalesce(F.max(measure), F.lit(1)).alias("high"))


def cell_totals(cells: DataFrame, all_tiles: DataFrame) -> DataFrame:
    """One row: visible cells, their features and size, and the exact number of cells of all levels."""
    return cells.agg(F.count("*").alias("tiles"), F.coalesce(F.sum("features"), F.lit(0)).cast("long").alias("total_features"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size")).crossJoin(
        all_tiles.select("level", "x", "y").distinct().agg(F.count("*").alias("all_tiles"))
    )


def first_with_rest(rows: DataFrame, order: list[str], n: int) -> tuple[DataFrame, int]:
    """The first n rows of a report and how many are left out."""
    return rows.orderBy(*order).limit(n), max(0, rows.count() - n)
