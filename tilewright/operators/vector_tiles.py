"""Vector tiles: geometry validity, counts, selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import extents_overlap
from tilewright.functions.tiles import within_tile

SELECTION_CELLS, GRID_CELLS = 8, 128
#: Coordinates as texts below the level that counts: their numbers are never read.
_POINTS, _RINGS, _POLYGONS = "array<string>", "array<array<string>>", "array<array<array<string>>>"


def _shape(gtype: Column, coordinates: Column) -> Column:
    """What validity needs of a geometry, parsed once by its type: points, or sizes of rings, or of polygons' rings."""
    sizes = lambda parts: F.transform(parts, lambda r: F.greatest(F.coalesce(F.size(r), F.lit(0)), F.lit(0)))
    lines = gtype.isin("Polygon", "MultiLineString")
    return F.struct(
        F.when(gtype.isin("Point", "LineString"), F.greatest(F.coalesce(F.size(F.from_json(coordinates, _POINTS)), F.lit(0)), F.lit(0))).alias("points"),
        F.when(lines, F.coalesce(sizes(F.from_json(coordinates, _RINGS)), F.array().cast("array<int>"))).alias("rings"),
        F.when(gtype == "MultiPolygon", F.coalesce(F.transform(F.from_json(coordinates, _POLYGONS), lambda p: F.coalesce(sizes(p), F.array().cast("array<int>"))), F.array().cast("array<array<int>>"))).alias("polygons"),
    )


def _first(items: Column, bad: Callable[[Column], Column]) -> Column:
    """Index (from 0) of the first bad item, null if none."""
    at = F.array_position(F.transform(items, bad), True)
    return F.when(at > 0, (at - 1).cast("int"))


def _reason(gtype: Column, coordinates: Column, shape: Column) -> Column:
    points, rings, polygons = shape["points"], shape["rings"], shape["polygons"]
    ring, line = _first(rings, lambda n: n < 3), _first(rings, lambda n: n < 2)
    poly = _first(polygons, lambda p: (F.size(p) == 0) | F.exists(p, lambda n: n < 3))
    inner = F.get(polygons, poly)
    inner_ring = _first(inner, lambda n: n < 3)
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return (
        F.when(gtype.isNull(), "null geometry")
        .when(coordinates.isNull() | (coordinates == "null"), "null coordinates")
        .when((gtype == "Point") & (points == 0), "empty point")
        .when((gtype == "LineString") & (points < 2), said("linestring with ", points, " points"))
        .when((gtype == "Polygon") & (F.size(rings) == 0), "empty polygon")
        .when((gtype == "Polygon") & ring.isNotNull(), said("polygon ring ", ring, " has ", F.get(rings, ring), " points (need >= 3)"))
        .when((gtype == "MultiPolygon") & (F.size(polygons) == 0), "empty multipolygon")
        .when((gtype == "MultiPolygon") & poly.isNotNull() & (F.size(inner) == 0), said("multipolygon[", poly, "] is empty"))
        .when((gtype == "MultiPolygon") & poly.isNotNull(), said("multipolygon[", poly, "] ring ", inner_ring, " has ", F.get(inner, inner_ring), " points"))
        .when((gtype == "MultiLineString") & (F.size(rings) == 0), "empty multilinestring")
        .when((gtype == "MultiLineString") & line.isNotNull(), said("multilinestring[", line, "] has ", F.get(rings, line), " points"))
    )


def invalid_reason(gtype: Column, coordinates: Column) -> Column:
    """Why a geometry is invalid, the first rule that fails; null if valid. Coordinates are JSON; MultiPoint is not checked."""
    return F.transform(F.array(_shape(gtype, coordinates)), lambda s: _reason(gtype, coordinates, s))[0]


def mvt_findings(features: DataFrame) -> DataFrame:
    """(path, layer, nth, gml_id, gtype, reason) of invalid features; without an id the place stands for it."""
    name = F.coalesce(F.col("props")["gml_id"], F.concat(F.lit("<no gml_id #"), F.col("nth").cast("string"), F.lit(">")))
    return features.where("error IS NULL").select(
        "path", "layer", "nth", name.alias("gml_id"), "gtype", invalid_reason(F.col("gtype"), F.col("coordinates")).alias("reason")
    ).where("reason IS NOT NULL")


def type_counts(features: DataFrame) -> DataFrame:
    """Features per (path, layer, gtype); null geometries don't count, null coordinates do."""
    return features.where("gtype IS NOT NULL").groupBy("path", "layer", "gtype").agg(F.count("*").alias("n")).orderBy("path", "layer", "gtype")


def invalid_counts(findings: DataFrame) -> DataFrame:
    """Invalid features per layer; which they are stays in rows of their own, in ``findings``."""
    return findings.groupBy("path", "layer").agg(F.count("*").alias("invalid"))


def compare_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Type counts of two sets of tiles by (tile, layer, gtype); an extension: rows where the counts differ. Paths are relative."""
    left, right = (type_counts(x).withColumnRenamed("n", n) for x, n in ((a, "n_a"), (b, "n_b")))
    both = left.join(right, ["path", "layer", "gtype"], "full_outer")
    return both.select("path", "layer", "gtype", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).where("n_a <> n_b")


def select_box(features: DataFrame, selections: DataFrame) -> DataFrame:
    """Features (extent) that overlap a selection (box), over visible layers.

    Boxes and extents meet over the cells of a grid that lays SELECTION_CELLS
    cells along the longest box, and at most GRID_CELLS along where all boxes
    are, so any number of boxes is an equi join; a pair counts in the first cell
    that both touch. Extents are cut to where boxes are.
    """
    box = F.col("box")
    bound = selections.agg(
        F.min(box[0]).alias("_x0"), F.min(box[1]).alias("_y0"), F.max(box[2]).alias("_x1"), F.max(box[3]).alias("_y1"),
        (F.greatest(F.max(box[2] - box[0]), F.max(box[3] - box[1])) / SELECTION_CELLS).alias("_w"),
    ).withColumn("_w", F.greatest("_w", (F.col("_x1") - F.col("_x0")) / GRID_CELLS, (F.col("_y1") - F.col("_y0")) / GRID_CELLS))
    bound = bound.withColumn("_w", F.when(F.col("_w") > 0, F.col("_w")).otherwise(1.0))

    def celled(rows: DataFrame, extent: Column, pre: str) -> DataFrame:
        rows = rows.join(bound, F.lit(True)).where((extent[0] <= F.col("_x1")) & (extent[2] >= F.col("_x0")) & (extent[1] <= F.col("_y1")) & (extent[3] >= F.col("_y0")))
        cell = lambda at, low, high, origin: F.floor((F.least(F.greatest(at, F.col(low)), F.col(high)) - F.col(origin)) / F.col("_w")).cast("long")
        xs = cell(extent[0], "_x0", "_x1", "_x0"), cell(extent[2], "_x0", "_x1", "_x0")
        ys = cell(extent[1], "_y0", "_y1", "_y0"), cell(extent[3], "_y0", "_y1", "_y0")
        rows = rows.withColumns({f"_{pre}x": xs[0], f"_{pre}y": ys[0], "_ex": xs[1], "_ey": ys[1]})
        rows = rows.withColumn("_cx", F.explode(F.sequence(F.col(f"_{pre}x"), F.col("_ex")))).withColumn("_cy", F.explode(F.sequence(F.col(f"_{pre}y"), F.col("_ey"))))
        return rows.drop("_x0", "_y0", "_x1", "_y1", "_w", "_ex", "_ey")

    met = celled(features.where("visible"), F.col("extent"), "f").join(celled(selections, box, "s"), ["_cx", "_cy"])
    first = (F.col("_cx") == F.greatest("_fx", "_sx")) & (F.col("_cy") == F.greatest("_fy", "_sy"))
    return met.where(first & extents_overlap(F.col("extent"), box)).drop("_cx", "_cy", "_fx", "_fy", "_sx", "_sy")


def plain_properties(props: Column) -> Column:
    """Properties but the geometry."""
    return F.map_filter(props, lambda k, v: k != "geometry")


#: How many lists deep each geometry type nests its points.
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def to_tile_space(rings: Column, zoom: Column, depth: int = 2) -> Column:
    """Web-Mercator coordinates, nested ``depth`` lists deep, in their tiles' 0-1 space: 0 a point, 1 a line, 2 rings, 3 polygons."""
    if depth == 0:
        place = within_tile(rings[0], rings[1], zoom)
        return F.array(place["x"], place["y"])
    return F.transform(rings, lambda part: to_tile_space(part, zoom, depth - 1))


def geometry_to_tile_space(gtype: Column, coordinates: Column, zoom: Column) -> Column:
    """Coordinates as JSON, mapped by the geometry's type; null for types that are not known."""
    out = F.lit(None).cast("string")
    for kind, depth in DEPTHS.items():
        shape = "array<" * (depth + 1) + "double" + ">" * (depth + 1)
        out = F.when(gtype == kind, F.to_json(to_tile_space(F.from_json(coordinates, shape), zoom, depth))).otherwise(out)
    return out
