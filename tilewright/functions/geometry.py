"""Vectors, cameras, extents and layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The picture's size, and how far a camera without a picked point looks.
SVG_WIDTH, SVG_HEIGHT, SVG_PADDING = 800, 600, 50
FALLBACK_DISTANCE = 500.0


def extent_centre(extent: Column) -> Column:
    """Middle of (min x, min y, max x, max y)."""
    return F.array((extent[0] + extent[2]) / 2, (extent[1] + extent[3]) / 2)


def half_diagonal(extent: Column) -> Column:
    return F.hypot(extent[2] - extent[0], extent[3] - extent[1]) / 2


def extents_overlap(a: Column, b: Column) -> Column:
    """Two extents share a point; edges count."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def ring_extent(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def svg_scale(extent: Column) -> Column:
    """The scale that fits an extent into the padded picture; 1 for an extent without width and height."""
    fit = lambda room, size: F.when(size > 0, (room - 2 * SVG_PADDING) / size)
    return F.coalesce(F.least(fit(SVG_WIDTH, extent[2] - extent[0]), fit(SVG_HEIGHT, extent[3] - extent[1])), F.lit(1.0))


def svg_place(point: Column, extent: Column) -> Column:
    """A point's place (x, y) in the picture, y turned downwards."""
    scale = svg_scale(extent)
    x, y = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    return F.struct(((x - extent[0]) * scale + SVG_PADDING).alias("x"), (SVG_HEIGHT - ((y - extent[1]) * scale + SVG_PADDING)).alias("y"))


def svg_path(points: Column, extent: Column) -> Column:
    """Closed SVG path of a ring."""

    def place(p: Column, i: Column) -> Column:
        at = svg_place(p, extent)
        return F.concat(F.when(i == 0, "M").otherwise("L"), at["x"].cast("string"), F.lit(","), at["y"].cast("string"))

    return F.concat(F.array_join(F.transform(points, place), " "), F.lit(" Z"))


def fit_layout(width: Column, height: Column, graph_width: Column, graph_height: Column) -> Column:
    """Scale (at most 1, a margin of 100 around) and translation that centre a graph."""
    scale = F.least(width / (graph_width + 100), height / (graph_height + 100), F.lit(1.0))
    return F.struct(scale.alias("scale"), ((width - graph_width * scale) / 2).alias("dx"), ((height - graph_height * scale) / 2).alias("dy"))


def node_width(label: Column) -> Column:
    """Box width for a label: six per character and twenty, at least a hundred."""
    return F.greatest(F.lit(100), F.length(label) * 6 + 20)


def look_at(position: Column, direction: Column, picked: Column) -> Column:
    """The picked point, or a point FALLBACK_DISTANCE along the view where none was picked."""
    return F.coalesce(picked, F.zip_with(position, direction, lambda p, d: p + d * FALLBACK_DISTANCE))


def camera_toml(name: Column, position: Column, direction: Column, up: Column, fov_y: Column, picked: Column, table: str = "cameras") -> Column:
    """A camera as a TOML table: near is a hundredth (at least 0.1) and far ten times the distance looked at."""
    target = look_at(position, direction, picked)
    apart = F.sqrt(F.aggregate(F.zip_with(position, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    distance = F.when(picked.isNull(), F.lit(FALLBACK_DISTANCE)).otherwise(apart)
    fixed = lambda v, n: F.format_string(f"%.{n}f", v)
    vector = lambda v: F.concat(F.lit("["), fixed(v[0], 3), F.lit(", "), fixed(v[1], 3), F.lit(", "), fixed(v[2], 3), F.lit("]"))
    # The table's keys in order, and the decimals of their numbers.
    rows = [
        ("position", vector(position)), ("look_at", vector(target)), ("up", vector(up)), ("fov_y_deg", fixed(F.degrees(fov_y), 2)),
        ("near", fixed(F.greatest(F.lit(0.1), distance * 0.01), 2)), ("far", fixed(distance * 10, 2))
    ]
    lines = [F.concat(F.lit(f"[{table}."), name, F.lit("]"))] + [F.concat(F.lit(f"{k} = "), v) for k, v in rows]
    return F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n"))
