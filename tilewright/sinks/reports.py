"""Text outputs: TileJSON, stacks, SVG, JSON per feature, and small HTML reports."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geometry import SVG_HEIGHT, SVG_WIDTH, ring_extent, svg_path, svg_place
from tilewright.functions.text import html_escape
from tilewright.plans import map_arrow

LARGEST_REPORT = 10_000


def stack_lines(stacks: DataFrame) -> DataFrame:
    """``stack count`` lines for a renderer."""
    return stacks.select(F.concat_ws(" ", "stack", F.col("count").cast("string")).alias("value"))


def feature_files(simplified: DataFrame, out: str) -> None:
    """One folder per port with its features' simplified JSON, keyed by line."""
    simplified.select("port", "line_no", "simplified").write.mode("overwrite").partitionBy("port").json(out)


#: How shapes are drawn, by role; callers may give their own.
STYLES = {"area": "fill:#dbe9f6;stroke:#1f4e79", "hole": "fill:#ffffff;stroke:#9c3d10", "line": "fill:none;stroke:#1f4e79", "point": "fill:#1f4e79"}


def _line(points: Column, extent: Column, closed: bool) -> Column:
    path = svg_path(points, extent)
    return path if closed else F.regexp_replace(path, " Z$", "")


def geometry_svg(gtype: Column, coordinates: Column, styles: dict[str, str] = STYLES) -> Column:
    """SVG shapes of a geometry (coordinates as JSON): areas with their holes, lines, or points; ``''`` for other types.

    Points of all parts share one extent, so that a geometry of many parts is one picture.
    """
    path = lambda d, role: F.concat(F.lit('<path style="'), F.lit(styles[role]), F.lit('" d="'), d, F.lit('"/>'))
    nested = lambda depth: F.from_json(coordinates, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    area = lambda rings, box: F.array_join(
        F.transform(rings, lambda r, i: F.when(i == 0, path(_line(r, box, True), "area")).otherwise(path(_line(r, box, True), "hole"))), ""
    )
    dot = lambda p, box: F.concat(
        F.lit('<circle r="3" style="'), F.lit(styles["point"]), F.lit('" cx="'), svg_place(p, box)["x"].cast("string"), F.lit('" cy="'),
        svg_place(p, box)["y"].cast("string"), F.lit('"/>')
    )
    each = lambda parts, draw: F.array_join(F.transform(parts, draw), "")
    polygon, polygons, line, lines, points = nested(2), nested(3), nested(1), nested(2), nested(1)
    drawn = {
        "Polygon": area(polygon, ring_extent(F.flatten(polygon))), "MultiPolygon": each(polygons, lambda p: area(p, ring_extent(F.flatten(F.flatten(polygons))))),
        "LineString": path(_line(line, ring_extent(line), False), "line"), "MultiLineString": each(lines, lambda r: path(_line(r, ring_extent(F.flatten(lines)), False), "line")),
        "Point": dot(nested(0), ring_extent(F.array(nested(0)))), "MultiPoint": each(points, lambda p: dot(p, ring_extent(points))),
    }
    out = F.lit("")
    for kind, shapes in drawn.items():
        out = F.when(gtype == kind, F.coalesce(shapes, F.lit(""))).otherwise(out)
    return out


def svg_document(title: Column, extent: Column, shapes: Column, ground: str = "#ffffff") -> Column:
    """A picture of SVG_WIDTH by SVG_HEIGHT that names its title and bounds."""
    bounds = F.concat_ws(" ", *(F.format_string("%.2f", extent[i]) for i in range(4)))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {SVG_WIDTH} {SVG_HEIGHT}" style="background:{ground}"><title>'
    return F.concat(F.lit(head), html_escape(title), F.lit("</title><desc>"), bounds, F.lit("</desc>"), shapes, F.lit("</svg>"))


def bench_json(stats: DataFrame) -> DataFrame:
    """One JSON object of metrics per codec."""
    entry = F.struct("metric", F.struct("n", "mean", "std", "min", "max"))
    return stats.groupBy("codec").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics")).select(F.to_json(F.struct("codec", "metrics")).alias("value"))


def image_payloads(images: DataFrame) -> DataFrame:
    """Images with their size and base64 payload for a page."""
    return images.select("path", "name", "mime", F.octet_length("data").alias("bytes"), F.base64("data").alias("b64"))


def html_report(title: str, tables: dict[str, DataFrame], data: dict[str, object] | None = None) -> str:
    """A page with one table per small result; a result over LARGEST_REPORT rows is refused, not cut: ``html_pages`` writes those."""
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(LARGEST_REPORT + 1).collect()
        if len(rows) > LARGEST_REPORT:
            raise ValueError(f"{name} has over {LARGEST_REPORT} rows; aggregate it or page through it")
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    if data is not None:
        parts.append("<script type='application/json' id='data'>" + json.dumps(data).replace("</", "<\\/") + "</script>")
    return "".join(parts) + "</body></html>"


def _pages(batches: Iterator[pa.RecordBatch], title: str, rows: int) -> Iterator[pa.RecordBatch]:
    context, nth, held = TaskContext.get(), 0, []
    part = context.partitionId() if context else 0
    columns: list[str] = []

    def out() -> pa.RecordBatch:
        nonlocal nth, held
        head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in held)
        page = f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"
        made = pa.RecordBatch.from_pydict({"path": [f"{part:06d}-{nth:06d}.html"], "content": [page.encode()], "rows": [len(held)]})
        nth, held = nth + 1, []
        return made

    for batch in batches:
        columns = batch.schema.names
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row)
            if len(held) == rows:
                yield out()
    if held:
        yield out()


def html_pages(title: str, df: DataFrame, order: list[str], rows: int = LARGEST_REPORT) -> DataFrame:
    """(path, content, rows): pages of a result of any size, whose names sort as its rows do."""
    return map_arrow(df.orderBy(*order), partial(_pages, title=title, rows=rows), "path string, content binary, rows long")


def fill_template(template: str, values: dict[str, object]) -> str:
    """A template with its ``{{NAME}}`` placeholders filled by JSON; one without a value is an error."""
    for name, value in values.items():
        mark = "{{" + name + "}}"
        if mark not in template:
            raise KeyError(name)
        template = template.replace(mark, json.dumps(value).replace("</", "<\\/"))
    return template
