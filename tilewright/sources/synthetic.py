"""Made-up city models: walls that lie on one another, each with a picture of its own, for trying out texture atlases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.text import hsv_rgb
from tilewright.plans import ship
from tilewright.sources.rasters import write_png

WALLS, SIDE, SEED = 64, 64, 42
SATURATION, BRIGHTNESS = 0.75, 0.9
#: The corners of the one place where all walls stand (latitude, longitude, height).
LOW, HIGH = (35.0, 135.0, 0.0), (35.001, 135.001, 1.0)


def wall_pictures(spark: SparkSession, walls: int = WALLS, side: int = SIDE, seed: int = SEED) -> DataFrame:
    """(nth, name, side, red, green, blue): a picture per wall in a hue of its own, the same for each seed."""
    hue = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 32)) / float(1 << 32)
    rgb = hsv_rgb(hue, F.lit(SATURATION), F.lit(BRIGHTNESS))
    name = F.format_string("wall_%05d.png", "id")
    return spark.range(walls).select(F.col("id").alias("nth"), name.alias("name"), F.lit(side).alias("side"), *(rgb[i].alias(c) for i, c in enumerate(("red", "green", "blue"))))


def generated_extent(corners: DataFrame) -> DataFrame:
    """One row: the least and greatest x, y and z of generated corners (x, y, z)."""
    return corners.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y", "z")))


def wall_corners(pictures: DataFrame) -> DataFrame:
    """(nth, at, x, y, z): the closed ring of each wall, upright along its first axis."""
    place = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    ring = F.array(*(F.struct(F.lit((LOW, HIGH)[i][0]).alias("x"), F.lit(LOW[1]).alias("y"), F.lit((LOW, HIGH)[k][2]).alias("z")) for i, k in place))
    return pictures.select("nth", F.posexplode(ring).alias("at", "p")).select("nth", "at", "p.*")


def wall_bounds(pictures: DataFrame) -> DataFrame:
    """(nth, x, y, z): the two corners between which each wall has its room."""
    ends = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("x", "y", "z"), p, strict=True))) for p in (LOW, HIGH)))
    return pictures.select("nth", F.inline(ends))


def _picture(frame: pd.Series, side: pd.Series, green: pd.Series, blue: pd.Series) -> pd.Series:
    return pd.Series([write_png(np.full((s, s, 3), [r, g, b], np.uint8)) for r, s, g, b in zip(frame, side, green, blue, strict=True)])


def wall_case(spark: SparkSession, walls: int = WALLS, side: int = SIDE, seed: int = SEED) -> DataFrame:
    """(path, content): the document ``walls.gml`` and its pictures below ``appearance/``; PNG, as nothing here writes JPEG."""
    ship(spark)
    pictures = wall_pictures(spark, walls, side, seed)
    corners = wall_corners(pictures)
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    point = F.format_string("%.3f %.3f %.1f", "x", "y", "z")
    n = F.col("nth")

    def joined(by: str, value: Column, gap: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), value.alias("v")))), lambda x: x["v"]), gap)

    rings = corners.groupBy("nth").agg(joined("at", point, " ").alias("points"))
    wall = said(
        '<bldg:boundedBy><bldg:WallSurface gml:id="wall', n, '"><bldg:lod2MultiSurface><gml:Polygon gml:id="face', n, '"><gml:exterior><gml:LinearRing gml:id="ring', n, '"><gml:posList>',
        F.col("points"), "</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></bldg:lod2MultiSurface></bldg:WallSurface></bldg:boundedBy>",
    )
    surface = said(
        "<app:surfaceDataMember><app:ParameterizedTexture><app:imageURI>appearance/", F.col("name"), '</app:imageURI><app:target uri="#face', n, '"><app:TexCoordList><app:textureCoordinates ring="#ring', n,
        '">0 0 1 0 1 1 0 1 0 0</app:textureCoordinates></app:TexCoordList></app:target></app:ParameterizedTexture></app:surfaceDataMember>',
    )
    parts = rings.join(pictures, "nth").agg(joined("nth", wall, "").alias("walls"), joined("nth", surface, "").alias("surfaces"))
    corner = lambda which: F.format_string("%.3f %.3f %.1f", *(F.col(f"{which}_{c}") for c in ("x", "y", "z")))
    whole = said(
        '<?xml version="1.0" encoding="UTF-8"?><core:CityModel xmlns:core="http://www.opengis.net/citygml/2.0" xmlns:bldg="http://www.opengis.net/citygml/building/2.0" xmlns:app="http://www.opengis.net/citygml/appearance/2.0" ',
        'xmlns:gml="http://www.opengis.net/gml"><gml:boundedBy><gml:Envelope srsDimension="3"><gml:lowerCorner>', corner("min"), "</gml:lowerCorner><gml:upperCorner>", corner("max"),
        '</gml:upperCorner></gml:Envelope></gml:boundedBy><core:cityObjectMember><bldg:Building gml:id="walls">', F.col("walls"), "</bldg:Building></core:cityObjectMember><app:appearanceMember><app:Appearance>",
        F.col("surfaces"), "</app:Appearance></app:appearanceMember></core:CityModel>",
    )
    document = parts.crossJoin(generated_extent(wall_bounds(pictures))).select(F.lit("walls.gml").alias("path"), F.encode(whole, "utf-8").alias("content"))
    picture = F.pandas_udf(_picture, "binary")
    return document.unionByName(pictures.select(F.concat(F.lit("appearance/"), "name").alias("path"), picture("red", "side", "green", "blue").alias("content")))
