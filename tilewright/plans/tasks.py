"""Whole tasks composed of sources, operators and writers: what a user of a command line would call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import citygml, load_bench, models, packing, rasters, tiles, vector_tiles
from tilewright.plans.cut import cut
from tilewright.sinks import containers
from tilewright.sources import archives, decode, gltf, rasters as raster_source, tilesets, vector_tiles as tile_source, xml_nodes

#: Folders that all test cases of an archive share.
SHARED = ["codelists/", "schemas/"]


def subset_citygml(spark: SparkSession, archive: DataFrame, tree: dict[str, list[str]]) -> DataFrame:
    """(place, path, content) of a city model archive cut down by ``tree``.

    Shared folders go to ``artifacts``. A file that ``tree`` names keeps the
    objects with the listed ids and goes to ``testcase`` with the images that
    its appearances still use; other files go there if their path starts with
    a prefix of ``tree`` and goes on with one of its items. All named models are
    cut down together, each by its own ids; the archive is unpacked once.
    """
    members = cut(archives.zip_members(archive).where("error IS NULL"), "members")
    lists = {k: v for k, v in tree.items() if isinstance(v, list) and all(isinstance(i, str) for i in v)}
    is_shared = F.col("path").startswith(SHARED[0]) | F.col("path").startswith(SHARED[1])
    shared, rest = members.where(is_shared), members.where(~is_shared)
    wanted = spark.createDataFrame([(p, i) for p, ids in lists.items() for i in ids], "path string, id string")
    named = rest.join(wanted.select("path").distinct(), "path", "left_semi")
    models_ = named.where(F.col("path").endswith(".gml"))
    kept = citygml.keep_appearances(citygml.keep_objects(cut(xml_nodes.read_nodes(models_), "nodes"), wanted))
    images = rest.join(citygml.referenced_images(kept).select(F.col("image").alias("path")).distinct(), "path", "left_semi")
    texts = containers.write_xml(kept, xml_nodes.read_namespaces(models_))
    heads = spark.createDataFrame([(p, i) for p, items in lists.items() for i in items], "prefix string, item string")
    others = citygml.included(rest.join(wanted.select("path").distinct(), "path", "left_anti"), heads)
    made = shared.select(F.lit("artifacts").alias("place"), "path", "content")
    for df in (texts, images, others):
        made = made.unionByName(df.select(F.lit("testcase").alias("place"), "path", "content"))
    return made.dropDuplicates(["place", "path"])


def mask_glbs(contents: DataFrame, types: list[str]) -> DataFrame:
    """(path, content) of GLBs whose features of the given types are masked; files without such features are left out."""
    excluded = cut(models.excluded_ids(gltf.glb_properties(contents), types), "excluded")
    touched = contents.join(excluded.select(F.col("path").alias("_p")).distinct(), F.col("path") == F.col("_p"), "left_semi")
    return containers.masked_glbs(gltf.read_glb(touched), models.mask_features(gltf.glb_feature_ids(touched), excluded))


def dump_glb_json(contents: DataFrame) -> DataFrame:
    """(path, content): each GLB's JSON as a file beside it."""
    return gltf.read_glb(contents, json_only=True).where("json IS NOT NULL").select(
        F.regexp_replace("path", r"\.glb$", ".json").alias("path"), F.encode("json", "utf-8").alias("content")
    )


def load_glb_json(contents: DataFrame) -> DataFrame:
    """(path, content): GLBs that have a JSON file beside them, with it as their JSON."""
    texts = contents.where("path LIKE '%.json'").select(F.regexp_replace("path", r"\.json$", ".glb").alias("_p"), F.decode("content", "utf-8").alias("_json"))
    glbs = gltf.read_glb(contents.where("path LIKE '%.glb'")).join(texts, F.col("path") == F.col("_p"))
    return containers.write_glb(glbs.withColumn("json", F.col("_json")))


def tileset_report(spark: SparkSession, base: str, levels: tuple[int, int] = (0, 64), measure: str = "features") -> dict[str, DataFrame]:
    """Cells (with hue), totals and warnings of the implicit tileset in a folder."""
    listed = decode.files(spark, base, "*.glb")
    counted = gltf.read_glb(listed, json_only=True).select(F.col("path").alias("_p"), tiles.feature_count().alias("features"))
    listing = cut(listed.select("path", F.col("length").alias("size")).join(counted, F.col("path") == F.col("_p"), "left").drop("_p"), "listing")
    root = decode.listing(spark, base, "tileset.json").first()["path"].rsplit("/", 1)[0]
    found, warnings = tiles.walk_tileset(tilesets.read_tileset(spark, f"{root}/tileset.json"), tilesets.read_subtrees(decode.files(spark, base, "*.subtree")), listing, root)
    found = cut(found, "tiles")
    cells = tiles.merge_cells(tiles.within_levels(found, *levels))
    return {"cells": tiles.cell_colours(cells, measure), "totals": tiles.cell_totals(cells, found), "warnings": warnings}


def mvt_report(contents: DataFrame) -> dict[str, DataFrame]:
    """Type counts and invalid features of vector tiles."""
    features = cut(tile_source.read_mvt(contents), "features")
    findings = vector_tiles.mvt_findings(features)
    return {
        "types": vector_tiles.type_counts(features), "findings": findings, "invalid": vector_tiles.invalid_counts(findings),
        "errors": features.where("error IS NOT NULL").select("path", "error")
    }


def raster_report(truth: DataFrame, flow: DataFrame, name: str, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(picture, summary) of two depth rasters of the same shape."""
    a, b = cut(raster_source.read_depth(truth), "truth"), cut(raster_source.read_depth(flow), "flow")
    if not rasters.same_shape(a, b):
        raise ValueError("the rasters differ in size")
    pixels = rasters.diff_pixels(a, b, scale)
    return containers.diff_pictures(pixels.withColumn("path", F.lit(name))), rasters.diff_summary(pixels)


def pack_outputs(rows: DataFrame, base: str) -> DataFrame:
    """(path, content) of the archives of an output folder: (dir, path, content) rows by first folder.

    Inner models in the old container are left out, tile metadata gives a
    TileJSON beside it, and the archive's name tells the format.
    """
    kinds = packing.directory_formats(rows.select("dir", "path"))
    metadata = rows.where(F.col("path").rlike(r"(^|/)metadata\.json$")).withColumn("value", F.decode("content", "utf-8"))
    made = packing.to_tilejson(metadata).where("tilejson IS NOT NULL").select(
        "dir", F.regexp_replace("path", r"metadata\.json$", "tilejson.json").alias("path"), F.encode("tilejson", "utf-8").alias("content")
    )
    packed = packing.packed_files(rows).unionByName(made).join(kinds, "dir")
    named = packed.where("format IS NOT NULL").select(packing.archive_name(F.lit(base), F.col("dir"), F.col("format")).alias("archive"), "path", "content")
    return containers.zip_archives(named)


def load_summary(frames: DataFrame, gpu: DataFrame, requests: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(runs, per-codec statistics) of load benchmark samples keyed by (codec, rep)."""
    runs = load_bench.frame_summary(load_bench.frame_durations(frames), gpu).join(load_bench.network_stats(requests), load_bench.RUN, "left")
    return runs, load_bench.codec_stats(runs.withColumn("error", F.lit(None).cast("string")), metrics)
