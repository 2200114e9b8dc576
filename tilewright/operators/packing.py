"""Expected-output packing: formats, names, TileJSON, what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def directory_formats(listing: DataFrame) -> DataFrame:
    """(dir, format) per first folder: ``3dtiles`` with a tileset or GLB, ``mvt`` with vector tiles, null else (a finding)."""
    any_ = lambda tail: F.bool_or(F.col("path").rlike(tail))
    kind = F.when(any_(r"(^|/)tileset\.json$") | any_(r"\.glb$"), "3dtiles").when(any_(r"\.mvt$"), "mvt")
    return listing.groupBy("dir").agg(kind.alias("format"))


def archive_name(base: Column, folder: Column, kind: Column) -> Column:
    """Archive name of a folder: the base up to ``_op``, the folder, and the format (before the last ``_lod``)."""
    stripped = F.replace(base, F.lit(".zip"), F.lit(""))
    at = F.instr(stripped, "_op_")
    short = F.when(at > 0, F.substring(stripped, F.lit(1), at + 2)).otherwise(stripped)
    head, tail = F.regexp_extract(folder, r"^(.*)_lod", 1), F.regexp_extract(folder, r"^.*_lod(.*)$", 1)
    return (
        F.when(F.contains(folder, F.lit("_dm_geometric_attributes")), F.concat(short, F.lit("_"), folder, F.lit(".zip")))
        .when(F.contains(folder, F.lit("_lod")), F.concat(short, F.lit("_"), head, F.lit("_"), kind, F.lit("_lod"), tail, F.lit(".zip")))
        .otherwise(F.concat(short, F.lit("_"), folder, F.lit("_"), kind, F.lit(".zip")))
    )


def to_tilejson(metadata: DataFrame, col: str = "value") -> DataFrame:
    """Rows with ``tilejson``, or ``finding`` where a needed field is missing or of the wrong length."""
    get = lambda k: F.get_json_object(col, f"$.{k}")
    numbers = lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double"))
    layers = F.from_json(F.get_json_object(get("json"), "$.vector_layers"), "array<struct<id:string>>")
    bounds, centre = numbers(get("bounds")), numbers(get("center"))
    centre = F.when(F.size(centre) == 2, F.concat(centre, F.array(get("maxzoom").try_cast("double")))).otherwise(centre)
    finding = (
        F.when(get("json").isNull(), "missing json").when(layers.isNull(), "missing vector_layers").when(F.exists(layers, lambda x: x["id"].isNull()), "layer without id")
        .when(F.coalesce(F.size(bounds) != 4, F.lit(True)), "bounds must have 4 values").when(F.coalesce(F.size(centre) != 3, F.lit(True)), "center must have 3 values")
        .when(F.exists(F.concat(bounds, centre), lambda x: x.isNull()), "not a number")
    )
    zoom = lambda k: get(k).try_cast("int").alias(k)
    body = F.struct(
        F.lit("3.0.0").alias("tilejson"), F.array(F.lit("/{z}/{x}/{y}.mvt")).alias("tiles"),
        F.transform(layers, lambda x: F.struct(x["id"].alias("id"), F.create_map().cast("map<string,string>").alias("fields"))).alias("vector_layers"),
        F.nullif(get("name"), F.lit("")).alias("name"), F.nullif(get("description"), F.lit("")).alias("description"), zoom("minzoom"), zoom("maxzoom"), bounds.alias("bounds"), centre.alias("center"),
    )
    return metadata.withColumn("finding", finding).withColumn("tilejson", F.when(F.col("finding").isNull(), F.to_json(body)))


def split_inputs(listing: DataFrame) -> DataFrame:
    """Top-level entries with ``step``: files but CSV are copied, folders packed, CSV files left out (null)."""
    return listing.withColumn("step", F.when(F.col("is_dir"), "pack").when(~F.col("path").endswith(".csv"), "copy"))


def packed_files(listing: DataFrame) -> DataFrame:
    """Files of a folder that go into its archive: no inner models in the old container."""
    return listing.where("path NOT LIKE '%.b3dm'")


def upgradable(listing: DataFrame) -> DataFrame:
    """Tilesets whose folder holds models in the old container, at any depth."""
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    sets = listing.where("path LIKE '%/tileset.json'").withColumn("_dir", folder)
    old = listing.where("path LIKE '%.b3dm'").select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"), F.lit("/")))
        ).alias("_up")
    ).distinct()
    return sets.join(old, F.col("_dir") == F.col("_up"), "left_semi").drop("_dir")


def relocated(listing: DataFrame) -> DataFrame:
    """Files of a job's output with their new place: artifacts apart from the rest. One job folder is expected; ``jobs`` tells how many there are."""
    job = F.regexp_extract("path", r"/jobs/([^/]+)/", 1)
    rest = F.regexp_extract("path", r"/jobs/[^/]+/(.*)$", 1)
    jobs = listing.select(job.alias("_job")).where("_job <> ''").agg(F.countDistinct("_job").alias("jobs"))
    moved = F.when(rest.startswith("artifacts/"), F.concat(F.lit("artifacts/"), F.substring(rest, 11, 1 << 20))).when(rest != "", F.concat(F.lit("runtime/"), rest))
    return listing.withColumn("moved_to", moved).crossJoin(F.broadcast(jobs))
