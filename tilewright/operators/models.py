"""GLB and B3DM models: masking features, summaries, pairing with JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What overwrites a masked id by component type: the greatest unsigned number, else -1.
MASKS = {5120: -1, 5121: 0xFF, 5122: -1, 5123: 0xFFFF, 5125: 0xFFFFFFFF}


def excluded_ids(properties: DataFrame, types: list[str], name: str = "feature_type") -> DataFrame:
    """(path, feature_id) of features whose type is excluded, pooled over a file's tables; types compare as text."""
    return properties.where((F.col("property") == name) & F.col("value").isin(types)).select("path", "feature_id").distinct()


def pooled_tables(properties: DataFrame) -> DataFrame:
    """Finding: files with more than one property table, whose ids are pooled."""
    return properties.groupBy("path").agg(F.countDistinct("table_idx").alias("tables")).where("tables > 1")


def mask_features(vertices: DataFrame, excluded: DataFrame) -> DataFrame:
    """Vertices with ``new_id``: the mask where their feature is excluded, else the id that they had."""
    mask = F.element_at(F.create_map(*(F.lit(x) for pair in MASKS.items() for x in pair)), F.col("component")).cast("long")
    marks = excluded.withColumn("_out", F.lit(True))
    return vertices.join(marks, ["path", "feature_id"], "left").withColumn("new_id", F.when(F.col("_out"), mask).otherwise(F.col("feature_id"))).drop("_out")


def batch_table(batches: DataFrame) -> DataFrame:
    """(path, property, values): a batch table's arrays with their length, other values with their JSON type."""
    rows = batches.where("batch_json IS NOT NULL").select("path", F.try_parse_json("batch_json").alias("v"))
    kind = "CASE WHEN schema_of_variant(e.value) LIKE 'ARRAY%' THEN CAST(size(CAST(e.value AS ARRAY<VARIANT>)) AS STRING) ELSE lower(schema_of_variant(e.value)) END"
    return rows.sparkSession.sql(f"SELECT b.path, e.key AS property, {kind} AS values FROM {{rows}} b, LATERAL variant_explode(b.v) AS e", rows=rows)


def payload_share(b3dm: DataFrame) -> DataFrame:
    """Bytes and percent of each B3DM that are its inner model."""
    return b3dm.where("byte_length IS NOT NULL").select("path", "byte_length", "gltf_length", F.round(F.col("gltf_length") / F.col("byte_length") * 100, 1).alias("percent"))


def _stem(path: str = "path") -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def json_with_glb(listing: DataFrame, paired: bool = True) -> DataFrame:
    """JSON files that have (or lack) a GLB of the same stem beside them."""
    jsons = listing.where("path LIKE '%.json'")
    glbs = listing.where("path LIKE '%.glb'").select(_stem().alias("_stem")).distinct()
    return jsons.join(glbs, _stem() == F.col("_stem"), "left_semi" if paired else "left_anti")


def to_pack(listing: DataFrame) -> DataFrame:
    """Files of a folder that go into its archive: all but the JSON files that a GLB stands for."""
    return listing.where("path NOT LIKE '%.json'").unionByName(json_with_glb(listing, paired=False))
