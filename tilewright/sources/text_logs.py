"""Line-based sources: feature stores, repository logs, stacks, dependency blocks, commands.

Order matters in most of these, so a line's number comes from the reader.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions.text import branch_name, frame_name


def numbered_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, line_no (from 0, blank lines count) and value of the text files below a folder, or of one file.

    Files are read in splits, each of which one task reads in order; lines are
    numbered within a split, and on from the lines of the splits before it.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    blocks = read.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block")).agg(F.count("*").alias("_lines"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("path", "_block", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("path", "_block").orderBy("_at")) - 1
    return rows.withColumn("_own", own).join(starts, ["path", "_block"]).select("path", (F.col("_before") + F.col("_own")).alias("line_no"), "value")


def feature_lines(lines: DataFrame) -> DataFrame:
    """port, line_no and feature (JSON text) of the lines that aren't blank; port is the file's name without its last suffix."""
    port = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.select(port.alias("port"), "line_no", F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("feature")).where("feature <> ''")


def write_features(features: DataFrame, out: str, lines: int = 10_000) -> None:
    """Writes (port, line_no, feature) so that one feature can be found again without reading the others: by port and stretch of lines."""
    rows = features.withColumn("stretch", F.floor(F.col("line_no") / lines)).repartition("port", "stretch")
    rows.write.mode("overwrite").partitionBy("port", "stretch").parquet(out)


def feature_at(spark: SparkSession, out: str, port: str, line_no: int, lines: int = 10_000) -> DataFrame:
    """The feature of a port's line, numbers with the digits that they were written with; other files are not opened."""
    rows = spark.read.schema("line_no long, feature string, port string, stretch long").parquet(out)
    return rows.where((F.col("port") == port) & (F.col("stretch") == line_no // lines) & (F.col("line_no") == line_no)).select("port", "line_no", "feature")


def tree_rows(lines: DataFrame) -> DataFrame:
    """mode, type, sha, size (null for ``-``) and file of a tree listing's lines."""
    part = lambda n: F.regexp_extract("value", r"^(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$", n)
    return lines.where("trim(value) <> ''").select(
        part(1).alias("mode"), part(2).alias("type"), part(3).alias("sha"),
        F.expr(r"try_cast(regexp_extract(value, '^\\S+\\s+\\S+\\s+\\S+\\s+(\\S+)', 1) AS BIGINT)").alias("size"), part(5).alias("file")
    )


def log_rows(lines: DataFrame) -> DataFrame:
    """line_no, date, branch and file: a header line (an ISO date, a blank, a ref) holds for the file lines that follow.

    A header is told by its date, so that a file name of two words with a hyphen is still a file.
    """
    head = r"^(\d{4}-\d{2}-\d{2}\S*)\s+(\S+)$"
    kept = lines.where("value <> ''")
    header = F.when(F.col("value").rlike(head), F.struct(F.regexp_extract("value", head, 1).alias("date"), branch_name(F.regexp_extract("value", head, 2)).alias("branch")))
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.withColumn("_head", header).withColumn("_now", F.last("_head", ignorenulls=True).over(before))
    return rows.where("_head IS NULL AND _now IS NOT NULL").select(
        "path", "line_no", F.col("_now.date").alias("date"), F.col("_now.branch").alias("branch"), F.col("value").alias("file")
    )


def stack_rows(lines: DataFrame) -> DataFrame:
    """stack (frames from the outermost, joined by ``;``) and count of each block of frames that a count line ends."""
    kept = lines.withColumn("value", F.trim("value")).where("value <> '' AND NOT startswith(value, 'dtrace')")
    number = F.col("value").rlike(r"^\d+$")
    after = Window.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.where(number | F.col("value").contains("`")).withColumn("_number", number).withColumn("block", F.sum(number.cast("int")).over(after))
    blocks = rows.where("block > 0").groupBy("path", "block").agg(
        F.max(F.when(F.col("_number"), F.col("value").cast("long"))).alias("count"),
        F.array_sort(F.collect_list(F.when(~F.col("_number"), F.struct((-F.col("line_no")).alias("at"), frame_name(F.col("value")).alias("frame"))))).alias("frames"),
    )
    return blocks.where(F.size("frames") > 0).select("path", F.array_join(F.transform("frames", lambda f: f["frame"]), ";").alias("stack"), "count")


def dependency_blocks(texts: DataFrame) -> DataFrame:
    """path, start, name and body of each ``name = { ... }`` at a line's start, on one line or over several."""
    pattern = r"(?m)^[a-zA-Z0-9_-]+[ \t]*=[ \t]*\{[^}]*\}"
    found = F.regexp_extract_all("value", F.lit(pattern), F.lit(0))
    rows = texts.select("path", F.posexplode(found).alias("nth", "block"))
    return rows.select("path", "nth", F.regexp_extract("block", r"^([a-zA-Z0-9_-]+)", 1).alias("name"), F.regexp_extract("block", r"(?s)\{(.*)\}$", 1).alias("body"), "block")


def command_parts(df: DataFrame, col: str = "command") -> DataFrame:
    """variables (``--var=k=v`` as a map), workflow URL and the API base two segments above it."""
    pairs = F.transform(F.regexp_extract_all(col, F.lit(r"--var=([^\s=]+=[^\s]*)"), F.lit(1)), lambda v: F.struct(F.substring_index(v, "=", 1), F.regexp_replace(v, "^[^=]*=", "")))
    url = F.regexp_extract(col, r"(https?://\S+)", 1)
    return df.select("*", F.map_from_entries(pairs).alias("variables"), url.alias("workflow_url"), F.regexp_replace(url, r"/[^/]*/[^/]*$", "").alias("api_base"))


def toml_config(spark: SparkSession, path: str) -> dict:
    """A small TOML configuration, read through Spark and parsed on the driver."""
    return tomllib.loads(spark.read.text(path, wholetext=True).first()[0])
