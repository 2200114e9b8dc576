"""Samples that a browser's load benchmark writes: JSON lines of frames, requests, GPU timings and long tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The samples' field names and types, and the names that operators read them by.
SAMPLES = {
    "frames": [("t", "double", "t"), ("pending", "int", "pending"), ("processing", "int", "processing"), ("ready", "int", "ready"), ("frameMs", "double", "frame_ms")],
    "requests": [
        ("name", "string", "name"), ("startTime", "double", "start_time"), ("fetchStart", "double", "fetch_start"), ("requestStart", "double", "request_start"), ("responseStart", "double", "response_start"),
        ("responseEnd", "double", "response_end"), ("transferSize", "double", "transfer_size"), ("encodedBodySize", "double", "encoded_size"),
    ],
    "gpu": [("t", "double", "t"), ("gpuMs", "double", "gpu_ms")],
    "tasks": [("start", "double", "start"), ("duration", "double", "duration")],
}


def parse_samples(lines: DataFrame, kind: str, col: str = "value") -> DataFrame:
    """Samples of a kind from JSON lines that also name their ``codec`` and ``rep``; a line that is no JSON has nulls and an ``error``."""
    fields = ", ".join(f"{name} {of}" for name, of, _ in SAMPLES[kind])
    row = F.from_json(col, f"codec string, rep int, {fields}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    return lines.where(F.trim(col) != "").select(row.alias("r")).select(
        "r.codec", "r.rep", *(F.col(f"r.{name}").alias(as_) for name, _, as_ in SAMPLES[kind]), F.col("r._broken").alias("error")
    )


def read_samples(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Samples of a kind from the files of a folder."""
    return parse_samples(spark.read.text(path), kind)
