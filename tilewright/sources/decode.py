"""Files to rows: listing, and a decoder per file run over Arrow batches."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.plans import map_arrow

ROWS = 4096
#: What a broken file can raise; ValueError covers text that is no UTF-8 or no JSON.
FAULTS = (ValueError, KeyError, IndexError, TypeError, AttributeError, OverflowError, EOFError, NotImplementedError, RuntimeError, struct.error, zlib.error, zipfile.BadZipFile)


def files(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """path, length and content of the files below ``root`` whose names match; only Spark's reader opens them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root).select("path", "length", "content")


def listing(spark: SparkSession, root: str, suffix: str = "*") -> DataFrame:
    """path and length; contents are not read."""
    return files(spark, root, suffix).select("path", "length")


def entry(spark: SparkSession, root: str, path_col: str = "path"):  # noqa: ANN201
    """Name of what holds a path directly in ``root``: the file itself, or the folder that it is a part of."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(root)
    whole = folder.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/")
    return F.substring_index(F.substr(path_col, F.lit(len(whole) + 2)), "/", 1)


def stem(path_col: str = "path"):  # noqa: ANN201
    """File name without folder and last suffix."""
    return F.regexp_extract(path_col, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _rows(batches: Iterator[pa.RecordBatch], decoder: Callable[[str, bytes], Iterable[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            for row in decoder(path.as_py(), content.as_py() or b""):
                held.append(row)
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class Guarded:
    """A decoder whose faults become one row with the path and an ``error``, in place of the file's rows; it never ends a job."""

    def __init__(self, decoder: Callable[[str, bytes], Iterable[dict]], name: str = "path"):
        self.decoder, self.name = decoder, name

    def __call__(self, path: str, data: bytes) -> list[dict]:
        try:
            return list(self.decoder(path, data))
        except FAULTS as wrong:
            return [{self.name: path, "error": f"{type(wrong).__name__}: {wrong}"}]


def decoded(contents: DataFrame, decoder: Callable[[str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``decoder(path, content)`` yields for each (path, content) row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return map_arrow(contents.select("path", "content"), partial(_rows, decoder=decoder, schema=to_arrow_schema(T._parse_datatype_string(schema))), schema)
