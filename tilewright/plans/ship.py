"""Python code on executors.

Workers may not have the package on their path, so the driver sends its sources
once per application through Spark's own file distribution.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the workers' path, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root, packed = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="tilewright-code-")
    path = os.path.join(folder, "tilewright_sources.zip")
    Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
    _sent.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package present on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
