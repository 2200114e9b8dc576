"""Binary rows to files, through Hadoop's file systems from the executors' side of Spark."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.plans import map_arrow


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    for batch in batches:
        paths, sizes = [], []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            target = f"{base.rstrip('/')}/{path.lstrip('/')}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            data = content.as_py()
            with system.open_output_stream(target) as out:
                out.write(data)
            paths.append(path)
            sizes.append(len(data))
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) rows below ``root`` (a URI of a file system that all executors reach); returns what was written.

    A task that is run again writes the same bytes to the same places.
    """
    return map_arrow(rows.select("path", "content"), partial(_write, root=root), "path string, size long")


def _fetch(batches: Iterator[pa.RecordBatch], root: str, pause: float) -> Iterator[pa.RecordBatch]:
    from urllib.request import urlopen

    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    asked = False
    for batch in batches:
        for url, path in zip(batch.column("url").to_pylist(), batch.column("path").to_pylist(), strict=True):
            target = f"{base.rstrip('/')}/{path.lstrip('/')}"
            row = {"path": path, "state": "present", "size": None, "error": None}
            there = system.get_file_info(target)
            if there.type == fs.FileType.File:
                row["size"] = there.size
            else:
                time.sleep(pause if asked else 0)
                asked = True
                try:
                    with urlopen(url) as answer:  # noqa: S310
                        data = answer.read()
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(target) as out:
                        out.write(data)
                    row |= {"state": "fetched", "size": len(data)}
                except (OSError, ValueError) as wrong:
                    row |= {"state": "failed", "error": f"{type(wrong).__name__}: {wrong}"}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("state", pa.string()), ("size", pa.int64()), ("error", pa.string())]))


def fetch_artifacts(rows: DataFrame, root: str, pause: float = 1.0) -> DataFrame:
    """Fetches what (url, path) rows name to below ``root``: (path, state, size, error).

    A file that is there is left alone, a failure is a row and no end of the job,
    and a task waits between its requests.
    """
    return map_arrow(rows.select("url", "path"), partial(_fetch, root=root, pause=pause), "path string, state string, size long, error string")
