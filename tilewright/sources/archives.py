"""ZIP archives: listings, whole members, and single members by byte range."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.plans import map_arrow
from tilewright.sources.decode import FAULTS, Guarded, decoded

MEMBER_SCHEMA = "path string, member string, nth int, size long, compressed long, method int, crc long, offset long, error string"
CONTENT_SCHEMA = "archive string, path string, content binary, error string"
_END, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"


def _list(path: str, data: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for nth, info in enumerate(i for i in z.infolist() if not i.is_dir()):
            yield {
                "path": path, "member": info.filename, "nth": nth, "size": info.file_size, "compressed": info.compress_size,
                "method": info.compress_type, "crc": info.CRC, "offset": info.header_offset
            }


def _read(path: str, data: bytes, prefixes: list[str] | None) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir() and (prefixes is None or info.filename.startswith(tuple(prefixes))):
                yield {"archive": path, "path": info.filename, "content": z.read(info)}


def zip_listing(contents: DataFrame) -> DataFrame:
    """One row per member that is no folder; nothing is unpacked. An archive that cannot be read is one row with an error."""
    return decoded(contents, Guarded(_list), MEMBER_SCHEMA)


def zip_members(contents: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """Unpacked members; with ``prefixes``, those whose name starts with any of them, chosen before unpacking.

    An archive with a fault is one row with an error: none of its members is trusted then.
    """
    return decoded(contents, Guarded(partial(_read, prefixes=prefixes), "archive"), CONTENT_SCHEMA)


def central_directory(read: Callable[[int, int], bytes], size: int, tail: int = 65_536) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(name, offset, compressed, size, method, crc) of each entry, from byte ranges of a file of ``size`` bytes.

    Follows the published layout: the end record lies in the last ``tail``
    bytes; sizes and offsets of 0xFFFFFFFF stand in the 64-bit extra field.
    """
    start = max(0, size - tail - 22)
    end = read(start, size - start)
    at = end.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory")
    length, offset = struct.unpack_from("<II", end, at + 12)
    if offset == 0xFFFFFFFF:
        locator = end.rfind(b"PK\x06\x07", 0, at)
        (where,) = struct.unpack_from("<Q", end, locator + 8)
        length, offset = struct.unpack_from("<QQ", read(where, 56), 40)
    directory, at = read(offset, length), 0
    while directory[at : at + 4] == _CENTRAL:
        method, _, _, crc, packed, whole, name_length, extra_length, comment_length = struct.unpack_from("<HHHIIIHHH", directory, at + 10)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + name_length].decode("utf-8", "replace")
        extra, e = directory[at + 46 + name_length : at + 46 + name_length + extra_length], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            e += 4 + n
        yield name, local, packed, whole, method, crc
        at += 46 + name_length + extra_length + comment_length


def range_member(read: Callable[[int, int], bytes], entry: tuple[str, int, int, int, int, int]) -> bytes:
    """One member by its directory entry: two ranges are read, stored or deflated."""
    name, offset, packed, _, method, crc = entry
    header = read(offset, 30)
    if header[:4] != _LOCAL:
        raise ValueError(f"{name}: no local header")
    name_length, extra_length = struct.unpack_from("<HH", header, 26)
    body = read(offset + 30 + name_length + extra_length, packed)
    if method not in (0, 8):
        raise ValueError(f"{name}: method {method}")
    out = zlib.decompress(body, -15) if method == 8 else body
    if zlib.crc32(out) != crc:
        raise ValueError(f"{name}: checksum")
    return out


def _remote(batches: Iterator[pa.RecordBatch], opener: Callable[[str], tuple[Callable[[int, int], bytes], int]], wanted: str | None) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
    for batch in batches:
        for url in batch.column("archive").to_pylist():
            try:
                read, size = opener(url)
                entries = [e for e in central_directory(read, size) if not e[0].endswith("/")]
            except (OSError, *FAULTS) as wrong:
                yield pa.RecordBatch.from_pylist([{"archive": url, "error": f"{type(wrong).__name__}: {wrong}"}], schema=schema)
                continue
            for e in entries:  # a member at a time, so that a task holds one
                row = {"archive": url, "path": e[0], "size": e[3]}
                if wanted is not None and re.search(wanted, e[0]):
                    try:
                        row["content"] = range_member(read, e)
                    except (OSError, *FAULTS) as wrong:
                        row["error"] = f"{type(wrong).__name__}: {wrong}"
                yield pa.RecordBatch.from_pylist([row], schema=schema)


def http_ranges(url: str) -> tuple[Callable[[int, int], bytes], int]:
    """Byte ranges of a file on a web server, and its size."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, method="HEAD")) as answer:  # noqa: S310
        size = int(answer.headers["Content-Length"])

    def read(start: int, length: int) -> bytes:
        with urlopen(Request(url, headers={"Range": f"bytes={start}-{start + length - 1}"})) as answer:  # noqa: S310
            return answer.read()

    return read, size


def file_ranges(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    """Byte ranges of a file in any file system that Arrow reaches, and its size."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    file = system.open_input_file(path)

    def read(start: int, length: int) -> bytes:
        file.seek(start)
        return file.read(length)

    return read, file.size()


def remote_members(archives: DataFrame, wanted: str | None = None, opener: Callable[[str], tuple[Callable[[int, int], bytes], int]] = http_ranges) -> DataFrame:
    """Members of the archives that ``archive`` names, without fetching them whole: (archive, path, size, content, error).

    Only the end of each archive and its directory are read, and of members whose
    name matches ``wanted`` their own bytes; others have no content. ``opener``
    gives a function of (start, length) and the size of a named archive.
    """
    return map_arrow(archives.select("archive"), partial(_remote, opener=opener, wanted=wanted), "archive string, path string, size long, content binary, error string")
