"""Depth rasters: PNG pixels of four bytes, each a little-endian float."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tilewright.sources.decode import FAULTS, Guarded, decoded

PIXEL_SCHEMA = "path string, height int, width int, y int, x int, depth float, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def read_png(data: bytes) -> np.ndarray:
    """height x width x channels bytes of an 8-bit RGB or RGBA PNG without interlace."""
    body, header = b"", None
    for kind, chunk in png_chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
    if header is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in (2, 6) or interlace:
        raise ValueError(f"unsupported PNG: depth {depth}, colour {colour}, interlace {interlace}")
    step = 3 if colour == 2 else 4
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            now = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            now = line + above
        else:
            now = line.copy()
            for i in range(width * step):
                left, up, corner = (int(now[i - step]), int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                now[i] = (int(line[i]) + guess) & 0xFF
        out[y] = above = now
    return out.reshape(height, width, step)


def write_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB or RGBA PNG."""
    height, width, step = pixels.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * step).astype(np.uint8)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if step == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _pixels(path: str, data: bytes) -> Iterator[dict]:
    try:
        rgba = read_png(data)
        if rgba.shape[2] != 4:
            raise ValueError("a depth raster has four bytes a pixel")
    except FAULTS as wrong:
        yield {"path": path, "error": f"{type(wrong).__name__}: {wrong}"}
        return
    height, width, _ = rgba.shape
    depth = np.ascontiguousarray(rgba).view("<f4").reshape(height, width)
    for y in range(height):
        for x in range(width):
            yield {"path": path, "height": height, "width": width, "y": y, "x": x, "depth": float(depth[y, x]), "error": None}


def read_depth(contents: DataFrame) -> DataFrame:
    """One row per pixel; a depth that is not finite means no hit. A file that cannot be read is one row with an error."""
    return decoded(contents, _pixels, PIXEL_SCHEMA)


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from an image's header: PNG, JPEG, WebP or KTX2; None if it is none of these."""
    if data[:8] == _SIGNATURE and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:12] == b"\xabKTX 20\xbb\r\n\x1a\n" and len(data) >= 28:
        return struct.unpack_from("<II", data, 20)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        width, height = struct.unpack_from("<HH", data, 26)
        return width & 0x3FFF, height & 0x3FFF
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        marker, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height
        at += 2 + length
    return None


def _payload(path: str, data: bytes) -> Iterator[dict]:
    size = image_size(data)
    yield {"path": path, "bytes": len(data), "width": size[0] if size else None, "height": size[1] if size else None, "error": None if size else "unknown image"}


def image_headers(contents: DataFrame) -> DataFrame:
    """path, bytes, width, height of each image payload, or an error."""
    return decoded(contents, Guarded(_payload), "path string, bytes long, width int, height int, error string")
