"""Byte-level BPE over Arrow batches with the tokenizers library.

The rank file becomes a BPE model over the byte-to-character alphabet: every
way to split a token into two tokens is a merge, in rank order, and a piece that
is itself a token is taken whole, which is what merging by rank does. Texts are
cut by the pattern; each distinct piece of a task goes through the library once
and its ids are kept in a table of bounded size.

Decoding reverses the byte table. Offsets map the bytes of ids to characters: a
character whose bytes are split over tokens gives each of them the span of that
one character, and decoding joins bytes before it reads characters, so such
characters come back whole. ``round_trip`` does all three in one pass over Arrow.

Defined results: a null text counts as empty and has no ids; null ids of
documents and repeated rows are kept; an empty table gives an empty result;
other columns are not read. Texts are encoded whole, whatever their length; the
ids, bytes and offsets of one text have to fit in a task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tilewright.plans import map_arrow

KEPT_PIECES, OUT_BYTES = 120_000, 4_000_000


@lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        self.path = path
        self.bytes_of = {r: t for t, r in read_ranks(path).items()}
        # White space by its Unicode property: the plain escape also takes the separators 0x1C to 0x1F.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[str, bytes] = {}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for r, t in self.bytes_of.items():
            self.lengths[r] = len(t)

    @cached_property
    def model(self):  # noqa: ANN201
        """The library's tokenizer; a task that only decodes never builds it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(self.path), byte_alphabet()
        said = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [(said[t[:i]], said[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        model = Tokenizer(models.BPE(vocab={said[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return model

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces that the table lacks."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            for p, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces = self.pieces(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self.learn({*pieces})
            # A text with more distinct pieces than the table holds is still whole: learn() clears only before it adds.
            if any(p not in self.known for p in pieces):
                self.learn({*pieces})
            return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, decoded: bytes) -> np.ndarray:
        """First character and one past the last of each id, a row per id; ids that share a split character share its span."""
        size = self.lengths[np.frombuffer(ids, "<u4")]
        ends = np.cumsum(size)
        spans = np.stack([ends - size, ends], axis=1)
        if decoded.isascii():
            return spans.astype("<i4")
        # The number of characters that begin up to each byte.
        begun = np.cumsum((np.frombuffer(decoded, np.uint8) & 0xC0) != 0x80)
        return np.stack([begun[spans[:, 0]] - 1, begun[spans[:, 1] - 1]], axis=1).astype("<i4")


@lru_cache(2)
def _coder(path: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path, pattern)


def _batches(columns: Iterator[tuple], fields: list[tuple[str, pa.DataType]], weigh: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about OUT_BYTES from rows; ``weigh`` is the column whose size counts."""
    schema, held, size = pa.schema(fields), [], 0
    for row in columns:
        held.append(row)
        size += len(row[weigh]) + 64
        if size > OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _encode(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, pattern)
    rows = ((doc.as_py(), coder.encode(text.as_py() or "")) for batch in batches for doc, text in zip(batch.column(0), batch.column(1), strict=True))
    return _batches(rows, [("id", id_type), ("ids", pa.binary())], 1)


def _decode(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, pattern)
    rows = ((doc.as_py(), ids.as_py(), coder.decode(ids.as_py() or b"")) for batch in batches for doc, ids in zip(batch.column(0), batch.column(1), strict=True))
    return _batches(rows, [("id", id_type), ("ids", pa.binary()), ("decoded", pa.binary())], 2)


def _round_trip(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = _coder(path, pattern)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                yield doc.as_py(), ids, decoded, coder.offsets(ids, decoded).tobytes()

    return _batches(rows(), [("id", id_type), ("ids", pa.binary()), ("decoded", pa.binary()), ("offsets", pa.binary())], 3)


def _mapped(df: DataFrame, cols: list[str], function: Callable, schema: str, path: str, pattern: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[cols[0]].dataType
    made = map_arrow(df.select(*cols), partial(function, id_type=to_arrow_type(kind), path=path, pattern=pattern), f"id {kind.simpleString()}, {schema}")
    return made.withColumnRenamed("id", cols[0])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (little-endian unsigned 32-bit integers)."""
    return _mapped(docs, [id_col, text_col], _encode, "ids binary", path, pattern)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and ``decoded`` bytes."""
    return _mapped(encoded, [id_col, ids_col], _decode, "ids binary, decoded binary", path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``ids``, the ``decoded`` bytes of these ids, and ``offsets`` (first character and one past the last of each id, little-endian 32-bit)."""
    return _mapped(docs, [id_col, text_col], _round_trip, "ids binary, decoded binary, offsets binary", path, pattern)
