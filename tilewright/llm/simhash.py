"""SimHash near-dedup through a segment-popcount embedding.

The 64 bits of a fingerprint are cut into 32 segments of two bits, and a
fingerprint is embedded as its segments' bit counts. The Manhattan distance of
two embeddings never exceeds their Hamming distance. Counts are kept in
thermometer code (0, 01, 11), so that the Manhattan distance is the number of
differing bits of two codes.

Fingerprints within 3 bits are within 3 in Manhattan distance, hence within 1
in one half of 16 segments. Each half is a grid whose cells are its exact
counts; a fingerprint stands in its own cell and, as a guest, in the cells one
step up. Two that are within 1 meet with one of them at home. The join on
(half, cell) checks the whole Manhattan bound, then the exact Hamming distance.

Fingerprints are distinct before the join, so copies do not multiply, and the
rows of a task that share a fingerprint travel as one unit with its members.
A dense cluster of different fingerprints does not multiply either: first each
fingerprint is linked with a few hubs of its cells,
and the join then looks only for links between different components of these.

Defined results: a null text counts as empty, and texts without words have
fingerprint zero and link like others; texts of any length are read whole, a
text's words in one task; null ids are never a component's least
id while another is there; repeated rows are repeated in the result; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tilewright.llm.components import components
from tilewright.plans import cut, map_arrow

SHINGLE, SEED, RADIUS = 3, 42, 3
FOLD_ROWS, CHUNK = 50_000, 65_536
LOW_BITS = 0x5555555555555555
#: Bits that the orders of hubs turn over.
TURNS = (0, 0x7FFFFFFFFFFFFFFF, 0x5555555555555555, 0x2AAAAAAAAAAAAAAA, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, joined, repeat(seed)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _units(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(fp, members) for each distinct fingerprint of what has been read; fp as a signed number."""
    folded: dict[int, list] = {}
    rows = 0

    def out() -> pa.RecordBatch:
        fps = np.array([*folded], np.uint64).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.array([*folded.values()], pa.list_(id_type))], names=["fp", "members"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            folded.setdefault(fingerprint(text.as_py(), shingle, seed), []).append(doc)
            rows += 1
        if rows > FOLD_ROWS:
            yield out()
            folded, rows = {}, 0
    if folded:
        yield out()


def thermometer(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each as 00, 01 or 11."""
    other = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(other).bitwiseAND(F.lit(LOW_BITS))
    both = fp.bitwiseAND(other).bitwiseAND(F.lit(LOW_BITS))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cells(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(home, there): each fingerprint in the cells of its own counts, and there as well as a guest one step up."""
    code = fps.select("fp", "root", thermometer(F.col("fp")).alias("code"))
    halves = F.array(*(F.struct(F.lit(h).alias("half"), F.shiftrightunsigned("code", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")) for h in (0, 1)))
    home = code.select("fp", "root", "code", F.inline(halves))
    # One step up in segment i sets its low bit, or its high bit where the low one is set.
    step = lambda i: F.expr(f"cell | (CASE WHEN (cell & {1 << 2 * i}L) = 0 THEN {1 << 2 * i}L ELSE {2 << 2 * i}L END)")
    ups = F.filter(F.array(*(step(i) for i in range(16))), lambda c: c != F.col("cell"))
    guests = home.select("fp", "root", "code", "half", F.explode(ups).alias("cell"), F.lit(True).alias("guest"))
    return home, home.withColumn("guest", F.lit(False)).unionByName(guests)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def hub_links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b): each fingerprint and the hubs of its two cells, if within RADIUS bits.

    A cell's hubs, guests included, are its least fingerprints under len(TURNS)
    orders, each of which turns some bits over: links grow with the fingerprints
    alone, and the orders hold hubs in different parts of a cluster.
    """
    home, there = _cells(fps.select("fp", F.col("fp").alias("root")))
    turned = lambda c, t: F.col(c).bitwiseXOR(F.lit(t))
    hubs = there.groupBy("half", "cell").agg(*(F.min(turned("fp", t)).alias(f"_{i}") for i, t in enumerate(TURNS)))
    each = F.array(*(turned(f"_{i}", t) for i, t in enumerate(TURNS)))
    met = home.select("fp", "half", "cell").join(hubs, ["half", "cell"]).select("fp", F.explode(F.array_distinct(each)).alias("hub"))
    return met.where((F.col("fp") != F.col("hub")) & (_apart("fp", "hub") <= RADIUS)).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of roots of distinct fingerprints that differ in at most RADIUS bits, between different roots only.

    Without a column ``root`` each fingerprint is its own, and the pairs are all links.
    """
    home, there = _cells(fps if "root" in fps.columns else fps.withColumn("root", F.col("fp")))
    a, b = home.alias("a"), there.alias("b")
    low = F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code")).bitwiseAND(F.lit(0xFFFFFFFF)))
    met = a.join(
        b,
        (F.col("a.half") == F.col("b.half")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("b.guest") | (F.col("a.fp") < F.col("b.fp"))) & (F.col("a.root") != F.col("b.root"))
        & (_apart("a.code", "b.code") <= RADIUS) & (_apart("a.fp", "b.fp") <= RADIUS) & ((F.col("a.half") == 0) | (low > 1)),
    )
    return met.select(F.col("a.root").alias("a"), F.col("b.root").alias("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (least id reachable)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    units = cut(
        map_arrow(docs.select(id_col, text_col), partial(_units, id_type=to_arrow_type(kind), shingle=shingle, seed=seed), f"fp long, members array<{kind.simpleString()}>"),
        "fingerprints"
    )
    nodes = cut(units.groupBy("fp").agg(F.min(F.array_min("members")).alias("low_id")), "nodes")
    near = components(hub_links(nodes))
    placed = cut(nodes.join(near, nodes["fp"] == near["node"], "left").select("fp", "low_id", F.coalesce("root", "fp").alias("root")), "placed")
    far = cut(components(links(placed).distinct()).select(F.col("node").alias("_node"), F.col("root").alias("_root")), "roots")
    rooted = cut(placed.join(far, F.col("root") == F.col("_node"), "left").select("fp", "low_id", F.coalesce("_root", "root").alias("root")), "rooted")
    low = cut(rooted.groupBy("root").agg(F.min("low_id").alias("component_id")), "least-ids")
    named = cut(rooted.join(low, "root").select("fp", "component_id"), "named")
    rows = units.join(named, "fp").select(F.explode("members").alias(id_col), "fp", "component_id")
    return rows.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
