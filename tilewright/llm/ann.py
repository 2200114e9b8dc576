"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are normalised and turned by learned rotations (the principal
axes, then iterative quantisation from seeded starts); the signs are the bits,
CODE_BITS in all. The code is cut into substrings of SUBSTRING_BITS, each an
index of its own, whose buckets are the substring's values.

A query probes, in each index, the buckets within that index's own radius. By
the pigeonhole principle the radii t_1 .. t_m retrieve every row whose code is
within sum(t_i + 1) - 1 bits of the query's. What is retrieved is reranked by
the cosine of the original vectors, in double precision.

The rotations are learned on at most ``sample`` rows, the radii on the true
neighbours, among all rows, of at most ``pilots`` of these: radii are raised,
the cheapest first (by the share of the sample that they retrieve), until the
buckets hold LEARNED of these neighbours. So they follow the data: narrow where
neighbours are close, wide where they are hardly closer than chance.

Queries for which the buckets hold fewer than k rows probe again, with radii
that retrieve every row; that is the exact way for the rest. No bucket, pack or
candidate list has a cap.

Buckets lie in shelves, by the upper bits of their value: a query is sent to the
shelves that a bucket within its radius can lie on, and looks there into the
directory of buckets. Shelves are cut where they stand into packs of bounded
size, so that a bucket with a third of all rows is many packs over many tasks,
and a task returns the best rows of each query only, never all pairs. Repeated
rows are folded before the best are chosen.

Defined results: vectors that are null, zero, of another length than most of the
sample, or hold null or non-finite components take no part, as query or
candidate; rows with a null id take no part; a repeated row counts once; of
equal cosines the smaller id comes first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.plans import cut, map_arrow

SAMPLE, PILOTS, LEARNED = 3000, 100, 0.97
CODE_BITS, SUBSTRING_BITS = 256, 32
PACK_ROWS, PACK_QUERIES, PAIRS, SHELF_ROWS, MOST_SHELF_BITS, SPREAD, FOLDED = 4096, 128, 32_768, 65_536, 20, 8, 200_000


@dataclass
class Coder:
    """Rotations, and the probing radius of each substring; a radius of -1 leaves an index out."""

    dim: int
    rotations: list[np.ndarray]
    radii: list[int] = field(default_factory=list)

    def unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Substrings of each row's code, unsigned 32-bit values."""
        u = self.unit(x.astype(np.float64))
        bits = np.concatenate([u @ r > 0 for r in self.rotations], axis=1)[:, :CODE_BITS]
        return np.packbits(bits, axis=1, bitorder="little").view("<u4")

    def radius(self) -> int:
        """Every code within so many bits is retrieved."""
        return sum(t + 1 for t in self.radii) - 1


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of substrings, rows of a by rows of b."""
    return np.bitwise_count(a[:, None] ^ b[None, :])


def fit(sample: list[list[float]]) -> Coder | None:
    """Learned rotations from a bounded sample; None without rows."""
    if not sample:
        return None
    dim = Counter(map(len, sample)).most_common(1)[0][0]
    x = np.array([v for v in sample if len(v) == dim], np.float64)
    coder = Coder(dim, [])
    u = coder.unit(x)
    values, axes = np.linalg.eigh(u.T @ u)
    axes = axes[:, np.argsort(-values, kind="stable")][:, :64]
    for seed in range(-(-CODE_BITS // axes.shape[1])):
        turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[1], axes.shape[1])))
        flat = u @ axes
        for _ in range(30):
            left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        coder.rotations.append(axes @ turn)
    return coder


def learn_radii(near: np.ndarray, far: np.ndarray, learned: float = LEARNED) -> list[int]:
    """Radii whose buckets hold ``learned`` of the neighbours (rows of substring distances), the fewest rows first.

    ``far`` holds the substring distances of rows taken at random.
    """
    radii = [-1] * far.shape[1]
    share = [np.cumsum(np.bincount(far[:, s], minlength=SUBSTRING_BITS + 1)) / max(1, len(far)) for s in range(far.shape[1])]
    while len(near) and (near <= np.array(radii)).any(axis=1).mean() < learned:
        s = min((s for s in range(len(radii)) if radii[s] < SUBSTRING_BITS), key=lambda s: (share[s][radii[s] + 1], s))
        radii[s] += 1
    return radii


def _valid(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def _distinct(batch: pa.RecordBatch, coder: Coder, kind: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of the distinct rows of a batch that have the common length."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    right = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == coder.dim)
    if not len(right):
        return None
    x = lists.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, coder.dim)
    rows = np.concatenate([ids[right].astype("<i8").view(np.uint8).reshape(-1, 8), x.view(np.uint8).reshape(len(x), -1)], axis=1)
    _, first = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True)
    first.sort()
    return ids[right][first].astype("<i8"), x[first]


def _pilot(batches: Iterator[pa.RecordBatch], coder: Broadcast, kind: str, pilots: list[tuple[int, list[float]]], k: int) -> Iterator[pa.RecordBatch]:
    """Per batch the k best rows of each pilot, with the distances of their substrings."""
    c: Coder = coder.value
    own, p = np.array([i for i, _ in pilots]), np.array([v for _, v in pilots], np.float64)
    codes = c.codes(p)
    for batch in batches:
        found = _distinct(batch, c, kind)
        if found is None:
            continue
        ids, x = found
        score = c.unit(p) @ c.unit(x.astype(np.float64)).T
        score[own[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        a, b = np.repeat(np.arange(len(p)), best.shape[1]), best.ravel()
        some = np.isfinite(score[a, b])
        a, b = a[some], b[some]
        apart = np.bitwise_count(codes[a] ^ c.codes(x)[b]).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own[a], pa.int64()), pa.array(ids[b], pa.int64()), pa.array(score[a, b]), pa.array([r.tobytes() for r in apart], pa.binary())],
            names=["query_id", "vec_id", "score", "apart"]
        )


def flips(bits: int, radius: int) -> list[int]:
    """All masks over so many bits with at most ``radius`` of them set."""
    return [sum(1 << b for b in some) for n in range(min(bits, radius) + 1) for some in combinations(range(bits), n)]


def _pack(batches: Iterator[pa.RecordBatch], coder: Broadcast, kind: str, shelf_bits: int, radii: list[int], probe: bool) -> Iterator[pa.RecordBatch]:
    """Packs of ids, substrings and vectors per (substring, shelf); queries (``probe``) name all shelves within the radius."""
    c: Coder = coder.value
    context = TaskContext.get()
    nth = context.partitionId() if context else 0
    for batch in batches:
        found = _distinct(batch, c, kind)
        if found is None:
            continue
        ids, x = found
        codes = c.codes(x)
        for s in (s for s, t in enumerate(radii) if t >= 0):
            shelf = (codes[:, s].astype(np.int64) >> (SUBSTRING_BITS - shelf_bits)) | (s << MOST_SHELF_BITS)
            order = np.lexsort((codes[:, s], shelf))
            edges = np.flatnonzero(np.diff(shelf[order], prepend=-1))
            size = PACK_QUERIES if probe else PACK_ROWS
            take = [run[at : at + size] for run in np.split(order, edges[1:]) for at in range(0, len(run), size)]
            masks = np.array(flips(shelf_bits, radii[s]) if probe else [0])
            # A shelf's packs are dealt over SPREAD keys, each of which queries go to.
            keys = [((shelf[t[0]] ^ masks)[:, None] * SPREAD + (np.arange(SPREAD) if probe else [(nth + i) % SPREAD])).ravel() for i, t in enumerate(take)]
            nth += len(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.list_(pa.int64())), *(pa.array([v[t].tobytes() for t in take], pa.binary()) for v in (ids, codes[:, s], x))],
                names=["keys", "ids", "codes", "vectors"]
            )


def _scores(q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a of q with rows b of v, a bounded number of pairs at a time."""
    qq, vv, out = (q * q).sum(axis=1), (v * v).sum(axis=1), np.empty(len(a))
    for at in range(0, len(a), PAIRS):
        i, j = a[at : at + PAIRS], b[at : at + PAIRS]
        out[at : at + PAIRS] = (q[i] * v[j]).sum(axis=1) / np.sqrt(qq[i] * vv[j])
    return out


def _folded(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, nearest first; equal rows count once."""
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1]) | (score[1:] != score[:-1])
    q, v, score = q[new], v[new], score[new]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], score[keep]


def _best(batches: Iterator[pa.RecordBatch], kind: str, dim: int, radii: list[int], k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each query among the rows in its buckets, over the pairs of a pack of queries and a pack of rows.

    What pairs of packs yield is folded as it comes, so a task returns about k
    rows a query, not k rows a pair; beyond FOLDED rows it returns what it has.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    fold = lambda: _folded(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
    out = lambda cols: pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        for r in range(batch.num_rows):
            read = lambda n, t: np.frombuffer(cols[n][r].as_buffer(), t)  # noqa: B023, E731
            qid, vid, values = read("q_ids", "<i8"), read("ids", "<i8"), read("codes", "<u4")
            # A pack is sorted by value: its directory of buckets is where values change.
            edges = np.flatnonzero(np.diff(values, prepend=values[0] ^ np.uint32(1)))
            hit = distance(read("q_codes", "<u4"), values[edges]) <= radii[cols["key"][r].as_py() // SPREAD >> MOST_SHELF_BITS]
            if len(edges) < len(values):
                hit = np.repeat(hit, np.diff(edges, append=len(values)), axis=1)
            a, b = np.nonzero(hit)
            other = qid[a] != vid[b]
            a, b = a[other], b[other]
            if not len(a):
                continue
            q, v = (read(n, kind).reshape(-1, dim).astype(np.float64) for n in ("q_vectors", "vectors"))
            held.append(_folded(qid[a], vid[b], _scores(q, v, a, b), k))
            size += len(held[-1][0])
            if size > FOLDED:
                held = [fold()]
                size = len(held[0][0])
                if size > FOLDED // 2:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(fold())


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Index:
    """The rows, the learned coder, and how values are cut into shelves."""

    rows: DataFrame
    coder: Coder
    shelf_bits: int
    kind: str
    sent: Broadcast

    def search(self, queries: DataFrame, radii: list[int], k: int) -> DataFrame:
        """(query_id, vec_id, score, rank): the k best of what the buckets within the radii hold."""
        packed = lambda df, probe: map_arrow(
            df.select("id", "v"), partial(_pack, coder=self.sent, kind=self.kind, shelf_bits=self.shelf_bits, radii=radii, probe=probe), "keys array<long>, ids binary, codes binary, vectors binary"
        )
        asked = packed(queries, True).select(F.explode("keys").alias("key"), F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"), F.col("vectors").alias("q_vectors"))
        held = packed(self.rows, False).select(F.col("keys")[0].alias("key"), "ids", "codes", "vectors")
        best = partial(_best, kind=self.kind, dim=self.coder.dim, radii=radii, k=k)
        return _top(map_arrow(asked.join(held, "key"), best, "query_id long, vec_id long, score double").distinct(), k)


def build(rows: DataFrame, k: int, sample: int = SAMPLE, pilots: int = PILOTS) -> Index:
    """Learns rotations and radii for (id, v) rows; see the module's text for the two bounds."""
    spark = rows.sparkSession
    n = rows.count()
    # A hash below the rate leaves about the sample, and the limit binds what reaches the driver, repeated rows or not.
    place = F.pmod(F.xxhash64(F.lit("ann"), "id", "v"), F.lit(1 << 40)) / float(1 << 40)
    some = rows.where(place < min(1.0, 1.5 * sample / max(n, 1))).select(place.alias("at"), "id", "v").distinct().orderBy("at", "id", "v").limit(sample).collect()
    coder = fit([r.v for r in some]) or Coder(0, [])
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    shelf_bits = int(np.clip(round(np.log2(max(n, 1) / SHELF_ROWS)), 0, MOST_SHELF_BITS))
    asked = [(r.id, list(r.v)) for r in some if len(r.v) == coder.dim]
    if asked:
        found = map_arrow(
            rows.select("id", "v"), partial(_pilot, coder=spark.sparkContext.broadcast(coder), kind=kind, pilots=asked[:pilots], k=k),
            "query_id long, vec_id long, score double, apart binary"
        )
        near = np.array([list(r.apart) for r in _top(found.distinct(), k).select("apart").collect()], np.uint8).reshape(-1, CODE_BITS // SUBSTRING_BITS)
        codes = coder.codes(np.array([v for _, v in asked]))
        far = np.concatenate([np.bitwise_count(codes[i] ^ codes[i + 1 :]) for i in range(min(pilots, len(codes)))])
        coder.radii = learn_radii(near, far)
    return Index(rows, coder, shelf_bits, kind, spark.sparkContext.broadcast(coder))


def vector_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, floats as they are and other numbers as doubles."""
    v = F.col(vector_col)
    if not isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType):
        v = v.cast("array<double>")
    return vectors.where(F.col(id_col).isNotNull() & _valid(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, pilots: int = PILOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest by cosine among all rows but its own."""
    rows = vector_rows(vectors, id_col, vector_col)
    queries = vector_rows(vectors.where(is_query), id_col, vector_col)
    index = build(rows, k, sample, pilots)
    found = cut(index.search(queries, index.coder.radii, k).drop("rank"), "near")
    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = cut(queries.join(full, F.col("id") == F.col("query_id"), "left_anti"), "short-queries")
    if not short.isEmpty():
        everything = [SUBSTRING_BITS] + [-1] * (CODE_BITS // SUBSTRING_BITS - 1)
        found = found.unionByName(index.search(short, everything, k).drop("rank")).distinct()
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
