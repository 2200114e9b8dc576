"""Exact dedup by deterministic block naming.

A text, with each run of white space made one space, is cut into blocks of
``block_bytes``. Equal blocks are sorted next to each other and get one integer
name; adjacent pairs of names are then named in the same way, level by level,
until each text has one name. (level, name) identifies a text without any
collision: names are given by comparing content, never by hashing it.

A task first folds equal texts among the rows it reads into one unit with its
members, so that a text that a third of all rows share reaches the shuffles as
a few units. The texts cross the network once, at level 0. A block (or pair)
that stands in more than HOT units is named in two rounds: salted over many
tasks, each of which hands on one copy, and then among these copies. A hash
tells which blocks those are and nothing else, so it cannot change a name.
Names depend on the sorted content of a partition alone, so a recomputed task
gives the same ones. Levels are written to the shared folder; their number grows
with the logarithm of the longest text.

Defined results: a null text counts as empty; texts of any length are named
whole; null ids are members that are never chosen while another id is there; of
rows repeated with the same id and text exactly one is kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tilewright.plans import cut, forget, map_arrow

BLOCK_BYTES, FOLD_BYTES, MEMBER_BYTES, STEP = 16_384, 12_000_000, 32, 512
HOT, SALTS = 500, 64
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with each white-space run as one space."""
    return _SPACE.sub(b" ", (text or "").encode())


def _units(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (uid, pos, n, block, mark, sha, members): the blocks of each distinct text of what has been read."""
    context = TaskContext.get()
    uid = (context.partitionId() if context else 0) << 40
    schema = pa.schema(
        [("uid", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("block", pa.binary()), ("mark", pa.int64()), ("sha", pa.string()), ("members", pa.list_(id_type))]
    )
    folded: dict[bytes, list] = {}
    held = 0

    def out() -> pa.RecordBatch:
        nonlocal uid
        cols: tuple[list, ...] = tuple([] for _ in schema)
        for text, members in folded.items():
            cuts = range(0, max(1, len(text)), block_bytes)
            for pos, at in enumerate(cuts):
                block = text[at : at + block_bytes]
                row = (uid, pos, len(cuts), block, xxh64_intdigest(block) >> 1, None if pos else hashlib.sha256(text).hexdigest(), None if pos else members)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            uid += 1
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            norm = normalise(text.as_py())
            if norm in folded:
                folded[norm].append(doc)
            else:
                folded[norm] = [doc]
                held += len(norm) + 200
            held += len(doc) if isinstance(doc, str) else MEMBER_BYTES
            if held > FOLD_BYTES:
                yield out()
                folded, held = {}, 0
    if folded:
        yield out()


def _name_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds ``name``, new at each change of the sorted keys, and leaves the keys out but for salted rows that begin a name."""
    context = TaskContext.get()
    name, last, shown = ((context.partitionId() if context else 0) << 40) - 1, None, False
    for batch in batches:
        names, kept = [], []
        for at in range(0, batch.num_rows, STEP):  # a few blocks at a time leave Arrow's memory
            *cols, salts = (batch.column(k).slice(at, STEP).to_pylist() for k in (*keys, "salt"))
            for key, salt in zip(zip(*cols, strict=True), salts, strict=True):
                if key != last:
                    name, last, shown = name + 1, key, False
                names.append(name)
                kept.append(len(names) - 1 if salt is not None and not shown else None)
                shown = shown or salt is not None
        rest = [c for c in batch.schema.names if c not in (*keys, "salt")]
        first = pa.array(kept, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(names, pa.int64()), *(batch.column(k).take(first) for k in keys)],
            names=[*rest, "name", *keys]
        )


def _named(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Integer names for the distinct key values: equal values meet in a partition and are sorted there.

    ``df`` has been cut and has a hash of the keys as ``mark``; it is deleted. A
    mark of more than HOT rows is salted: then each task gives its own name
    to a value, and the copies that tasks hand on say which of these are one.
    """
    hot = cut(df.groupBy("mark").count().where(F.col("count") > HOT).select("mark", F.lit(True).alias("hot")), f"hot-{label}")
    cold = hot.isEmpty()
    if cold:
        salted = df.withColumn("salt", F.lit(None).cast("int"))
    else:
        salted = df.join(hot, "mark", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))).drop("hot")
    salted = salted.drop("mark")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in salted.schema if f.name not in (*keys, "salt"))
    shown = ", ".join(f"{k} {salted.schema[k].dataType.simpleString()}" for k in keys)
    dealt = salted.repartition(*keys, "salt").sortWithinPartitions(*keys)
    named = cut(map_arrow(dealt, partial(_name_runs, keys=keys), f"{schema}, name long, {shown}"), label)
    forget(df, hot)
    if cold:
        return named.drop(*keys)
    copies = named.where(F.col(keys[0]).isNotNull()).select("name", F.min("name").over(Window.partitionBy(*keys)).alias("_one"))
    renamed = cut(copies.where("name <> _one").distinct(), f"one-{label}")
    made = cut(named.drop(*keys).join(renamed, "name", "left").withColumn("name", F.coalesce("_one", "name")).drop("_one"), label)
    forget(named, renamed)
    return made


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Units of equal texts (uid, level, name, sha, members); equal texts of different tasks share (level, name)."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[id_col].dataType
    schema = f"uid long, pos int, n int, block binary, mark long, sha string, members array<{id_type.simpleString()}>"
    blocks = cut(map_arrow(docs.select(id_col, text_col), partial(_units, id_type=to_arrow_type(id_type), block_bytes=block_bytes), schema), "units")
    now, level, done = _named(blocks, ["block"], "names-0"), 0, []
    while True:
        done.append(now.where("n = 1").select("uid", F.lit(level).alias("level"), "name", "sha", "members"))
        if (now.agg(F.max("n")).first()[0] or 0) <= 1:
            return reduce(DataFrame.unionByName, done)
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = now.where("n > 1").groupBy("uid", F.floor(F.col("pos") / 2).cast("int").alias("at")).agg(
            F.ceil(F.max("n") / 2).cast("int").alias("n"), side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right"),
            F.first("sha", ignorenulls=True).alias("sha"), F.first("members", ignorenulls=True).alias("members"),
        ).withColumnRenamed("at", "pos")
        level += 1
        now = _named(cut(pairs.withColumn("mark", F.xxhash64("left", "right")), f"pairs-{level}"), ["left", "right"], f"names-{level}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    units = identities(docs, id_col, text_col, block_bytes)
    least = F.array_min("members")
    units = units.withColumn("best", F.struct(least.isNull().alias("none"), least.alias("id"), "uid"))
    groups = units.groupBy("level", "name").agg(F.min("best").alias("keep"), F.sum(F.size("members")).cast("long").alias("group_size"))
    rows = units.join(groups, ["level", "name"]).select("*", F.posexplode(F.array_sort("members")).alias("nth", "member"))
    kept = (F.col("uid") == F.col("keep.uid")) & (F.col("nth") == 0)
    return rows.select(F.col("member").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
