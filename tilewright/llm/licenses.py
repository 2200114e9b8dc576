"""License scans as an exact set-similarity join of text blocks with templates.

A text's words are cut into blocks of 2 x stride words, one every stride words,
so that any passage of up to stride + 1 words stands whole in a block; the stride
is STRIDE, or as long as the longest template needs. A block
meets a template if it holds at least the template's threshold share of the
template's distinct words. Templates are few and fixed, so they are sent to the
tasks with the order of their words by frequency in all documents; blocks are
joined where they stand, without a shuffle.

The join keeps, for each template, the rarest |T| - o + 1 words as its prefix (o
is the least overlap that meets the threshold): a block without any of them
cannot meet it. A block's own words outside all templates cannot overlap and
are left out first. On a shared prefix word the length filter (|B| >= o) and
the positional filter (what can still follow in both orders) drop the pair, or
the overlap is counted exactly. Phrases are templates with threshold 1 whose
words must moreover stand consecutively; this is checked in the blocks found.

Defined results: a null text counts as empty and has no words or matches; null
ids and repeated rows are kept; an empty table gives an empty result; other
columns are not read. Texts are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.plans import map_arrow

STRIDE = 32


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 1.0
    phrase: bool = False


#: The base phrases.
PHRASES = [
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
]
#: Passages of public licence texts, and notices in which every word counts.
PASSAGES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    Template("gpl", "licensed under the gnu general public license"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", 0.9),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", 0.9),
    Template("cc-by-sa", "creative commons attribution sharealike license"),
    Template("cc-by-nc", "creative commons attribution noncommercial license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8),
]
TEMPLATES = PHRASES + PASSAGES
#: A-Z to a-z; all other ASCII but digits and a-z to a space; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).split()


class Matcher:
    """Prefix index of the templates under one word order."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], stride: int = STRIDE):
        self.templates, self.stride = templates, stride
        self.words = [words(t.text) for t in templates]
        self.sets = [frozenset(w) for w in self.words]
        self.least = [math.ceil(t.threshold * len(s) - 1e-9) for t, s in zip(templates, self.sets, strict=True)]
        vocabulary = sorted(frozenset().union(*self.sets), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sets):
            ordered = sorted(s, key=self.rank.get)
            for at in range(len(s) - self.least[k] + 1):
                self.index.setdefault(ordered[at], []).append((k, at))

    def block(self, seg: list[bytes]) -> list[tuple[int, float]]:
        """Templates that the block's words meet, with their containment."""
        here = sorted({w for w in seg if w in self.rank}, key=self.rank.get)
        own, seen, found = set(here), set(), []
        for j, w in enumerate(here[: max(0, len(here) - min(self.least) + 1)]):
            for k, i in self.index.get(w, ()):
                if k in seen or len(here) < self.least[k]:
                    continue
                # The first shared word in the common order decides: all else that is shared comes after it in both.
                seen.add(k)
                if min(len(self.sets[k]) - i, len(here) - j) < self.least[k]:
                    continue
                overlap = len(self.sets[k] & own)
                if overlap >= self.least[k]:
                    found.append((k, overlap / len(self.sets[k])))
        return found

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, int, float]]]:
        """Number of words, and matches (template, block, start, containment); a phrase's start is a word, else its block's first."""
        ws, s = words(text), self.stride
        index = self.index
        blocks = sorted({b for i, w in enumerate(ws) if w in index for b in (i // s, i // s - 1) if b >= 0})
        out = []
        for b in blocks:
            seg = ws[b * s : b * s + 2 * s]
            for k, share in self.block(seg):
                if not self.templates[k].phrase:
                    out.append((k, b, b * s, share))
                    continue
                p = self.words[k]
                # Starts of the next block's stride are that block's.
                out += [(k, b, b * s + i, 1.0) for i in range(min(s, len(seg) - len(p) + 1)) if seg[i : i + len(p)] == p]
        return len(ws), out


def _count(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(filter(vocabulary.__contains__, words(text.as_py())))
    yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.binary()), pa.array([*counts.values()], pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, templates: list[Template] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates stands in all documents: at most as many rows as the templates have words."""
    vocabulary = frozenset(w for t in templates for w in words(t.text))
    rows = map_arrow(docs.select(text_col), partial(_count, vocabulary=vocabulary), "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _scan(batches: Iterator[pa.RecordBatch], templates: list[Template], counts: dict[bytes, int], stride: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(templates, counts, stride)
    kind = pa.list_(
        pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("template", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("containment", pa.float64())])
    )
    for batch in batches:
        lengths, matches = [], []
        for text in batch.column(1):
            n, found = matcher.scan(text.as_py())
            lengths.append(n)
            matches.append(
                [{"label": templates[k].label, "phrase": templates[k].phrase, "template": k, "block": b, "start": at, "containment": share} for k, b, at, share in found]
            )
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(matches, kind)], names=["id", "n_words", "matches"])


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", stride: int = STRIDE) -> DataFrame:
    """One row per input row: id, n_words, matches (label, phrase, template, block, start, containment)."""
    stride = max(stride, max(len(words(t.text)) for t in templates) - 1)
    kind = docs.schema[id_col].dataType.simpleString()
    made = map_arrow(
        docs.select(id_col, text_col), partial(_scan, templates=templates, counts=word_counts(docs, templates, text_col), stride=stride),
        f"id {kind}, n_words long, matches array<struct<label string, phrase boolean, template int, block long, start long, containment double>>",
    )
    return made.withColumnRenamed("id", id_col)
