"""Language identification by string kernels.

A text is the set of its character 1- to 3-grams (a blended spectrum, presence
only); two texts' kernel is the number of shared grams, divided by the root of
the product of their set sizes. Landmark texts give the Nystrom map: a text's
kernel values with the landmarks, times the inverse root of the landmarks' own
kernel matrix. One-versus-rest ridge regression on that map is the classifier;
a batch of texts is scored by two matrix products.

Grams count only if a landmark has them, so a text is a row over that fixed
vocabulary. Characters are folded by a table learned from the training texts:
each of their letters in lower case is a symbol, everything that is no letter a
space, letters that training never saw one class; a gram is then a number without
collisions, looked up in the vocabulary: in a table where all possible grams are
few, else by searching its sorted numbers. The vocabulary has no cap: it holds 4
bytes per gram and landmark, so it grows with the landmarks' distinct grams.

Training reads a bounded sample: at most ``max_train`` labelled rows, spread
evenly over the languages (at most ``max_train`` of them) and chosen in the
cluster by a hash of id and text; repeated rows count once, and no more than
``max_train`` rows reach the driver. ``landmarks`` of them are landmarks.
Everything else covers all rows and whole texts.

Defined results: null texts and texts without a letter are ``und`` with score
0; without training rows all texts are; of languages with equal scores the first
by code point is said; a null id is not held out; repeated rows are repeated; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.plans import map_arrow

MAX_TRAIN, LANDMARKS, RIDGE, ROWS = 1600, 96, 1e-2, 64
TABLED = 1 << 22  # possible grams up to which they are tabled
SPACE, OTHER = 0, 1
_LETTER = regex.compile(r"\p{L}")


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    """All that scoring needs; a few megabytes for alphabets, more for landmarks of many different grams."""

    langs: list[str]
    symbols: int
    fold: np.ndarray  # code point -> symbol
    vocabulary: np.ndarray  # sorted grams; a gram's place is its column
    landmarks: np.ndarray  # vocabulary x landmarks, scaled by the landmarks' set sizes
    weights: np.ndarray  # landmarks x languages, the Nystrom map and the ridge weights multiplied out
    bias: np.ndarray

    def grams(self, text: str) -> list[np.ndarray]:
        """Numbers of the 1-, 2- and 3-grams of a whole text."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        s = self.fold[points].astype(np.int64)
        s = s[np.concatenate([[True], (s[1:] != SPACE) | (s[:-1] != SPACE)])] if len(s) else s
        n = self.symbols
        two = s[:-1] * n + s[1:]
        three = two[:-1] * n + s[2:]
        return [s, two + n, three + n + n**2]

    @cached_property
    def table(self) -> np.ndarray | None:
        """The column of each possible gram, where these are few."""
        size = sum(self.symbols**n for n in (1, 2, 3))
        if size > TABLED:
            return None
        made = np.full(size, len(self.vocabulary), np.int32)
        made[self.vocabulary] = np.arange(len(self.vocabulary))
        return made

    def columns(self, grams: np.ndarray) -> np.ndarray:
        """Columns of grams; one past the last for those that no landmark has."""
        if self.table is not None:
            return self.table[grams]
        at = np.searchsorted(self.vocabulary, grams)
        return np.where(self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == grams, at, len(self.vocabulary))

    def presence(self, texts: list[str]) -> np.ndarray:
        """One row per text over the vocabulary, 1 where the gram is present."""
        rows = np.zeros((len(texts), self.landmarks.shape[0] + 1), np.float32)
        for row, text in zip(rows, texts, strict=True):
            for g in self.grams(text):
                row[self.columns(g)] = 1
        return rows[:, :-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values, texts by languages."""
        rows = self.presence(texts)
        size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return (rows @ self.landmarks) / size @ self.weights + self.bias


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def fit(samples: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Classifier from (text, language) rows, in the given order; None without rows."""
    samples = [(t, lang) for t, lang in samples if has_letter(t)]
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    letters = {low(c) for c in set().union(*(t for t, _ in samples)) if c.isalpha()}
    known = {c: i for i, c in enumerate(sorted(letters), 2)}
    fold = np.full(0x110000, SPACE, np.int32)
    for p in range(0x110000):
        c = chr(p)
        if c.isalpha():
            fold[p] = known.get(low(c), OTHER)

    # Landmarks in turn from each language, so that none is without.
    by_lang = [[t for t, x in samples if x == lang] for lang in langs]
    chosen = [own[i] for i in range(max(map(len, by_lang))) for own in by_lang if i < len(own)][:landmarks]
    symbols, none = len(known) + 2, np.zeros(0)
    everything = Model(langs, symbols, fold, none, none, none, none)
    sets = [np.unique(np.concatenate(everything.grams(t))) for t in chosen]
    vocabulary = np.unique(np.concatenate(sets))
    z = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for k, s in enumerate(sets):
        z[np.searchsorted(vocabulary, s), k] = 1 / np.sqrt(len(s))
    model = Model(langs, symbols, fold, vocabulary, z, np.zeros((len(chosen), len(langs))), np.zeros(len(langs)))

    values, vectors = np.linalg.eigh((z.T @ z).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    kernel = []
    for at in range(0, len(samples), ROWS):
        rows = model.presence([t for t, _ in samples[at : at + ROWS]])
        kernel.append((rows @ z) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1)))
    features = np.concatenate(kernel).astype(np.float64) @ root
    wanted = np.array([[lang == x for x in langs] for _, lang in samples], np.float64)
    mean, bias = features.mean(axis=0), wanted.mean(axis=0)
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(samples) * np.eye(centred.shape[1]) * 0.01, centred.T @ (wanted - bias))
    model.weights, model.bias = (root @ solved).astype(np.float32), (bias - mean @ solved).astype(np.float32)
    return model


def training_sample(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``max_train`` labelled rows with a letter, the same number of each language, lowest hashes first."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    # Languages are few; more than max_train of them could not be learned from this sample anyway.
    counts = dict(rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(max_train).collect())
    if not counts:
        return []
    each = max(1, max_train // len(counts))
    # A hash below the rate leaves about twice what is needed; the ranks and the limit bind what is collected.
    place = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / float(1 << 40)
    rate = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * each / n)))), F.col(lang_col))
    some = rows.select(place.alias("at"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), rate.alias("rate")).where("at < coalesce(rate, 0.0)")
    order = Window.partitionBy("l").orderBy("at", "t")
    least = some.where(F.col("t").rlike(r"\p{L}")).drop("rate").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each)
    return [(r.t, r.l) for r in least.orderBy("at", "t", "l").limit(max_train).collect() if has_letter(r.t)]


def _predict(batches: Iterator[pa.RecordBatch], model: Broadcast, text_col: str, carried: bool) -> Iterator[pa.RecordBatch]:
    m: Model | None = model.value
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            texts = [t.as_py() for t in (batch.column(2).field(text_col) if carried else batch.column(2))]
            said, sure = ["und"] * len(texts), [0.0] * len(texts)
            live = [i for i, t in enumerate(texts) if m and has_letter(t)]
            if live:
                scores = m.scores([texts[i] for i in live])
                best = scores.argmax(axis=1)
                for i, k, row in zip(live, best, scores, strict=True):
                    said[i], sure[i] = m.langs[k], float(min(1.0, max(0.0, row[k])))
            rows = [batch.column(2)] if carried else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *rows, pa.array(said, pa.string()), pa.array(sure, pa.float64())],
                names=["id", "held_out", *["row"] * carried, "lang_pred", "score"]
            )


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score; with ``carry`` also ``row``, the whole input row.

    A caller that keeps or drops rows by their language needs no join then.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.struct(*docs.columns).alias("row") if carry else F.col(text_col))
    schema = T.StructType(
        [rows.schema["id"], rows.schema["held_out"], *([rows.schema["row"]] if carry else []), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return map_arrow(rows, partial(_predict, model=sent, text_col=text_col, carried=carry), schema).withColumnRenamed("id", id_col)
