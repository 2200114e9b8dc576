"""Corpus pipeline: language, exact copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
rows that its predecessor kept, and its decisions take effect: all but the last
return the columns of ``documents``. Languages are told row by row, so documents
pass through that stage as they are; the next three return decisions, which a
merge join with the documents applies at every size: kept ids grow with the
corpus and are never broadcast. Both dedup stages decide by id and text, so rows
that share an id are told apart; in the mix they share the greatest of their
counts. Null ids are ids like others; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import catalog, exact_dedup, langid, mixing, simhash
from tilewright.plans import cut, forget, ship, table


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: frozenset[str] | None = None) -> DataFrame:
    """Drops texts of no language (null, or without a letter) or of none of ``languages``; unlabelled texts get the one found.

    ``languages`` are those that stay, all that labels name where it is None.
    Without a label to learn from no language can be told, and only the texts
    that can have none go.
    """
    model = langid.fit(langid.training_sample(docs))
    if model is None:
        ship(spark)
        return docs.where(F.udf(langid.has_letter, "boolean")("text"))
    said = langid.predict(docs, model, carry=True).where("lang_pred <> 'und'").select("row.*", F.col("lang_pred").alias("_said"))
    if languages is not None:
        said = said.where(F.col("_said").isin(*languages))
    return said.select(*(F.coalesce("lang", "_said").alias(c) if c == "lang" else c for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, once if its row is repeated."""
    rows = cut(exact_dedup.exact_dedup(docs).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept"), "copies")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")
    named = docs.withColumn("_text_sha", F.sha2(text, 256))
    on = lambda ids: F.col("doc_id").eqNullSafe(ids["_id"]) & (F.col("_text_sha") == ids["_sha"])
    kept = rows.where("kept")
    found = named.join(kept.hint("merge"), on(kept), "left_semi")
    repeated = cut(rows.groupBy("_id", "_sha").count().where("count > 1"), "repeated")
    if not repeated.isEmpty():
        found = found.join(repeated, on(repeated), "left_anti").unionByName(found.join(repeated, on(repeated), "left_semi").dropDuplicates(["doc_id", "_text_sha"]))
    return found.drop("_text_sha")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the document with the smallest id stays; of rows that share it, that of the least text mark, once."""
    text = F.coalesce("text", F.lit(""))
    # An id can stand for several texts, so a row's name holds a mark of its text; null ids come last.
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("mark"), F.length(text).alias("chars"))
    named = docs.withColumn("_row", row)
    groups = simhash.near_dedup(named.select("_row", "text"), id_col="_row")
    kept = cut(groups.where("_row = component_id").groupBy("_row").count(), "near-kept")
    once, often = kept.where("count = 1").alias("k"), kept.where("count > 1").alias("k")
    of = lambda ids: named.alias("n").join(ids.hint("merge"), F.col("n._row") == F.col("k._row"), "left_semi")
    found = of(once)
    if not often.isEmpty():
        found = found.unionByName(of(often).dropDuplicates(["_row"]))
    return found.drop("_row")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole time: 0 to 3."""
    taken = mixing.mix(docs).select("doc_id", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("times"))
    times = cut(taken.where("times > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("times").alias("times")), "times")
    found = docs.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_nth")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return catalog.bpe_digest(docs)


STAGES = [
    ("language ID", keep_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Kernel scores and merges by rank are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread by the next, which deletes what it read."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
