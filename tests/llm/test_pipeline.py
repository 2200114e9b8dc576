"""The pipeline's stages against plain Python, each on its own input."""

import re

import corpus_pipeline
from tilewright.llm import langid
from tilewright.plans import table

from tests.llm.test_models import brute_fp, close, union
from tests.llm.test_native import targets


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, tiny_dir):
    docs = table(spark, tiny_dir, "documents")
    extra = spark.createDataFrame(
        [
            (9000, None, "en", "src1", 0), (9001, "12 34 !", "en", "src1", 7), (9002, "", None, "src2", 0), (9003, "the and of that", None, None, 1),
            (9003, "the and of that", None, None, 1), (9004, "the  and of that", "en", "src1", 1)
        ],
        docs.schema
    )
    docs = docs.unionByName(extra)
    columns = docs.columns
    rows = docs.collect()

    kept = corpus_pipeline.keep_language(spark, docs, tiny_dir)
    got = sorted(r.doc_id for r in kept.collect())
    assert kept.columns == columns and got == sorted(r.doc_id for r in rows if any(c.isalpha() for c in r.text or ""))

    before = kept.collect()
    kept = corpus_pipeline.drop_copies(spark, kept, tiny_dir)
    first = {}
    for r in before:
        k = re.sub(r"[ \t-\r]+", " ", r.text)
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())

    before = kept.collect()
    kept = corpus_pipeline.drop_near_copies(spark, kept, tiny_dir)
    fps = {r.doc_id: brute_fp(r.text) for r in before}
    roots, least = union({*fps.values()}, close(sorted({*fps.values()}))), {}
    for d, f in fps.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())

    before = {r.doc_id: r for r in kept.collect()}
    mixed = corpus_pipeline.mix_sources(spark, kept, tiny_dir)
    sizes, taken = {}, {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in mixed.collect():
        assert r == before[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    longest = max(len(words(r.text)) for r in before.values())
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= longest  # at most one document of a shard is cut and rounded
    ended = corpus_pipeline.encode(spark, mixed, tiny_dir)
    assert ended.count() == mixed.count()


def test_languages_that_do_not_stay_go(spark, tiny_dir):
    docs = table(spark, tiny_dir, "documents").unionByName(
        spark.createDataFrame([(9100, "the house and the garden of that man", None, "s", 1)], table(spark, tiny_dir, "documents").schema)
    )
    model = langid.fit(langid.training_sample(docs))
    said = {(r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()}
    kept = corpus_pipeline.keep_language(spark, docs, tiny_dir, frozenset({"en", "fr"})).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, lang in said if lang in ("en", "fr")) and {lang for _, lang in said} > {"en", "fr"}
    assert {r.lang for r in kept if r.doc_id == 9100} == {"en"}  # an unlabelled document gets the language found


def test_near_copies_of_shared_and_null_ids(spark, tiny_dir):
    schema = table(spark, tiny_dir, "documents").schema
    long = " ".join(f"word{i}" for i in range(400))
    texts = [
        (5, long), (5, long + " end"), (5, "something else that is quite short"), (None, "null id text one two three"),
        (None, "another null id text four five"), (7, long + " end"), (8, "z y x w"), (8, "z y x w"), (3, "q r s t u"), (None, "q r s t u")
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], schema)
    fps = [brute_fp(t) for _, t in texts]
    roots = union({*fps}, close(sorted({*fps})))
    kept = corpus_pipeline.drop_near_copies(spark, docs, tiny_dir).collect()
    assert len(kept) == len({*roots.values()})  # one document of each group
    best = {}
    for (i, _), f in zip(texts, fps, strict=True):
        best[roots[f]] = min(best.get(roots[f], (True, 0)), (i is None, i or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(best.values())


def test_empty_table(spark, tiny_dir):
    docs = table(spark, tiny_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny_dir)
        assert docs.count() == 0


def test_repeated_and_null_ids_through_all_stages(spark, tiny_dir):
    schema = table(spark, tiny_dir, "documents").schema
    rows = [
        (
            i % 40 if i % 9 else None, f"the text number {i} of the corpus says that {'und der ' * (i % 7)}", "en" if i % 2 else "de",
            f"s{i % 3}" if i % 11 else None, 1
        ) for i in range(300)
    ]
    docs = spark.createDataFrame(rows + rows[:50] + [(None, None, None, None, None)] * 3, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny_dir)
        assert docs.columns == schema.names and docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tiny_dir).count() == docs.count()


def test_unlabelled_corpus_is_kept(spark, tiny_dir):
    schema = table(spark, tiny_dir, "documents").schema
    texts = [None, "", "12 34 !", "the and of that", "das ist der Text", "的", "𐍈", "😀", "x" * 50, "٣ 4\n"]
    docs = spark.createDataFrame([(i, t, None, "src1", 1) for i, t in enumerate(texts * 3)], schema)
    kept = corpus_pipeline.keep_language(spark, docs, tiny_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in enumerate(texts * 3) if any(c.isalpha() for c in t or "")]


def test_run(spark, tiny_dir):
    assert sorted(corpus_pipeline.run(spark, tiny_dir).collect()) == sorted(corpus_pipeline.run(spark, tiny_dir).collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "source mixing", "byte-level BPE"]
