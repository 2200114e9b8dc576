"""Personal data and mixing against plain Python."""

import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilewright.llm import catalog, mixing, pii
from tilewright.plans import table

HARD = [
    None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12",
    "call +1 (805) 555-3764 or +49.30-1234567, +1 2", "é😀 mail: jo.e+x@ex-ample.co.uk, DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432 DE88 3704 0044 0532 0130 00",
    "a." * 4000 + "@" + "a." * 4000 + "b", "1." * 5000 + "1", "1 " * 5000, "+" + "1-" * 3000, "SSN 123-45-6789 and 123-45-6789" + " " * 60 + "987-65-4321", "a@b.c@d.e", "x@y.z1.2.3.4",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern, good) in enumerate([
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if good(m[0])]
    return sorted(found)


def check_pii(rows, texts):
    for r in rows:
        want = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), (r, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{a}:{b}" for a, _, b, k in want} <= set(r.spans.split(","))


def test_pii_hard_cases(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(HARD)], "doc_id long, text string, spans string")
    found = pii.find_pii(docs)
    rows = found.select("doc_id", *pii.pii_digest(found["spans"])).collect()
    assert len(rows) == len(HARD)
    check_pii(rows, dict(enumerate(HARD)))
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[6].count("iban") == 2
    assert spans[11].count("ssn") == 2  # the third has no context word near


def test_pii_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = catalog.op10_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check_pii(rows, texts)


def test_sums_before(spark):
    for n in (0, 1, 31, 32, 33, 1025, 40_000):
        numbers = F.transform(F.slice(F.sequence(F.lit(1), F.lit(n + 1)), 1, n), lambda x: (x * x).cast("long"))
        got = spark.range(1).select(pii.sums_before(numbers).alias("s")).first().s
        assert got == [0, *np.cumsum(np.arange(1, n + 1, dtype=np.int64) ** 2).tolist()][:n]


def test_pii_context_and_long_texts(spark):
    said = lambda n: " ".join(f"é mail x{i}@b.com," if i % 2 else f"😀 host 10.0.0.{i % 256} 4111 1111 1111 1111 or" for i in range(n))
    seconds = {}
    for n in (10_000, 40_000):
        docs = spark.createDataFrame([(None, said(n))], "doc_id long, text string")
        found = pii.find_pii(docs)
        pii.find_pii(docs.limit(0)).collect()
        began = time.perf_counter()
        r = found.select("spans", *pii.pii_digest(found["spans"])[:-2]).first()
        seconds[n] = time.perf_counter() - began
        text = said(n)
        assert [(s.start, s.rank, s.end, s.kind) for s in r.spans] == base_spans(text)
        for s in r.spans:
            base, words = pii.BASE[s.kind][1:]
            near = re.search(f"(?i)(?:{words})", text[max(0, s.start - pii.CONTEXT_CHARS) : s.start])
            assert abs(s.score - base - pii.CONTEXT_GAIN * bool(near)) < 1e-9
    assert seconds[40_000] < 8 * seconds[10_000] + 2  # in proportion, not with the square


def test_pii_repeated_rows(spark):
    docs = spark.createDataFrame([(3, "a@b.c")] * 4 + [(None, None)] * 2, "doc_id long, text string")
    assert sorted(len(r.spans) for r in pii.find_pii(docs).collect()) == [0, 0, 1, 1, 1, 1]


def test_pii_empty(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sainte_lague(votes, seats):
    won = {k: 0 for k in votes}
    for _ in range(seats):
        won[max(sorted(k for k in votes), key=lambda k: (votes[k] / (2 * won[k] + 1)))] += 1
    return won


def test_apportion_is_sainte_lague(spark):
    for votes, seats in [({"a": 53.0, "b": 24.0, "c": 23.0}, 7), ({"a": 1e6, "b": 3.0, "c": 2.0, "d": 1.0, "e": 0.0}, 100), ({k: 10.0 for k in "abcdef"}, 4), ({"a": 5.0}, 3), ({"x%02d" % i: float(i * i % 37 + 1) for i in range(40)}, 333)]:
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, k string, v double, seats long")
        got = {r.k: r.won for r in mixing.apportion(df, ["g"], ["k"], "v", "seats").collect()}
        assert got == sainte_lague(votes, seats)


def by_quotients(votes, seats):
    """Sainte-Lague for numbered parties by sorting all quotients that could win a seat."""
    most = int(seats * votes.max() / votes.sum() + len(votes) * votes.max() / votes.sum()) + 3
    n = np.arange(most)
    quotients = votes[:, None] / (2 * n + 1)
    order = np.lexsort((np.tile(n, len(votes)), np.repeat(np.arange(len(votes)), most), -quotients.ravel()))[:seats]
    return np.bincount(order // most, minlength=len(votes))


def test_apportion_narrows_many_parties(spark):
    rng = np.random.default_rng(7)
    for votes, seats, ranked in [(rng.integers(190_000, 210_000, 100_000), 1_250_003, 5000), (np.full(3000, 7), 4001, 50), (np.r_[rng.integers(1, 9, 2000), 10**6, 0, 0], 700, 100), (rng.integers(1, 50, 400), 5000, 10)]:
        df = spark.createDataFrame(pd.DataFrame({"g": "x", "k": np.arange(len(votes)), "v": votes, "seats": seats}))
        df = df.unionByName(spark.createDataFrame([(None, 1, 5, 4), (None, 2, 3, 4), ("none", 1, 0, 9)], "g string, k long, v long, seats long"))
        got = {(r.g, r.k): r.won for r in mixing.apportion(df, ["g"], ["k"], "v", "seats", ranked=ranked).collect()}
        assert [got["x", k] for k in range(len(votes))] == by_quotients(votes.astype(float), seats).tolist()
        assert (got[None, 1], got[None, 2], got["none", 1]) == (3, 1, 0) and len(got) == len(votes) + 3


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check_mix(rows, docs):
    sizes = defaultdict(int)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, text, source in docs:
        sizes[source] += words(text)
    want, taken = targets(sizes), defaultdict(int)
    source = {d: s for d, _, s in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(40, 0.01 * want[s]), (s, taken[s], want[s])


def test_mix_small(spark):
    docs = [
        (i, "w " * (i % 50) if i % 11 else None, [None, "b", "a", "é", "big", "big", "big"][i % 7]) for i in range(700)
    ] + [(5000, "only three words", "tiny"), (5001, "", "void")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, source string, size string")
    first = mixing.mix(df).collect()
    assert len(first) == len(docs)
    check_mix(first, docs)
    assert sorted(first) == sorted(mixing.mix(df.repartition(3)).collect())
    assert mixing.mix(df.limit(0)).count() == 0


def test_mix_repeated_and_empty_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "x " * 30_000, "t"), (None, None, "t")] + [(i, None, "void") for i in range(3000)] + [(7, "", None)] * 5
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    sizes = {"s": 6, "t": 30_000, "void": 0, None: 0}
    want = targets(sizes)
    assert sorted((r.doc_id or 0, r.size) for r in got) == sorted((d or 0, len((t or "").split())) for d, t, _ in rows)
    assert all(r.taken <= 3 * r.size and abs(r.target - want[next(s for s in sizes if sizes[s] == r.source_size and (r.source_size or s in ("void", None)))]) < 1e-6 for r in got)
    assert abs(sum(r.taken for r in got) - sum(want.values())) <= 40


def test_mix_whole_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").collect()]
    rows = catalog.op4_mixing(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check_mix(rows, docs)
