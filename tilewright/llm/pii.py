"""Personal data: regular expressions propose, checksums confirm, context adjusts.

Everything is a column expression. Each kind has a pattern; Luhn (cards) and
mod-97 (IBANs) drop proposals that fail; words close before a span raise its
score, and kinds that are weak alone (``ssn``) count only with such words.

Defined results: a null text counts as empty and has no spans; a null id is
kept; repeated rows give repeated results; other columns of the input are not
returned, so their names cannot clash; spans sort by start, then kind, so that
there are no ties. Texts of any length are read whole: patterns are possessive
and anchored to the start of a run, so the regex stack is flat, and places come
from running sums, a fixed number of matches at a time, and context from the
stretch of the text that holds it, so time is linear in the text and its matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in report order with pattern, score, context words.
#: The lookbehind or \G at a pattern's head tries each run of characters once;
#: possessive repeats never give characters back. Neither changes what matches.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write|kontakt|correo|courriel"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|host|server|address|adresse"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8, "card|visa|credit|karte|carte|tarjeta|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "call|phone|tel|fax|mobile|telefon|appel"),
}
ADDED = {
    "iban": (r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", 0.9, "iban|account|konto|compte|cuenta|bank"),
    "ssn": (r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", 0.3, "ssn|social security"),
}
KINDS = [*BASE, *ADDED]
#: What a text must hold before a kind's full pattern is tried.
HINTS = {
    "email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"
}
CONTEXT_CHARS, CONTEXT_GAIN, LEAST_SCORE = 40, 0.1, 0.4
#: Numbers summed at a time, levels of such sums, and characters of a stretch of text.
SUMMED, LEVELS, STRETCH = 64, 2, 512


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    worth = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).otherwise((d * 2) % 10 + F.floor(d / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where an account number without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    code = F.transform(F.split(turned, ""), lambda c: F.ascii(c))
    return F.aggregate(code, F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97) == 1


def _confirmed(kind: str, m: Column) -> Column:
    """The part of a proposal that its kind's validator accepts, else null."""
    if kind == "ip":
        parts = F.split(m, r"\.")
        return F.when(F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) < 4) & F.forall(parts, lambda p: F.right(p, F.lit(3)).cast("int") <= 255), m)
    if kind == "card":
        n = F.length(_digits(m))
        return F.when(n.between(12, 19), F.when(luhn(_digits(m)), m))
    if kind == "phone":
        return F.when(F.length(_digits(m)).between(9, 15), m)
    if kind == "iban":
        shorter = F.regexp_replace(m, r"\x20[A-Z0-9]*$", "")
        tight = lambda s: F.replace(s, F.lit(" "), F.lit(""))
        return F.when(mod97(tight(m)), m).when((shorter != m) & (F.length(tight(shorter)) >= 15) & mod97(tight(shorter)), shorter)
    return m


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def sums_before(numbers: Column, levels: int = LEVELS) -> Column:
    """For each number the sum of all before it: SUMMED at a time, on top of the sums of such groups."""
    zero = F.lit(0).cast("long")
    total = lambda g: F.aggregate(g, zero, lambda a, x: a + x)
    within = lambda g: F.transform(g, lambda _, i: total(F.slice(g, 1, i)))
    if not levels:
        return _let(numbers, within)
    groups = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / SUMMED).cast("int")), lambda k: F.slice(a, k * SUMMED + 1, SUMMED))
    based = lambda gs: F.zip_with(gs, sums_before(F.transform(gs, total), levels - 1), lambda g, base: F.transform(within(g), lambda v: v + base))
    return _let(numbers, lambda a: F.when(F.size(a) > SUMMED, F.flatten(_let(groups(a), based))).otherwise(within(a)))


def _proposals(text: Column, pattern: str) -> Column:
    """Matches of a pattern, each with what lies between it and the one before."""
    pairs = lambda found: F.zip_with(found, F.slice(F.split(text, pattern), 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs)


def _placed(found: Column) -> Column:
    """(rank, start, m) of a kind's proposals, in code points."""
    lengths = F.transform(found["pairs"], lambda p: (F.length(p["gap"]) + F.length(p["m"])).cast("long"))
    place = lambda p, before: F.struct(found["rank"].alias("rank"), (before + F.length(p["gap"])).cast("int").alias("start"), p["m"].alias("m"))
    return F.zip_with(found["pairs"], sums_before(lengths), place)


def _before(stretches: Column, start: Column) -> Column:
    """The CONTEXT_CHARS characters before a place, from the stretch that holds it and the one before."""
    at = F.floor(start / STRETCH).cast("int")
    two = F.concat(F.when(at > 0, F.get(stretches, at - 1)).otherwise(""), F.substring(F.coalesce(F.get(stretches, at), F.lit("")), F.lit(1), start % STRETCH))
    return F.right(two, F.lit(CONTEXT_CHARS))


def _by_kind(rank: Column, said: Callable[[str], Column]) -> Column:
    """What is said of the kind with this rank."""
    return reduce(lambda a, k: a.when(rank == KINDS.index(k), said(k)), KINDS[1:], F.when(rank == 0, said(KINDS[0])))


def _span(x: Column, stretches: Column) -> Column:
    """The confirmed span of a placed proposal, else null."""
    kinds, rank = BASE | ADDED, x["rank"]
    good = _by_kind(rank, lambda k: _confirmed(k, x["m"]))
    near = _by_kind(rank, lambda k: _before(stretches, x["start"]).rlike(f"(?i)(?:{kinds[k][2]})"))
    score = F.round(F.element_at(F.array(*(F.lit(kinds[k][1]) for k in KINDS)), rank + 1) + F.when(near, CONTEXT_GAIN).otherwise(0.0), 2)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), rank + 1)
    said = lambda end: F.struct(x["start"].alias("start"), rank.alias("rank"), end.alias("end"), kind.alias("kind"), score.alias("score"))
    return _let(x["start"] + F.length(good), lambda end: F.when(end.isNotNull(), said(end)))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans``, sorted structs (start, rank, end, kind, score)."""
    text, kinds = F.col("text"), BASE | ADDED
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", *(text.rlike(hint).alias(f"has_{kind}") for kind, hint in HINTS.items()))
    some = reduce(lambda a, b: a | b, (F.col(f"has_{kind}") for kind in KINDS))
    found = lambda k: F.when(F.col(f"has_{k}"), F.struct(F.lit(KINDS.index(k)).alias("rank"), _proposals(text, kinds[k][0]).alias("pairs")))
    rows = rows.select(
        "id", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))).alias("stretches"),
        F.when(some, F.flatten(F.transform(F.filter(F.array(*map(found, KINDS)), lambda f: f.isNotNull()), _placed))).alias("placed"),
    )
    spans = F.filter(F.transform("placed", lambda x: _span(x, F.col("stretches"))), lambda s: s.isNotNull() & ((s["rank"] < len(BASE)) | (s["score"] >= LEAST_SCORE)))
    none = F.expr("array()").cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    return rows.select(F.col("id").alias(id_col), F.coalesce(F.array_sort(spans), none).alias("spans"))


def pii_digest(spans: Column) -> list[Column]:
    """Counts per base kind, the base spans' digest, all spans and the surest one's score."""
    base = F.filter(spans, lambda s: s["rank"] < len(BASE))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return [
        *counts, F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score")
    ]
