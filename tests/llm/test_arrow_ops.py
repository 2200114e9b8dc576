"""Byte-level BPE, chat formatting, URL filters and exact dedup on hard cases."""

import hashlib
import re

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import bpe, catalog, chat, exact_dedup, urls
from tilewright.plans import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
REF = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
CODER = bpe._coder(RANKS, PATTERN)


def ids(b):
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab -=\n\t.", max_size=60), st.text("\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000\u180e\u200b x1é😀", max_size=40)))
def test_bpe_equals_tiktoken(text):
    text = text.encode("utf-8", "ignore").decode()
    got = CODER.encode(text)
    assert ids(got) == REF.encode_ordinary(text)
    assert CODER.decode(got) == text.encode()
    # The library's own offsets of each piece, moved to the piece's place.
    want, at = [], 0
    for piece in CODER.pieces(text):
        want += [[at + a, at + b] for a, b in CODER.model.encode(piece, add_special_tokens=False).offsets]
        at += len(piece)
    assert CODER.offsets(got, text.encode()).tolist() == want


def test_bpe_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = catalog.op7_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = REF.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_bpe_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "q"), (1, "", "q"), (None, "é😀 long " * 30_000, "q"), (2, "-" * 5000, "q"), (2, "-" * 5000, "q")],
        "doc_id long, text string, ids string"
    )
    got = bpe.round_trip(docs, RANKS, PATTERN).collect()
    assert sorted(len(r.ids) for r in got)[:2] == [0, 0] and len(got) == 5
    assert all(len(r.offsets) == 2 * len(r.ids) for r in got)
    apart = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in apart) == sorted((str(r.doc_id), r.ids, r.decoded) for r in got)
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).count() == 0 == bpe.round_trip(docs.limit(0), RANKS, PATTERN).count()
    split = CODER.offsets(CODER.encode("a𒀀"), "a𒀀".encode()).tolist()
    assert split[0] == [0, 1] and split[1:] == [[1, 2]] * (len(split) - 1) and len(split) > 2  # one character over several ids


def test_small_piece_table(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    coder = bpe.ByteBpe(RANKS, PATTERN)
    for text in ("a b c d e f g", "h i j a b", "a b c d e f g"):
        assert ids(coder.encode(text)) == REF.encode_ordinary(text)


# Chat


def bos(messages):
    return "<s>" + chat.tagged(messages)


def forgetful(messages):
    """Drops the system turn once there are more than three turns."""
    return chat.tagged([m for m in messages if m[0] != "system" or len(messages) <= 3])


def replay(steps):
    """The output that (start, piece, rewrote) steps leave."""
    out = ""
    for start, piece, rewrote in steps:
        assert rewrote or start == len(out)
        out = out[:start] + piece
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b\\", ""]), st.text("\\<>/turn:ab\n ", max_size=20)), max_size=12), st.integers(2, 5))
def test_chat_round_trip(messages, window):
    renderer = chat.Renderer(chat.tagged, window)
    steps = [renderer.add(m) for m in messages]
    out = replay(steps)
    assert out == chat.tagged(messages) and not any(r for _, _, r in steps)
    assert [(role, chat.unescape(out[a:b])) for role, a, b in chat.read_tagged(out)] == messages
    with_bos = chat.Renderer(bos, window)
    assert replay(with_bos.add(m) for m in messages) == (bos(messages) if messages else "")


def test_common_prefix():
    for a, b in [("", "x"), ("abc", "abd"), ("abc", "abc"), ("xyz", "abc"), ("ab", "abcd"), ("é" * 999 + "a", "é" * 999 + "b")]:
        n = chat.common_prefix(a, b)
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_chat_finds_rewriting():
    renderer = chat.Renderer(forgetful)
    turns = [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    steps = [renderer.add(m) for m in turns]
    assert [r for _, _, r in steps] == [False, False, False, True, False] and replay(steps) == forgetful(turns)


def late(messages):
    """Drops the system turn once there are more than 300 turns."""
    return chat.tagged([m for m in messages if m[0] != "system" or len(messages) <= 300])


def recent(messages):
    """Keeps the last 300 turns."""
    return chat.tagged(messages[-300:])


def named(messages):
    """Signs an assistant's turn with the system turn's text."""
    name = "".join(t for r, t in messages[:1] if r == "system")
    return chat.tagged([(r, t + name * (r == "assistant")) for r, t in messages])


def test_chat_long_prefixes_are_true():
    turns = [("system", "s")] + [("assistant" if i % 2 else "user", f"t{i}") for i in range(1, 620)]
    for render, rewrites in ((late, [300]), (recent, [*range(300, 620)]), (named, [])):
        renderer, last = chat.Renderer(render), ""
        got = [renderer.add(m) for m in turns]
        for i, (start, piece, rewrote) in enumerate(got):
            out = render(turns[: i + 1])
            assert rewrote == (not out.startswith(last)) and last[:start] + piece == out
            last = out
        assert [i for i, (_, _, rewrote) in enumerate(got) if rewrote] == rewrites


def test_chat_turn_local_moves():
    renderer = chat.Renderer(chat.tagged)
    for i in range(2000):
        renderer.add(("user", str(i)))
    assert len(renderer.held) <= chat.WINDOW + 1
    assert renderer.add(("user", "x"))[0] == len(chat.tagged([("user", str(i)) for i in range(2000)]))


def reset(messages):
    """Leaves the system turn out once the last turn says RESET."""
    return chat.tagged(messages[1:] if messages[-1][1] == "RESET" else messages)


def test_chat_rewriting_is_read_back(spark):
    rows, talks = [], {}
    for conv, n in ((1, 10), (2, 2000)):
        talks[conv] = [("system", "be <brief>")] + [("assistant" if i % 2 else "user", f"\\t{i}>") for i in range(1, n - 1)] + [("user", "RESET")]
        rows += [(conv, i, *m) for i, m in enumerate(talks[conv])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns, reset).cache()
    steps = {c: replay((r.start, r.piece, r.rewrote) for r in sorted(out.collect(), key=lambda r: r.nth) if r.conv == c) for c in talks}
    masks = chat.loss_mask(out.orderBy("piece")).collect()
    for r in chat.read_back(out.orderBy("piece")).collect():  # whatever the order of the rows
        want = talks[r.conv][1:]
        loss = "".join(t for role, t in want if role == "assistant")
        assert steps[r.conv] == chat.tagged(want) and r.formatted_chars == len(steps[r.conv])
        assert (r.rewrites, r.n_turns, r.loss_chars) == (1, len(want), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in want).encode()).hexdigest()
        spans = [m for m in masks if m.conv == r.conv]
        assert [chat.unescape(steps[r.conv][m.start : m.end]) for m in spans] == [m.text for m in spans] and "".join(m.text for m in spans) == loss


def test_chat_mask_of_the_default_template(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", "<" * i + "é😀") for i in range(600)] + [(2, 0, "user", "only")] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat.tagged([(r, t) for _, _, r, t in rows[:600]])
    spans = chat.loss_mask(chat.format_conversations(turns), ordered=True).collect()
    assert [(m.conv, m.text) for m in spans] == [(1, rows[i][3]) for i in range(1, 600, 2)]
    assert all(chat.unescape(whole[m.start : m.end]) == m.text for m in spans)


def test_chat_cases(spark):
    rows = [
        (1, 1, "assistant", None), (1, 0, "user", "q"), (None, 0, None, "x"), (2, None, "assistant", "y"), (2, None, "assistant", "y"),
        *((3, i, "user" if i % 2 == 0 else "assistant", f"t{i}<") for i in range(700))
    ]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    out = chat.format_conversations(turns)
    got = {r.conv: r for r in chat.read_back(out).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, None: 1, 2: 2, 3: 700}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\n\n").hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256("".join(f"t{i}<" for i in range(1, 700, 2)).encode()).hexdigest()
    assert all(r.end - r.start == len(r.piece) and not r.rewrote for r in out.collect())
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


# URLs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*.", min_size=1, max_size=9).filter(lambda g: "***" not in g), min_size=1, max_size=30), st.lists(st.text("ab/.", max_size=12), min_size=1, max_size=12))
def test_globs_equal_regex(globs, texts):
    found = urls.GlobAutomaton(globs).match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            want = "".join(".*" if x == "**" else "[^/]*" if x == "*" else re.escape(x) for x in re.findall(r"\*\*|\*|.", g))
            assert found[i, k] == bool(re.fullmatch(want, t, re.S)), (g, t)


def test_url_cases(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "x://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "x://example.org/es": ("example.org", "/es", "org/", "allow"), "x://example.org": ("example.org", "", None, "allow"), "x://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "x://a.com/x.example.org/es/": ("a.com", "/x.example.org/es/", None, "allow"), "x://h?://b/c": ("h", "", None, "allow"), "x://ads-track.example.net/de/": ("ads-track.example.net", "/de/", None, "block"),
        "x://m.free-bets.com/de/" + "a" * 60_000: ("m.free-bets.com", "/de/" + "a" * 60_000, "com/de/", "block"), "x://com/fr/": ("com", "/fr/", "com/fr/", "allow"), "x://É.org/\n": ("É.org", "/\n", "org/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(None, None, "h")] * 2, "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got == dict(enumerate(cases.values())) | {None: ("", "", None, "allow")} and urls.judge_urls(pages).count() == len(cases) + 2
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_many_url_rules(spark):
    rules = [("block" if i % 3 else "allow", f"h{i}.net", f"/{'ab'[i % 2]}") for i in range(900)] + [("allow", "h1.net", "/b"), ("block", "h1.net", "/b"), ("block", "net", "/zz")]
    urls_ = [f"x://s.h{i}.net/{'ab'[i % 2]}c" for i in range(0, 900, 7)] + ["x://h1.net/b", "x://q.net/zz", "x://q.net/z", None] * 2
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls_)], "page_id long, url string")
    for r in urls.judge_urls(pages, rules=rules, host_blocks=["q.*"]).collect():
        host, path = urls.canonical(urls_[r.page_id])
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert (r.rule, r.verdict) == ((best[2], best[3]) if best else (None, "block" if host.startswith("q.") else "allow"))


# Exact dedup


@pytest.mark.parametrize("hot", [500, 0, 1])
def test_dedup_cases(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)  # from every block salted to none
    long = "x" * 50
    texts = ["a  b", "a\tb", "a b ", None, "", "a b", long, long + "y", long + "y", "x" * 49, " ", "\n\n", "ab", "abcabcab", "abcabca", "z" * 1000, "z" * 1000, "z" * 1001]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 1), (None, "null id", 1), (0, "a  b", 1), (0, "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id long").repartition(5)
    got = exact_dedup.exact_dedup(docs, block_bytes=3).collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(d)
    want = sorted((str(d), str(min((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_folding_is_bounded_by_members():
    docs = pa.RecordBatch.from_pydict({"id": pa.array(range(300_000), pa.int64()), "text": pa.array([None] * 300_000, pa.string())})
    units = list(exact_dedup._units(iter([docs] * 4), pa.int64(), 16))
    assert len(units) > 1 and sum(len(m) for u in units for m in u.column("members").to_pylist()) == 1_200_000
    assert max(len(m) for u in units for m in u.column("members").to_pylist()) <= exact_dedup.FOLD_BYTES // exact_dedup.MEMBER_BYTES + 1
