"""URL filters as one bit-parallel wildcard automaton.

Glob rules are packed into words of 64 bits, a bit per state. Reading a byte
moves all rules at once: ``D' = ((D << 1) & B[c]) | (D & S[c])`` with carries
between words, where B admits a literal and S lets a wildcard state stay. A
batch of URLs steps together, longest first, so a step costs a few array
operations whatever the number of rules.

``*`` stands for any bytes but ``/`` and ``**`` for any bytes; a glob covers the
whole canonical URL, host (A-Z lower-cased) and then path. Of the base rules
that fit, the longest decides, of equally long ones a block before an allow, and
else the first by verdict, host and path; where none fits, the method's own globs
decide. So many URLs step together that states take a bounded memory, whatever
the number of rules; one very long URL steps on alone.

Defined results: a null URL or one without ``://`` has an empty host and path
and is allowed; null ids and repeated rows are kept; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.plans import map_arrow

#: Fixed values: (verdict, host, path) of the base rules.
BASE_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The method's own globs over hosts, for URLs that no base rule fits: advertising, spam and trackers.
HOST_BLOCKS = ["*cheap-pills*", "*free-bets*", "*spam-farm*", "ads-*", "ads.*", "*.ads-*", "*.ads.*", "*-casino.*", "*.doubleclick.net"]
STATE_BYTES = 32_000_000
_PARTS = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)")


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; both empty without a scheme."""
    m = _PARTS.match(url or "")
    return (m[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), m[2]) if m else ("", "")


class GlobAutomaton:
    """All globs at once over byte strings."""

    def __init__(self, globs: list[str]):
        tokens = [re.findall(rb"\*\*|\*|[\x00-\xff]", g.encode(), re.S) for g in globs]
        states = sum(1 + sum(t[:1] != b"*" for t in ts) for ts in tokens)
        self.words = max(1, -(-states // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.ends: list[tuple[int, np.uint64]] = []
        at = 0
        for ts in tokens:
            self._set(self.start, at)
            for t in ts:
                if t in (b"*", b"**"):
                    for c in range(256):
                        if t == b"**" or c != 0x2F:
                            self._set(self.stay[c], at)
                else:
                    at += 1
                    self._set(self.step[t[0]], at)
            self.ends.append((at // 64, np.uint64(1 << at % 64)))
            at += 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix, texts by globs."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else lengths
        state = np.tile(self.start, (len(texts), 1))
        live = len(texts)
        for pos in range(int(lengths[0]) if len(texts) else 0):
            while live and lengths[live - 1] <= pos:
                live -= 1
            c = flat[starts[:live] + pos]
            d = state[:live]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[c]) | (d & self.stay[c])
        found = np.empty((len(texts), len(self.ends)), bool)
        for k, (word, bit) in enumerate(self.ends):
            found[order, k] = (state[:, word] & bit) != 0
        return found


def _globs(rules: list[tuple[str, str, str]], host_blocks: list[str]) -> tuple[list[str], list[int]]:
    """Globs and the rule that each stands for; rules count from 0, the method's from len(rules)."""
    globs, of = [], []
    for k, (_, host, path) in enumerate(rules):
        globs += [f"{host}{path}**", f"*.{host}{path}**"]
        of += [k, k]
    for k, host in enumerate(host_blocks, len(rules)):
        globs += [host, f"{host}/**"]
        of += [k, k]
    return globs, of


def _judge(batches: Iterator[pa.RecordBatch], rules: list[tuple[str, str, str]], host_blocks: list[str]) -> Iterator[pa.RecordBatch]:
    # Longest first; a block goes before an allow of the same length.
    rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r))
    globs, of = _globs(rules, host_blocks)
    automaton = GlobAutomaton(globs)
    step = max(16, min(4096, STATE_BYTES // (8 * automaton.words), STATE_BYTES // max(1, len(globs))))
    names, verdicts = np.array([None, *(h + p for _, h, p in rules)], object), np.array(["", *(v for v, _, _ in rules)], object)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            found = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
            fits = np.zeros((len(parts), len(rules) + len(host_blocks)), bool)
            for k, r in enumerate(of):
                fits[:, r] |= found[:, k]
            ruled, own = fits[:, : len(rules)], fits[:, len(rules) :]
            first = np.where(ruled.any(axis=1), ruled.argmax(axis=1) + 1, 0) if len(rules) else np.zeros(len(parts), int)
            globbed = [""] * len(parts)
            for i in np.flatnonzero(own.any(axis=1)):
                globbed[i] = ",".join(host_blocks[k] for k in np.flatnonzero(own[i]))
            verdict = np.where(first > 0, verdicts[first], np.where(own.any(axis=1), "block", "allow"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(names[first], pa.string()), pa.array(verdict, pa.string()), pa.array(globbed, pa.string())],
                names=["id", "host", "path", "rule", "verdict", "globs"],
            )


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = BASE_RULES, host_blocks: list[str] = HOST_BLOCKS) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict and the method's globs that fit."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = map_arrow(
        pages.select(id_col, url_col), partial(_judge, rules=rules, host_blocks=host_blocks),
        f"id {kind}, host string, path string, rule string, verdict string, globs string"
    )
    return rows.withColumnRenamed("id", id_col)
