"""Chat formatting by incremental black-box rendering.

A template is any function from messages to text. Successive prefixes of a
conversation are rendered and consecutive outputs compared: what an output adds
to the one before is the new turn's span, and an output that does not start
with the one before shows a template that rewrites history. Nothing about the
template's inner form is assumed. A turn that rewrites adds what follows the
part that both outputs begin with; the later span then starts inside earlier
ones, and whoever replays the pieces in order, each from its start, has the
template's output for the whole conversation.

Every prefix is rendered whole: time grows with the square of a conversation and
memory with its length. Only a template that is declared ``turn_local``, as the
default one is, is rendered over a stretch that moves every ``window`` turns: what
such a template adds for a turn depends on that turn alone. Each move is checked
on one turn; where it adds other text, the stretch keeps growing.

Reading back uses the output alone: a reader finds the turns' spans in it, the
loss mask is the spans of the trained role, and all digests are taken through
spans. Rows are sorted by conversation and streamed, a turn at a time, so memory
does not grow with a conversation under a turn-local template, whatever the
length of its texts but one; under others the output is held until it is whole.

Defined results: a null text or role counts as empty; a null conversation id is
a conversation of its own; turns with equal (or null) numbers go by role and
text, nulls first; repeated rows are repeated turns; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from tilewright.plans import map_arrow

Message = tuple[str, str]
WINDOW = 256


def escape(text: str) -> str:
    """Puts a backslash before the template's control characters."""
    return re.sub(r"[\\<>]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def turn_local(render: Callable[[list[Message]], str]) -> Callable[[list[Message]], str]:
    """Declares that what a template adds for a turn depends on that turn alone, wherever it stands."""
    render.turn_local = True
    return render


@turn_local
def tagged(messages: list[Message]) -> str:
    """The default template: ``<turn:role>text</turn>`` and a line end, per turn."""
    return "".join(f"<turn:{escape(role)}>{escape(text)}</turn>\n" for role, text in messages)


_TURN = re.compile(r"(?s)<turn:((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n")


def read_tagged(out: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of each turn's text in output of the default template."""
    found, at = [], 0
    while at < len(out):
        m = _TURN.match(out, at)
        if not m:
            raise ValueError(f"not a turn: {out[at : at + 80]!r}")
        found.append((unescape(m[1]), m.start(2), m.end(2)))
        at = m.end()
    return found


def common_prefix(a: str, b: str) -> int:
    """Number of leading characters that two strings share."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Renderer:
    """Feeds turns one by one to a black-box template; ``window`` counts for turn-local ones only."""

    def __init__(self, render: Callable[[list[Message]], str], window: int = WINDOW):
        self.render, self.local = render, getattr(render, "turn_local", False)
        self.window = window if self.local else None
        self.held: list[Message] = []
        self.last, self.before = "", 0
        self.short: tuple[list[Message], str] | None = None

    def add(self, message: Message) -> tuple[int, str, bool]:
        """Where the turn's text starts in the output, the text, and whether earlier output was rewritten."""
        self.held.append(message)
        out = self.render(self.held)
        rewrote = not out.startswith(self.last)
        kept = common_prefix(out, self.last) if rewrote else len(self.last)
        start, piece = self.before + kept, out[kept:]
        if self.short:
            held, before = self.short[0] + [message], self.short[1]
            after = self.render(held)
            self.short = None
            if not rewrote and after.startswith(before) and after[len(before) :] == piece:
                self.before += len(out) - len(after)
                self.held, out = held, after
        elif self.window and len(self.held) % self.window == 0:
            self.short = ([message], self.render([message]))
        self.last = out
        return start, piece, rewrote


def _format(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, render: Callable[[list[Message]], str], window: int, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("conv", id_type), ("nth", pa.int64()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("rewrote", pa.bool_()), ("settled", pa.bool_())
        ]
    )
    conv, renderer, nth = None, None, 0
    for whole in batches:
        for k in range(0, whole.num_rows, rows):
            batch, cols = whole.slice(k, rows), tuple([] for _ in schema)
            for this, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                if renderer is None or this != conv:
                    conv, renderer, nth = this, Renderer(render, window), 0
                start, piece, rewrote = renderer.add((role or "", text or ""))
                for c, v in zip(cols, (conv, nth, role or "", piece, start, start + len(piece), rewrote, renderer.local), strict=True):
                    c.append(v)
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, render: Callable[[list[Message]], str] = tagged, window: int = WINDOW, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn, in order within its conversation's partition: conv, nth, role, piece, start, end, rewrote, settled.

    ``piece`` is what the turn adds to the formatted text, and start and end its
    span there, in code points. Where ``rewrote`` is false, the piece follows the
    one before; else it takes the place of all from its start on. ``settled``
    says that the template is declared turn-local, so that no later turn does that.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema[id_col].dataType
    rows = turns.select(turns[id_col].alias("conv"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return map_arrow(
        ordered, partial(_format, id_type=to_arrow_type(kind), render=render, window=window),
        f"conv {kind.simpleString()}, nth long, role string, piece string, start long, end long, rewrote boolean, settled boolean"
    )


Reader = Callable[[str], list[tuple[str, int, int]]]


@dataclass
class Turn:
    """A turn read from the output: role, text and the text's span in the whole output."""

    role: str
    text: str
    start: int
    end: int


def _turns(batches: Iterator[pa.RecordBatch], read: Reader, plain: Callable[[str], str]) -> Iterator[tuple[object, Turn | None, int, int]]:
    """(conv, turn, 0, 0) for each turn of the output, then (conv, None, formatted_chars, rewrites) for its conversation."""

    def said(out: str, at: int) -> Iterator[tuple[object, Turn, int, int]]:
        for role, start, end in read(out):
            yield conv, Turn(role, plain(out[start:end]), at + start, at + end), 0, 0

    conv, last, chars, rewrites, held = None, -1, 0, 0, []
    for batch in batches:
        for this, nth, piece, start, rewrote, settled in zip(*(batch.column(c).to_pylist() for c in ("conv", "nth", "piece", "start", "rewrote", "settled")), strict=True):
            if nth == 0 and last >= 0:
                yield from said("".join(held), 0)
                yield conv, None, chars, rewrites
            elif nth and (nth != last + 1 or this != conv):
                raise ValueError("turns of a conversation must come in order")
            if nth == 0:
                conv, rewrites, held = this, 0, []
            if settled:
                if rewrote:
                    raise ValueError("a template declared turn-local has rewritten earlier output")
                yield from said(piece, start)
            else:
                if rewrote:
                    held = ["".join(held)[:start]]
                held.append(piece)
            last, chars, rewrites = nth, start + len(piece), rewrites + rewrote
    if last >= 0:
        yield from said("".join(held), 0)
        yield conv, None, chars, rewrites


def _digest(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, read: Reader, plain: Callable[[str], str], trained: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("conv", id_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
            ("formatted_chars", pa.int64()), ("rewrites", pa.int64())
        ]
    )
    done: list[tuple] = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    n, chars, turns, loss = 0, 0, hashlib.sha256(), hashlib.sha256()
    for conv, turn, formatted, rewrites in _turns(batches, read, plain):
        if turn:
            n += 1
            turns.update(f"{turn.role}\n{turn.text}\n".encode())
            if turn.role == trained:
                chars += len(turn.text)
                loss.update(turn.text.encode())
            continue
        done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, rewrites))
        n, chars, turns, loss = 0, 0, hashlib.sha256(), hashlib.sha256()
        if len(done) >= 2000:
            yield out()
            done = []
    if done:
        yield out()


def _mask(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, read: Reader, plain: Callable[[str], str], trained: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", id_type), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
    rows = ((conv, t.start, t.end, t.text) for conv, t, _, _ in _turns(batches, read, plain) if t and t.role == trained)
    while some := list(islice(rows, 1000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _read(formatted: DataFrame, function: Callable, schema: str, ordered: bool, **more: object) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = formatted.select("conv", "nth", "piece", "start", "rewrote", "settled")
    if not ordered:
        rows = rows.repartition("conv").sortWithinPartitions("conv", "nth")
    kind = formatted.schema["conv"].dataType
    return map_arrow(rows, partial(function, id_type=to_arrow_type(kind), **more), f"conv {kind.simpleString()}, {schema}")


def loss_mask(formatted: DataFrame, read: Reader = read_tagged, plain: Callable[[str], str] = unescape, trained: str = "assistant", ordered: bool = False) -> DataFrame:
    """(conv, start, end, text): the spans of the formatted text that count for the loss, and what they say."""
    return _read(formatted, _mask, "start long, end long, text string", ordered, read=read, plain=plain, trained=trained)


def read_back(formatted: DataFrame, read: Reader = read_tagged, plain: Callable[[str], str] = unescape, trained: str = "assistant", ordered: bool = False) -> DataFrame:
    """One row per conversation, read from the output alone: digests of all turns and of the text under the loss mask.

    ``ordered`` says that the rows come straight from ``format_conversations`` and
    need no sorting; rows out of order are an error then.
    """
    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    return _read(formatted, _digest, schema, ordered, read=read, plain=plain, trained=trained)
