"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. The renderer calls it on successive prefixes of a
conversation and compares consecutive outputs: where the longer output begins with the shorter one, what
it adds is the new turn's span; where it doesn't, the template rewrites history, which is reported with
the first such turn. Trailing text that every output has (say, an end marker) is found by rendering no
turn, and is left out of the comparison.

Any template is taken as a black box, and all are treated alike. Up to FULL turns every prefix is rendered whole. Beyond, rendering every prefix would take time that grows with
the square of a conversation's turns: there the last turns are rendered as a conversation of their own, each prefix of them compared with the one before, and the whole conversation
is rendered again when its turns have doubled and at its end. Where the last turn's span isn't the same among fewer turns, all prefixes are rendered whole. Each whole output must be the spans found so far, one after another, else RewritesHistory is raised; so the formatted text is always
what the template gives for the whole conversation. Only a template that changes earlier output and takes it back before the turns have doubled isn't found out there.
`full=None` renders every prefix whole, however long. A conversation's turns are held until its end, as a black box takes them all; digests are updated
turn by turn. One conversation's digest is sequential by definition, so its turns meet in one task, as a stream, sorted by Spark with spilling.

Cases: null text and null role are empty; rows of one conversation and turn are ordered by role, then
text; a null conv_id is a conversation of its own; repeated rows are repeated turns; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
#: Turns up to which every prefix is rendered whole; beyond, the last half as many to as many are rendered with each new one.
FULL = 64
#: Control strings of the template.
OPEN, MID, CLOSE, TARGET = "<s>", "[INST]", "</s>", "[/INST]"
_CODE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    """No control string begins in the result: all of them begin with < or [."""
    return re.sub(r"[\\<\[]", lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text, flags=re.S)


def inst_template(turns: Turns) -> str:
    """<s>[INST]role[/INST]text</s> for each turn; the text of an assistant is what is learned."""
    return "".join(f"{OPEN}{MID}{escape(r)}{TARGET}{escape(t)}{CLOSE}" for r, t in turns)


_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def parse(formatted: str) -> Turns:
    """Read turns back from the template's output."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text between turns at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text after the last turn at {at}")
    return out


#: Texts that are put in a turn's place to find where it stands; the last is longer.
PROBES = ("a", "b", "probe")


class RewritesHistory(ValueError):
    """The template's output for more turns doesn't begin with its output for fewer."""


class Incremental:
    """Spans of a conversation's turns, one by one, from a black-box template."""

    def __init__(self, template: Callable[[Turns], str], full: int | None = FULL):
        self.template, self.full = template, full
        self.tail = template([])
        # all turns; those that are rendered, and their output; the last span; digest and length of all spans; turns at the last whole rendering
        self.all: Turns = []
        self.turns: Turns = []
        self.text, self.last = "", ""
        self.digest, self.size, self.whole = hashlib.sha256(), 0, 0

    def place_of_text(self) -> tuple[int, int] | None:
        """Where the last turn's text stands in its span, or None where the template doesn't show it."""
        before, (role, _) = self.turns[:-1], self.turns[-1]
        start = len(self.text) - len(self.last)
        a, b, c = (self._body([*before, (role, probe)])[start:] for probe in PROBES)
        if a == b == c:
            return None
        head = len(os.path.commonprefix([a, b]))
        tail = len(os.path.commonprefix([a[:head - len(a) - 1:-1], b[:head - len(b) - 1:-1]]))
        # a longer text makes the span longer by as much, and fills the place: else it is shown more than once, or changed
        if c != a[:head] + PROBES[2] + a[len(a) - tail :] or a[head : len(a) - tail] != PROBES[0]:
            raise ValueError(f"turn {len(self.all) - 1}: its text isn't shown once, as it is")
        lo, hi = head, len(self.last) - tail
        if lo > hi or self.last[:lo] != a[:lo] or self.last[hi:] != a[len(a) - tail :]:
            raise ValueError(f"turn {len(self.all) - 1}: what surrounds its text depends on it")
        return lo, hi

    def _body(self, turns: Turns) -> str:
        out = self.template(turns)
        if self.tail and not out.endswith(self.tail):
            raise RewritesHistory(f"turn {len(self.all)}: the end marker changed")
        return out[: len(out) - len(self.tail)]

    def add(self, role: str, text: str) -> str:
        if self.full and len(self.turns) >= self.full:
            if len(self.turns) == len(self.all):
                self.whole = len(self.all)
            few = self.turns[-(self.full // 2 or 1) :]
            shorter = self._body(few)
            if shorter.endswith(self.last):
                self.turns, self.text = few, shorter
            else:  # spans depend on how many turns stand before: no short cut for this template
                self.full, self.turns = None, list(self.all)
                self.text = self._body(self.turns)
        self.all.append((role, text))
        self.turns.append((role, text))
        longer = self._body(self.turns)
        if not longer.startswith(self.text):
            raise RewritesHistory(f"turn {len(self.all) - 1}: the output for the turns before it changed")
        self.last, self.text = longer[len(self.text) :], longer
        self.digest.update(self.last.encode("utf-8", "surrogatepass"))
        self.size += len(self.last)
        if len(self.turns) < len(self.all) and len(self.all) >= 2 * self.whole:
            self.check()
        return self.last

    def check(self) -> None:
        """Render the whole conversation and compare it with the spans, where not all of it was rendered with the last turn."""
        if len(self.turns) < len(self.all) and self.whole < len(self.all):
            whole = self._body(self.all)
            if len(whole) != self.size or hashlib.sha256(whole.encode("utf-8", "surrogatepass")).digest() != self.digest.digest():
                raise RewritesHistory(f"turn {len(self.all) - 1}: the output for all turns isn't their spans")
        self.whole = len(self.all)


def rewrites_history(template: Callable[[Turns], str], turns: Turns, full: int | None = FULL) -> int | None:
    """The first turn at which the template is found to change earlier output, or None."""
    inc = Incremental(template, full)
    for i, (r, t) in enumerate(turns):
        try:
            inc.add(r, t)
        except RewritesHistory:
            return i
    try:
        inc.check()
    except RewritesHistory:
        return len(turns) - 1
    return None


def turn_spans(
    df: DataFrame, template: Callable[[Turns], str] = inst_template, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", full: int | None = FULL, learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """conv_id, pos (0, 1, ...), start, span (the formatted text of the turn), loss_start, loss_end (within the span, or null).

    Spans of a conversation, joined in order of pos, are its formatted text.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    return _sorted(df, conv_col, turn_col, role_col, text_col).mapInArrow(_spans(template, full, learned), f"conv_id {kind}, pos long, start long, span string, loss_start long, loss_end long")


def _sorted(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(i).to_pylist() for i in range(3)))


def _spans(template: Callable[[Turns], str], full: int | None, learned: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        out: list[tuple] = []
        names = ["conv_id", "pos", "start", "span", "loss_start", "loss_end"]
        conv_type, size = None, 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def typed(stream):
            nonlocal conv_type
            for b in stream:
                conv_type = b.schema.field(0).type
                yield b

        for conv, role, text in _rows(typed(batches)):
            if now is run or conv != now:
                if now is not run:
                    inc.check()
                now, inc, pos, start = conv, Incremental(template, full), 0, 0
            span = inc.add(role, text)
            lo, hi = (inc.place_of_text() if role in learned else None) or (None, None)
            out.append((conv, pos, start, span, lo, hi))
            pos, start, size = pos + 1, start + len(span), size + len(span)
            if len(out) >= 1024 or size > 4 << 20:
                yield flush()
                out.clear()
                size = 0
        if now is not run:
            inc.check()
        if out:
            yield flush()

    return run


def format_digests(
    df: DataFrame, template: Callable[[Turns], str] = inst_template, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", full: int | None = FULL, learned: tuple[str, ...] = ("assistant",),
    read: Callable[[str], Turns] = parse, plain: Callable[[str], str] = unescape,
) -> DataFrame:
    """Per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    read: the turns of a formatted span; plain: a learned text from its formatted form.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    spans = _spans(template, full, learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run
        conv_type, done = None, []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) or [[] for _ in names]
            types = [conv_type or pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def close() -> None:
            done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in spans(batches):
            conv_type = batch.schema.field(0).type
            for conv, span, lo, hi in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if now is run or conv != now:
                    if now is not run:
                        close()
                    now, n, chars, loss_chars = conv, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in read(span):
                    turns.update(f"{role}\n{text}\n".encode("utf-8"))
                    n += 1
                if lo is not None:
                    own = plain(span[lo:hi])
                    loss.update(own.encode("utf-8"))
                    loss_chars += len(own)
                chars += len(span)
            if len(done) >= 4096:
                yield flush()
                done.clear()
        if now is not run:
            close()
        if done:
            yield flush()

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _sorted(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)
