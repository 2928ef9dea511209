"""Repair of damaged conversations by a rank-compressed dynamic programme.

Turns are kept, given another role, or deleted, and empty turns are inserted, at least cost, so that the initials of the roles read `(s?(ua)+)?`.
An edit list is written as its initials: D, I, K, R; the roles that R and I give follow from what stands before. Of lists of least cost the ASCII-least is taken.

The programme. Layers are turns; states say what has been emitted: nothing, a system turn, or a turn of the user or the assistant last. A step is a macro edit: a run of
0, 1 or 2 insertions, then the turn's own edit (longer runs come back to a state that a shorter one reaches). Macros, as strings, are prefix-free: no one begins another. So
of two lists over the same turns the first macro in which they differ decides, and lists needn't be held: a state's list is its rank among those of its
layer, and a step's candidates are compared by (cost, rank of the state before, order of the macro). Two states never have one list, as the list determines the state.
A layer is costs above the cheapest and ranks: there are few such layers, so a step is looked up by (layer, kind of turn), and found out once. Behind each turn one byte names its step; parent
pointers are followed back from the end, and the list is written out.

Memory. Turns stream through in order. A conversation holds its steps, one byte a turn, and for each state a running SHA-256 of what its list makes of the turns, which a step copies
from its parent; texts aren't held. Turns that were seen earlier are found by Spark, in a window by conversation, role and text: the partitioning is the same, so
rows are shuffled once. A conversation's digest is sequential by definition, so its turns meet in one task, as a sorted, spilling stream.

Faults, of which a turn has the first: blank (no character but 0x20 and 0x09-0x0D), duplicate (role and text stood earlier), truncated (the last such character isn't `.`, `!` or `?`). Blank
and duplicate turns must go.

Cases: turns are ordered by turn, nulls first, then role and text; a null role or text is one space (in `damaged` also a null id or turn, within the hashed string). A null
conv_id is a conversation of its own. Repeated rows are turns like others, so the later ones are duplicates. Very long texts pass through one at a time; a very long conversation takes a byte a turn, and its list is
one string. Ties go to the ASCII-least list. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States: nothing emitted, a system turn, a user's turn, an assistant's turn. Only the first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (START, ASSISTANT)
#: What may follow: initial -> state.
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_FULL = {"u": b"user:", "a": b"assistant:"}
#: Most insertions of a run.
_RUN = 2


def _forced(state: int) -> str:
    """The only initial of a user or an assistant that may follow."""
    return "a" if state == USER else "u"


def _runs(state: int) -> Iterator[tuple[str, int, str]]:
    """Runs of insertions: (list, state after, inserted initials)."""
    code, put = "", ""
    for _ in range(_RUN + 1):
        yield code, state, put
        initial = _forced(state)
        code, put, state = code + "I", put + initial, _NEXT[state][initial]


def _macros(state: int, initial: str, must_go: bool, cut: bool) -> Iterator[tuple[int, str, int, str, str | None]]:
    """Steps from a state over a turn: (cost, list, state after, inserted initials, what the turn becomes: its own role '=', another's initial, or None if deleted)."""
    for code, at, put in _runs(state):
        cost = INSERT * len(code)
        yield cost + DELETE, code + "D", at, put, None
        if must_go:
            continue
        if initial in _NEXT[at]:
            yield cost + KEEP + TRUNCATED * cut, code + "K", _NEXT[at][initial], put, "="
        other = _forced(at)
        if initial != other:
            yield cost + REROLE + TRUNCATED * cut, code + "R", _NEXT[at][other], put, other


#: A layer: for each state (cost above the layer's cheapest, rank of its list), or None where no list leads there.
Layer = tuple
FIRST: Layer = ((0, 0), None, None, None)


class Step:
    """From one layer to the next over one kind of turn. back: for each state its parent and macro (list, inserted initials, what the turn becomes)."""

    __slots__ = ("layer", "cost", "back", "code")

    def __init__(self, before: Layer, kind: tuple, code: int):
        best: dict[int, tuple] = {}
        for state, at in enumerate(before):
            if at is not None:
                for cost, edits, to, put, becomes in _macros(state, *kind):
                    found = (at[0] + cost, at[1], edits, state, put, becomes)
                    if to not in best or found[:3] < best[to][:3]:
                        best[to] = found
        self.cost = min(f[0] for f in best.values())
        # lists by the rank of the list before, then the macro
        order = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        self.layer = tuple((best[to][0] - self.cost, order[to]) if to in best else None for to in range(4))
        self.back = tuple((best[to][3], best[to][2], best[to][4], best[to][5]) if to in best else None for to in range(4))
        self.code = code


class Steps:
    """All steps that have come up, by layer and kind of turn. Both are few: costs above the cheapest are bounded, and ranks are of four states."""

    def __init__(self):
        self.known: dict[tuple, Step] = {}
        self.all: list[Step] = []

    def step(self, before: Layer, kind: tuple) -> Step:
        found = self.known.get((before, kind))
        if found is None:
            found = self.known[before, kind] = Step(before, kind, len(self.all))
            self.all.append(found)
        return found


def _end(layer: Layer) -> tuple[int, str, int, str]:
    """The best last run: (cost above the layer's cheapest, its list, state before it, inserted initials)."""
    found = []
    for state, at in enumerate(layer):
        if at is not None:
            for code, to, put in _runs(state):
                if to in _ENDS:
                    found.append((at[0] + INSERT * len(code), at[1], code, state, put))
    cost, _, code, state, put = min(found)
    return cost, code, state, put


class Repair:
    """One conversation, turn by turn."""

    def __init__(self, steps: Steps):
        self.steps, self.layer, self.cost = steps, FIRST, 0
        self.trail = bytearray()
        self.wide = 1
        # of each state's list: a digest of the repaired turns so far, and whether there are any
        self.made: list = [(hashlib.sha256(), False), None, None, None]

    def add(self, role: str, text: str, must_go: bool, cut: bool) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        step = self.steps.step(self.layer, (initial, must_go, cut))
        if step.code >= 1 << 8 * self.wide:  # codes of this width are used up
            old, self.wide = self.wide, self.wide + 1
            self.trail = bytearray(b"".join(self.trail[i : i + old] + b"\0" for i in range(0, len(self.trail), old)))
        self.trail += step.code.to_bytes(self.wide, "little")
        shown: dict[str, bytes] = {}
        made = []
        for back in step.back:
            if back is None:
                made.append(None)
                continue
            state, _, put, becomes = back
            digest, some = self.made[state]
            if put or becomes:
                digest = digest.copy()
                for i in put:
                    digest.update((b"\n" if some else b"") + _FULL[i])
                    some = True
                if becomes:
                    if becomes not in shown:
                        shown[becomes] = (role.encode("utf-8") + b":" if becomes == "=" else _FULL[becomes]) + text.encode("utf-8")
                    digest.update(b"\n" if some else b"")
                    digest.update(shown[becomes])
                    some = True
            made.append((digest, some))
        self.layer, self.made, self.cost = step.layer, made, self.cost + step.cost

    def close(self) -> tuple[int, str, str]:
        """Cost, edit list, digest of the repaired turns."""
        cost, code, state, put = _end(self.layer)
        digest, some = self.made[state]
        digest = digest.copy()
        for i in put:
            digest.update((b"\n" if some else b"") + _FULL[i])
            some = True
        edits = [code]
        for at in range(len(self.trail) - self.wide, -1, -self.wide):
            state, own, _, _ = self.steps.all[int.from_bytes(self.trail[at : at + self.wide], "little")].back[state]
            edits.append(own)
        return self.cost + cost, "".join(reversed(edits)), digest.hexdigest()


_SPACE = "\\x20\\x09-\\x0D"


def faults(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, fault (0: none, 1: blank, 2: duplicate, 3: truncated), in the order of turns within each conversation."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    last = F.regexp_extract("text", f"(?s)([^{_SPACE}])[{_SPACE}]*\\z", 1)
    fault = F.when(last == "", 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault")).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


_LEGAL = {"su", "ua", "au"}
_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
    kind = df.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, now, own = Steps(), run, None
        done, size, conv_type = [], 0, None

        def flush() -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], _OUT)

        def close() -> None:
            nonlocal size
            cost, audit, digest = own.close()
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((now, gaps, counts[1], counts[2], counts[3], illegal, cost, audit, digest))
            size += len(audit)

        for batch in batches:
            conv_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 512):
                for conv, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if now is run or conv != now:
                        if now is not run:
                            close()
                        now, own, counts, illegal, before, turns = conv, Repair(steps), [0] * 4, 0, None, None
                    counts[fault] += 1
                    illegal += before is not None and before + role[:1] not in _LEGAL
                    before = role[:1]
                    if turn is not None:
                        # smallest, largest, distinct: turns come in order
                        turns = (turns[0], turn, turns[2] + (turn != turns[1])) if turns else (turn, turn, 1)
                    own.add(role, text, fault in (1, 2), fault == 3)
            if len(done) >= 1024 or size > 1 << 20:
                yield flush()
                done, size = [], 0
        if now is not run:
            close()
        if done:
            yield flush()

    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return faults(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with known damage, by crc32(`conv_id:turn`) modulo 20: 0 drops a turn, 1 empties it, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"),
        (F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20).alias("way"),
    ).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("way") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """`repair` of the damaged rows, with a row for every conversation of the table: one without rows after damage has zeros, an empty audit, and the empty string's hash."""
    ids = df.select(F.col(conv_col).alias("id")).distinct()
    found = repair(damaged(df, conv_col, turn_col, role_col, text_col))
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _OUT[1:7]]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
