"""Chat formatting: a hidden Markov model recovers who speaks in a transcript, then turns are rendered canonically.

Observations are lines, described by a speaker marker, whether a blank line precedes them, their length and how they end.
Hidden states are a role and whether the line begins or continues a turn. Counts of a bounded sample of labelled
conversations (about SAMPLE_ROWS rows, chosen by hash, outside the held-out fold) give the probabilities; Viterbi gives
the best states of a whole conversation.

Long conversations. A conversation is cut into fragments of FRAGMENT turn numbers, and one that holds more than CROWDED rows
is cut further, by turn and by the hash that orders the rows of a turn, so that a task holds a bounded number of rows whatever
the numbers are. Each fragment is reduced to a matrix in
(max, +) algebra, the best score from each state before it to each state at its end; the matrices of a conversation
are scanned forwards and the best states traced backwards, which yields every fragment's first and last state; then the
fragments are decoded. The path is the one Viterbi would find over the uncut conversation, and a task holds one fragment.

Rendering. Each row of the transcript becomes a piece; the pieces of a conversation, joined in order, are its canonical
form: <|role|>, a line end, the text, a line end, <|end|> and a line end for every turn. The text is verbatim, indentation and
blank lines inside included, but for the marker that opens the turn (with the line end behind it, if it stands alone) and
blank lines at the turn's edges.

Defined results. Rows repeated exactly are one row (`copies` says how many). Rows with equal turn follow in the order of a hash
of their text. A row whose conversation or turn is null is a conversation by itself. Null and blank texts keep their row, have
no role and render as nothing but what closes the conversation. Without labelled rows all states are equally likely.
Texts of any length are read whole; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.work import small_batches, stage

ROLES = ("system", "user", "assistant")
FRAGMENT = 64
CROWDED = 256
CUTS = 1 << 40
SAMPLE_ROWS = 6_000
STATES = 2 * len(ROLES)  # role * 2, + 1 for a continued turn
START = STATES
END_MARK = "<|end|>\n"

# What transcripts call the speakers.
SPEAKERS = {
    "system": "system|context|setup|system prompt",
    "user": "user|human|question|q|customer|prompt|instruction|me|client|you",
    "assistant": "assistant|ai|bot|answer|a|model|response|agent|chatbot|reply",
}
_MARKER = re.compile(
    r"\s*(?:[#>*\[(<|]+\s*)?(?:" + "|".join(f"(?P<{r}>{w})" for r, w in SPEAKERS.items()) + r")\s*(?:[*\])|>]+\s*:?|:\s*\**|\s*[-–]\s+)\s*", re.I
)
#: Number of values of each line feature: marker, after a blank line, length, ending.
SIZES = (len(ROLES) + 1, 2, 5, 3)


class Line(NamedTuple):
    begin: int  # of the line in its text
    body: int  # of what follows the marker; of the line where there is none
    values: tuple[int, int, int, int]


def lines_of(text: str | None) -> list[Line]:
    """The non-blank lines of a transcript row. Rows are paragraphs: each begins after a blank line."""
    out, blank, begin = [], True, 0
    for raw in (text or "").split("\n"):
        end = begin + len(raw)
        if not raw.strip():
            blank, begin = True, end + 1
            continue
        m = _MARKER.match(raw)
        mark = next((1 + k for k, r in enumerate(ROLES) if m and m[r]), 0)
        body = (raw[m.end() :] if m else raw).strip()
        n = len(body)
        length = 0 if n < 40 else 1 if n < 120 else 2 if n < 300 else 3 if n < 800 else 4
        ends = 0 if body.endswith("?") else 1 if body.endswith((".", "!", ":")) else 2
        past = begin + m.end() if m else begin
        out.append(Line(begin, past if body or not m else end + 1, (mark, int(blank), length, ends)))
        blank, begin = False, end + 1
    return out


_EDGES = re.compile(r"\A(?:[^\S\n]*\n)+|\s+\Z")


def turns_of(text: str, lines: list[Line], states: list[int], opened: bool) -> list[tuple[int | None, str]]:
    """(role of a turn that begins here, or None for the turn before; its text) of a row whose lines have these states."""
    out, begin, role = [], 0, None
    for k, (line, s) in enumerate(zip(lines, states, strict=True)):
        if s % 2 == 0 or (k == 0 and not opened):
            if k:
                out.append((role, text[begin : line.begin]))
            role, begin = s // 2, line.body if s % 2 == 0 else line.begin
    if lines:
        out.append((role, text[begin:]))
    return [(r, _EDGES.sub("", t)) for r, t in out]


class Model(NamedTuple):
    step: np.ndarray  # (STATES + 1, STATES): log probability from a state, or from START
    see: list[np.ndarray]  # for each feature (STATES, values)

    def scores(self, lines: list[Line]) -> np.ndarray:
        v = np.array([x.values for x in lines]).reshape(-1, len(SIZES))
        return sum(table[:, v[:, k]].T for k, table in enumerate(self.see))

    def matrix(self, seen: np.ndarray) -> np.ndarray:
        """(STATES + 1, STATES): the best score from each state before the lines to each at their end."""
        now = None
        for row in seen:
            now = self.step + row if now is None else (now[:, :, None] + self.step[None, :STATES, :]).max(axis=1) + row
        return now

    def path(self, seen: np.ndarray, first: int, last: int) -> list[int]:
        """The best states of the lines between the state before them and the state at their end."""
        score, back = self.step[first] + seen[0], []
        for row in seen[1:]:
            every = score[:, None] + self.step[:STATES]
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + row
        out = [last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def fit(rows: list[tuple[int, int, str, str]]) -> Model:
    """Counts over labelled rows (conversation, turn, role, text), with one added everywhere."""
    step = np.ones((STATES + 1, STATES))
    see = [np.ones((STATES, n)) for n in SIZES]
    before, last = None, START
    for conv, _, role, text in sorted(rows):
        if conv != before:
            before, last = conv, START
        for k, line in enumerate(lines_of(text)):
            state = 2 * ROLES.index(role) + (k > 0)
            step[last, state] += 1
            last = state
            for f, v in enumerate(line.values):
                see[f][state, v] += 1
    for state in range(STATES):  # a continued turn keeps its role
        for to in range(1, STATES, 2):
            if to // 2 != state // 2:
                step[state, to] = 1e-9
    step[START, 1::2] = 1e-9
    return Model(np.log(step / step.sum(axis=1, keepdims=True)), [np.log(t / t.sum(axis=1, keepdims=True)) for t in see])


def sample(rows: DataFrame) -> list[tuple[int, int, str, str]]:
    """About SAMPLE_ROWS labelled rows of whole conversations. rows: conv_id, turn, role, text."""
    known = rows.filter(F.col("role").isin(*ROLES) & F.col("text").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    known = known.filter(~held_out(F.col("conv_id")))
    n = known.count()
    if n > SAMPLE_ROWS:
        known = known.filter(F.pmod(F.xxhash64(F.lit(3), "conv_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_ROWS / n))
    return [tuple(r) for r in known.select("conv_id", "turn", "role", "text").limit(2 * SAMPLE_ROWS).collect()]


def held_out(conv_id):
    return F.pmod(F.xxhash64(F.lit(11), conv_id), F.lit(4)) == 2


KEY = ["lone", "conv", "frag", "sub"]
_PLACE = "lone long, conv long, frag long, sub long"
ORDER = ["turn", "at", "text"]


def _groups(batches, key=KEY):
    """Tables of consecutive rows with equal key, across batches."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in key])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and last != tuple(keys[:, 0].tolist()):
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            held.append(b.slice(lo, hi - lo))
            if hi < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(keys[:, -1].tolist())
    if held:
        yield pa.Table.from_batches(held)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _flush(rows: list[tuple], schema: pa.Schema, most: int = 512):
    if len(rows) >= most:
        yield _batch(rows, schema)
        rows.clear()


def reduce_fragments(rows: DataFrame, model: Model) -> DataFrame:
    """(lone, conv, frag, sub, matrix) for every fragment that has a line."""
    schema = pa.schema([(k, pa.int64()) for k in KEY] + [("matrix", pa.list_(pa.float64()))])

    def run(batches):
        out = []
        for g in _groups(batches):
            lines = [x for t in g.column("text").to_pylist() for x in lines_of(t)]
            if lines:
                out.append((*(g.column(k)[0].as_py() for k in KEY), model.matrix(model.scores(lines)).ravel().tolist()))
            yield from _flush(out, schema)
        yield _batch(out, schema)

    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, *ORDER)
    return dealt.select(*KEY, "text").mapInArrow(run, f"{_PLACE}, matrix array<double>")


def stitch(matrices: DataFrame) -> DataFrame:
    """(lone, conv, frag, sub, first, last): the best states before and at the end of every fragment.

    The matrices of one conversation pass through one task in order, held one at a time: forwards to sum up, and
    backwards to trace.
    """
    whose = KEY[:2]
    forward = pa.schema([(k, pa.int64()) for k in KEY] + [("into", pa.list_(pa.float64())), ("matrix", pa.list_(pa.float64()))])
    traced = pa.schema([(k, pa.int64()) for k in KEY] + [("first", pa.int32()), ("last", pa.int32())])

    def ahead(batches):
        before, score = None, None
        for b in batches:
            out = []
            for lone, conv, frag, sub, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (lone, conv) != before:
                    before, score = (lone, conv), np.append(np.full(STATES, -np.inf), 0.0)
                out.append((lone, conv, frag, sub, score.tolist(), flat))
                score = np.append((score[:, None] + np.array(flat).reshape(STATES + 1, STATES)).max(axis=0), -np.inf)
            yield _batch(out, forward)

    def trace(batches):
        before, last = None, 0
        for b in batches:
            out = []
            for lone, conv, frag, sub, into, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                every = np.array(into)[:, None] + np.array(flat).reshape(STATES + 1, STATES)
                if (lone, conv) != before:
                    before, last = (lone, conv), int(every.max(axis=0).argmax())
                first = int(every[:, last].argmax())
                out.append((lone, conv, frag, sub, first, last))
                last = first
            yield _batch(out, traced)

    up = matrices.repartition(*whose).sortWithinPartitions(*KEY).mapInArrow(ahead, f"{_PLACE}, into array<double>, matrix array<double>")
    down = up.sortWithinPartitions(*whose, F.desc("frag"), F.desc("sub"))
    return down.mapInArrow(trace, f"{_PLACE}, first int, last int")


def _render(turns: list[tuple[int | None, str]], opened: bool) -> str:
    out = ""
    for role, text in turns:
        out += "\n" + text if role is None else ("\n" + END_MARK if opened else "") + f"<|{ROLES[role]}|>\n{text}"
        opened = True
    return out


def decode(rows: DataFrame, states: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn, text, copies, role_pred, rendered) of every row."""
    out_schema = pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("text", pa.string()), ("copies", pa.int64()), ("role_pred", pa.string()), ("rendered", pa.string())]
    )

    def run(batches):
        out = []
        for g in _groups(batches):
            first, last, ends, data = None, None, False, []
            for r in g.to_pylist():
                if r["kind"] == 0:
                    first, last, ends = r["first"], r["last"], r["turn"] == 1
                else:
                    data.append((r, lines_of(r["text"])))
            lines = [x for _, ls in data for x in ls]
            path = model.path(model.scores(lines), first, last) if lines else []
            opened, at = first is not None and first != START, 0
            final = max((k for k, (_, ls) in enumerate(data) if ls), default=-1) if ends else -1
            for k, (r, ls) in enumerate(data):
                part = path[at : at + len(ls)]
                at += len(ls)
                piece = _render(turns_of(r["text"] or "", ls, part, opened), opened)
                opened = opened or bool(ls)
                if k == final:
                    piece += "\n" + END_MARK
                out.append((r["conv_id"], r["turn"], r["text"], r["copies"], ROLES[part[0] // 2] if part else None, piece))
            yield from _flush(out, out_schema)
        yield _batch(out, out_schema)

    # The states of a fragment travel with its rows; `turn` of a state row says whether the conversation ends here.
    top = states.groupBy("lone", "conv").agg(F.max(F.struct("frag", "sub")).alias("top"))
    tagged = states.join(top, ["lone", "conv"])
    tagged = tagged.select(
        *KEY, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("conv_id"), (F.struct("frag", "sub") == F.col("top")).cast("long").alias("turn"), F.lit(None).cast("long").alias("at"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"), "first", "last",
    )
    data = rows.select(*KEY, F.lit(1).alias("kind"), "conv_id", "turn", "at", "text", "copies", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    both = tagged.unionByName(data).repartition(*KEY).sortWithinPartitions(*KEY, "kind", *ORDER)
    return both.mapInArrow(run, "conv_id long, turn long, text string, copies long, role_pred string, rendered string")


def parse(transcripts: DataFrame, model: Model, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Roles and canonical pieces of all rows of all transcripts."""
    small_batches(transcripts.sparkSession)
    rows = transcripts.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{text}`").alias("text")
    )
    rows = rows.groupBy("conv_id", "turn", "text").agg(F.count("*").alias("copies"))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    rows = rows.withColumns(
        {
            "lone": F.when(alone, F.xxhash64(F.lit(7), "conv_id", "turn", "text")).otherwise(0),
            "conv": F.when(alone, F.xxhash64(F.lit(8), "conv_id", "turn", "text")).otherwise(F.col("conv_id")),
            "frag": F.when(alone, 0).otherwise(F.expr(f"turn div {FRAGMENT} - if(turn % {FRAGMENT} < 0, 1, 0)")),
            "at": F.shiftrightunsigned(F.xxhash64(F.lit(9), "text"), 1),
        }
    )
    rows = stage(rows, "chat-rows")
    # Crowded fragments are cut by turn, and each turn by ranges of the hash that orders its rows.
    place = ["lone", "conv", "frag"]
    crowded = rows.groupBy(*place).agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select(*place, F.ceil(F.col("n") / CROWDED).alias("cuts"))
    crowded = stage(crowded, "chat-crowded")
    if crowded.isEmpty():
        rows = rows.withColumn("sub", F.lit(0).cast("long"))
    else:
        cut = F.col("turn") % FRAGMENT * CUTS + F.floor(F.col("at") / float(1 << 63) * F.least("cuts", F.lit(CUTS - 1)))
        rows = rows.join(crowded, place, "left").withColumn("sub", F.coalesce(cut, F.lit(0)).cast("long")).drop("cuts")
    states = stage(stitch(stage(reduce_fragments(rows, model), "chat-matrices")), "chat-states")
    return decode(rows, states, model)
