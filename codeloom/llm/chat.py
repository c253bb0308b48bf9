"""Chat formatting: roles recovered from raw transcripts by a hidden Markov model, then canonical turns.

Hidden states are (role, begins or goes on) for system, user and assistant. Each line that isn't blank is observed as its speaker marker
(whose role it names, or none) and its shape (after a blank line or not; a question or not; indented or not). Viterbi finds the likeliest
states; each run begun by a "begins" state is a turn, rendered as ``<|im_start|>role``, its text, ``<|im_end|>``. A marker is cut off
only where its own role begins a turn; blank lines within a turn stay.

Transcripts come as chunks of text, in order, a blank line between two. The chunks are range-partitioned by conversation and order, so a long conversation
spreads over many partitions. One that lies within a partition is parsed there. Of the first and last of a partition the likeliest scores from each state
to each (a 6 by 6 matrix) are computed there too; the driver, which gets two such matrices from each partition, chains them in order, and then each piece is
parsed with the scores that it starts from and the state that it ends in. Log probabilities are integers, so the result is the same as that of one
walk over the whole transcript, wherever partitions begin.

Defined cases: a null or empty transcript has no lines and no turns; a transcript's first line always begins a turn; of equally likely states the smallest, from
the last line backwards; a null conv_id is a conversation of its own key (null); chunks that tie in order are ordered by text; in :func:`transcripts` a null turn comes first, a null
role is written without a marker, a null text as an empty line; repeated rows are turns of their own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

ROLES = ("system", "user", "assistant")
PART_BYTES = 16 << 20
MARKERS = {
    "system": 0, "sys": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "q": 1, "question": 1, "me": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "model": 2,
}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*)?[\[<(*]{0,2}(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")[\]>)*]{0,2}\s*([:>\-])[:*\]>)]{0,2}\s*", re.IGNORECASE)

# States: 0-2 begin a turn of the role, 3-5 go on with it.
NEVER = -(1 << 40)
NEXT_ROLE = np.array([[0.02, 0.93, 0.05], [0.01, 0.04, 0.95], [0.01, 0.95, 0.04]])
GO_ON = 0.6


def _log(p: np.ndarray) -> np.ndarray:
    return np.rint(np.log(p) * (1 << 20)).astype(np.int64)


START = np.r_[_log(np.array([0.3, 0.6, 0.1])), [NEVER] * 3]


def _transitions() -> np.ndarray:
    t = np.full((6, 6), NEVER)
    for s in range(6):
        r = s % 3
        t[s, 3 + r] = _log(np.array(GO_ON))
        t[s, :3] = _log((1 - GO_ON) * NEXT_ROLE[r])
    return t


TRANSITIONS = _transitions()


def _emissions() -> np.ndarray:
    """Log P(marker, after a blank, question, indented | state): marker 0-2 names a role, 3 is none, 4-6 name a role without a colon."""
    out = np.zeros((6, 7, 2, 2, 2))
    for s in range(6):
        role, begins = s % 3, s < 3
        marker = np.array([0.002, 0.002, 0.002, 0.166, 0.005, 0.005, 0.005] if begins else [0.003, 0.003, 0.003, 0.961, 0.01, 0.01, 0.01])
        if begins:
            marker[role], marker[4 + role] = 0.77, 0.05
        blank = np.array([0.3, 0.7]) if begins else np.array([0.95, 0.05])
        question = np.array([0.7, 0.3]) if role == 1 else np.array([0.92, 0.08])
        indented = np.array([0.995, 0.005]) if begins else np.array([0.75, 0.25])
        out[s] = marker[:, None, None, None] * blank[None, :, None, None] * question[None, None, :, None] * indented
    return _log(out)


EMISSIONS = _emissions()


class Lines(NamedTuple):
    """The lines of a text that aren't blank: observations, texts, marker lengths and blank lines before each; and blank lines after the last."""

    seen: list[tuple[int, int, int, int]]
    texts: list[str]
    marker: list[int]
    blanks: list[int]
    trail: int


def observe(lines: list[str]) -> Lines:
    out, blank = Lines([], [], [], [], 0), 0
    for k, line in enumerate(lines):
        if not line.strip():
            blank += 1
            continue
        m = MARKER.match(line)
        out.seen.append((MARKERS[m.group(1).lower()] + 4 * (m.group(2) != ":") if m else 3, int(blank > 0 or k == 0), int(line.rstrip().endswith("?")), int(line[0] in " \t")))
        out.texts.append(line)
        out.marker.append(m.end() if m else 0)
        out.blanks.append(blank)
        blank = 0
    return out._replace(trail=blank)


def forward(seen: list[tuple[int, ...]], score: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each last state, and for each line and state the best state of the line before (of equals the smallest).

    ``score``: of the states of the line before the first; without it the first line starts a transcript.
    """
    back = np.zeros((len(seen), 6), np.int8)
    for t, o in enumerate(seen):
        if score is None:
            score = START + EMISSIONS[(slice(None), *o)]
        else:
            through = score[:, None] + TRANSITIONS
            back[t] = through.argmax(0)
            score = through.max(0) + EMISSIONS[(slice(None), *o)]
    return score, back


def backward(back: np.ndarray, last: int) -> list[int]:
    """The states of all lines, and before them the one of the line before the first."""
    states = [last]
    for row in back[::-1]:
        states.append(int(row[states[-1]]))
    return states[::-1]


def through(seen: list[tuple[int, ...]]) -> np.ndarray:
    """The best scores of lines from each state of the line before them to each of the last one."""
    m = np.where(np.eye(6, dtype=bool), 0, NEVER * 4)
    for o in seen:
        m = (m[:, :, None] + TRANSITIONS[None]).max(1) + EMISSIONS[(slice(None), *o)]
    return m


def viterbi(seen: list[tuple[int, ...]]) -> list[int]:
    """The likeliest states of a whole transcript."""
    if not seen:
        return []
    score, back = forward(seen)
    return backward(back, int(score.argmax()))[1:]


class Turn(NamedTuple):
    """A turn, or what a later part of the transcript adds to it; ``line`` counts from the part's first line."""

    line: int
    goes_on: bool
    role: str
    text: str


def turns(lines: Lines, states: list[int], before: int = 0) -> list[Turn]:
    """``before``: blank lines at the end of the part before."""
    out: list[tuple[int, bool, str, list[str]]] = []
    for k, (state, text) in enumerate(zip(states, lines.texts)):
        role = state % 3
        if state < 3:
            cut = lines.marker[k] if lines.seen[k][0] in (role, role + 4) else 0
            out.append((k, False, ROLES[role], [text[cut:]]))
        else:
            if not out:
                out.append((k, True, ROLES[role], []))
            out[-1][3].append("\n" * (1 + lines.blanks[k] + (before if not k else 0)) + text)
    return [Turn(k, on, role, "".join(t)) for k, on, role, t in out]


def parse(transcript: str | None) -> list[tuple[str, str]]:
    """The turns of one raw transcript: (role, text)."""
    lines = observe((transcript or "").split("\n"))
    return [(t.role, t.text) for t in turns(lines, viterbi(lines.seen))]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def _render(turn: Turn, ends: bool) -> str:
    return ("" if turn.goes_on else f"<|im_start|>{turn.role}\n") + turn.text + ("<|im_end|>\n" if ends else "")


def _observe(chunks: list[str | None]) -> Lines:
    return observe("\n\n".join(c or "" for c in chunks).split("\n"))


# Turns are kind 0. Of a partition's first and last conversation the chunks are kind 1 and what the driver gets kind 2.
PARSED = "kind int, part int, last boolean, seq long, conv_id long, line long, goes_on boolean, role string, text string, rendered string, scores array<long>"
CHATS = "conv_id long, line long, goes_on boolean, role string, text string, rendered string"
_TURN = [f.split()[0] for f in CHATS.split(", ")]
_PARSED_KINDS = (pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()))
_PARSED = [f.split()[0] for f in PARSED.split(", ")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses the conversations of a sorted partition but for its first and last."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    own, chunks, first = None, [], True

    def edge(last: bool) -> None:
        lines = _observe(chunks)
        start = forward(lines.seen)[0] if lines.seen else START
        lead = lines.blanks[0] if lines.seen else lines.trail
        out.append((2, part, last, 0, own, len(lines.seen), False, None, None, None, [lead, lines.trail, *start.tolist(), *through(lines.seen).ravel().tolist()]))
        out.extend((1, part, last, k, own, None, None, None, c, None, None) for k, c in enumerate(chunks))

    def batch() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * len(_PARSED), _PARSED_KINDS)], names=_PARSED)
        out.clear()
        return found

    for b in batches:
        for conv_id, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if chunks and conv_id != own:
                if first:
                    edge(False)
                    first = False
                else:
                    lines = _observe(chunks)
                    out.extend((0, part, False, 0, own, *t, _render(t, True), None) for t in turns(lines, viterbi(lines.seen)))
                chunks = []
            own = conv_id
            chunks.append(chunk)
        if len(out) >= 10_000:
            yield batch()
    if chunks:
        edge(True)
    yield batch()


class Piece(NamedTuple):
    """How a piece of a conversation is parsed: scores it starts from (None: it is the first), its last state, lines and blank lines before, whether a turn ends with it."""

    score: list[int] | None
    state: int | None
    line: int
    before: int
    ends: bool


def _pieces(batches: Iterator[pa.RecordBatch], known: dict) -> Iterator[tuple[tuple[int, bool], int | None, Lines]]:
    """The pieces of a partition sorted by (part, last, seq), as far as they are known."""
    held, own, conv = [], None, None
    for b in batches:
        for part, last, conv_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "last", "conv_id", "text"))):
            if own is not None and own != (part, last):
                if own in known:
                    yield own, conv, _observe(held)
                held = []
            own, conv = (part, last), conv_id
            held.append(text)
    if own in known:
        yield own, conv, _observe(held)


def _entries(known: dict[tuple[int, bool], Piece]):
    """For each last state of a piece, the state before its first line and the one of its first line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, last), _, lines in _pieces(batches, known):
            score = known[part, last].score
            back = forward(lines.seen, None if score is None else np.array(score))[1]
            found = [backward(back, s)[:2] for s in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([last]), pa.array([[x for p in found for x in p]], pa.list_(pa.int64()))], names=["part", "last", "states"])

    return run


def _finish(known: dict[tuple[int, bool], Piece]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _PARSED_KINDS[4:10]
        for at, conv, lines in _pieces(batches, known):
            piece = known[at]
            if not lines.seen:
                continue
            back = forward(lines.seen, None if piece.score is None else np.array(piece.score))[1]
            found = turns(lines, backward(back, piece.state)[1:], piece.before)
            rows = [(conv, t.line + piece.line, *t[1:], _render(t, k + 1 < len(found) or piece.ends)) for k, t in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_TURN)

    return run


def _chains(edges: list) -> list[list]:
    """The pieces with lines of each conversation, in order."""
    out: list[list] = []
    for e in sorted(edges, key=lambda e: (e.part, e.last)):
        if out and out[-1][-1].conv_id == e.conv_id:
            out[-1].append(e)
        else:
            out.append([e])
    return out


def format_chats(chunks: DataFrame, order: tuple[str, ...] = (), part_bytes: int = PART_BYTES) -> DataFrame:
    """``conv_id, line, goes_on, role, text, rendered``: the turns of raw transcripts, given as ``conv_id, chunk`` and columns of ``order``.

    ``line``: how many lines of the conversation that aren't blank come before. A turn that spreads over several partitions has further rows that go on;
    ``rendered`` of all rows by ``line``, joined, is the canonical chat.
    """
    rows = pick(chunks, conv_id="conv_id", chunk="chunk", **{f"o{k}": c for k, c in enumerate(order)})
    by = ["conv_id", *(f"o{k}" for k in range(len(order))), "chunk"]
    parts = (rows.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0) // part_bytes + 1
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("conv_id", "chunk")
    parsed = materialize(ranged.mapInArrow(_parse, PARSED), "chats")
    pieces = parsed.where("kind = 1").select("part", "last", "seq", "conv_id", "text").repartitionById(parts, "part").sortWithinPartitions("part", "last", "seq")
    chains = _chains(parsed.where("kind = 2").collect())  # two rows for each partition
    known: dict[tuple[int, bool], Piece] = {}
    for chain in chains:
        score, line, before = None, 0, 0
        for k, e in enumerate(chain):
            known[e.part, e.last] = Piece(score, None, line, before + (k > 0), True)
            lead, trail, *more = e.scores
            if e.line:
                f = np.array(more[:6]) if score is None else (np.array(score)[:, None] + np.array(more[6:]).reshape(6, 6)).max(0)
                score, before = f.tolist(), trail
            else:  # blank lines only
                before += (k > 0) + lead
            line += e.line
        live = [e for e in chain if e.line]
        if live:
            known[live[-1].part, live[-1].last] = known[live[-1].part, live[-1].last]._replace(state=int(np.argmax(score)))
    many = {(e.part, e.last): known[e.part, e.last] for chain in chains if sum(e.line > 0 for e in chain) > 1 for e in chain if e.line}
    entries = {(r.part, r.last): r.states for r in pieces.mapInArrow(_entries(many), "part int, last boolean, states array<long>").collect()} if many else {}
    for chain in chains:
        live = [(e.part, e.last) for e in chain if e.line]
        for earlier, later in zip(live[-2::-1], live[:0:-1]):
            entry, first = entries[later][2 * known[later].state : 2 * known[later].state + 2]
            known[earlier] = known[earlier]._replace(state=entry, ends=first < 3)
    done = parsed.where("kind = 0").select(*_TURN)
    return done.union(pieces.mapInArrow(_finish(known), CHATS))


def _marker(conv_id: Column, turn: Column, role: Column) -> Column:
    """How the raw transcript marks a turn: four styles by conversation; every fifth turn after the first isn't marked."""
    style = F.pmod(F.coalesce(conv_id, F.lit(0)), F.lit(4))
    named = F.when(role == "user", F.array(*map(F.lit, ("User", "### Human", "[User]", "Q")))).when(role == "assistant", F.array(*map(F.lit, ("Assistant", "### AI", "[Assistant]", "A")))).when(role == "system", F.array(*map(F.lit, ("System", "### System", "[System]", "Instruction"))))
    bare = named.isNull() | ((F.pmod(F.coalesce(turn, F.lit(0)), F.lit(5)) == 4) & (turn > 0))
    return F.when(bare, F.lit("")).otherwise(F.concat(F.get(named, style.cast("int")), F.lit(": ")))


def transcripts(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, chunk``: the conversations written down as raw text, a chunk for each turn."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    return rows.select("conv_id", "turn", "role", F.concat(_marker(F.col("conv_id"), F.col("turn"), F.col("role")), F.coalesce("text", F.lit(""))).alias("chunk"))


def report(conversations: DataFrame) -> DataFrame:
    return format_chats(transcripts(conversations), ("turn", "role"))
