"""Chat formatting (operator 10): roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines, some of which open with a speaker marker.
Hidden states are (role, first or later line of a turn). A line shows its
marker's class, its length class and its ending; the three are independent
given the state. Start, transition and emission counts come from all labelled
lines that are not held out, summed by Spark. Viterbi gives the likeliest states; each first line starts a turn.

Transcripts can be of any length. Lines are sorted and dealt by Spark in ranges
of (conv_id, part, line_no), and each range is cut into chunks of at most
``CHUNK_LINES`` lines of one conversation. A chunk's effect on Viterbi scores
is a small matrix (best score from each entry state to each exit state); the
matrices of a conversation's chunks, not its lines, are walked to find the
states at the chunk borders, and every chunk is then decoded on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velora.llm.common import stored

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
CHUNK_LINES = 2048
_N = len(STATES)
#: Speaker names of transcripts, by role.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "question", "q", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "gpt", "model", "agent"),
}
_ROLE_OF = {name: role for role, names in MARKERS.items() for name in names}
_MARKER = re.compile(
    r"^\s*(?:#{1,6}\s*|[>*_\-]{1,3}\s*)?(?:[\[<(|]{1,2})?\s*(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:[\]>)|]{1,2}|\*{1,2})?\s*:\s*",
    re.IGNORECASE,
)
_LENGTHS = (0, 1, 24, 80, 240, 800)
_ENDINGS = ("?", ":", ".", "!")
N_MARKER, N_LENGTH, N_END = len(ROLES) + 1, len(_LENGTHS), len(_ENDINGS) + 1


def marker(line: str) -> tuple[str | None, str]:
    """The role that a line's speaker marker names (None: no marker), and the line without it."""
    m = _MARKER.match(line)
    return (_ROLE_OF[m.group(1).lower()], line[m.end() :]) if m else (None, line)


def observe(line: str) -> tuple[int, int, int]:
    role, rest = marker(line)
    rest = rest.strip()
    length = sum(len(rest) >= x for x in _LENGTHS) - 1
    ending = _ENDINGS.index(rest[-1]) if rest and rest[-1] in _ENDINGS else len(_ENDINGS)
    return (ROLES.index(role) if role else len(ROLES), length, ending)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, np.ndarray, np.ndarray]

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log emission of every line and state."""
        seen = np.array([observe(x) for x in lines], dtype=np.int64).reshape(-1, 3)
        return sum(table[:, seen[:, k]].T for k, table in enumerate(self.emit))


def fit(turns: dict, lines: dict, smooth: float = 0.5) -> Model:
    """From counts, for roles as places in ``ROLES``.

    ``turns``: (role before, whether its turn has more lines, role) -> turns;
    the role before is None where a turn opens a conversation. ``lines``:
    (role, place in the turn: 0, 1 or 2 for later, marker, length, ending) -> lines.
    """
    start, step = np.full(_N, smooth), np.full((_N, _N), smooth)
    emit = [np.full((_N, n), smooth) for n in (N_MARKER, N_LENGTH, N_END)]
    for (before, more, role), n in turns.items():
        if before is None:
            start[2 * role] += n
        else:
            step[2 * before + bool(more), 2 * role] += n
    for (role, place, *seen), n in lines.items():
        s = 2 * role + (place > 0)
        if place:
            step[2 * role + (place > 1), s] += n
        for table, o in zip(emit, seen):
            table[s, o] += n
    for role in range(len(ROLES)):  # a later line belongs to the turn's own role
        for s in range(_N):
            if s // 2 != role:
                step[s, 2 * role + 1] = 1e-12
        start[2 * role + 1] = 1e-12
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(log(start), log(step), tuple(log(t) for t in emit))


def transfer(model: Model, scores: np.ndarray) -> np.ndarray:
    """Best score of the lines for every (state before them, state of the last of them)."""
    best = model.step + scores[0]
    for row in scores[1:]:
        best = (best[:, :, None] + model.step[None]).max(axis=1) + row
    return best


def viterbi(model: Model, scores: np.ndarray, enter: int | None, leave: int | None) -> list[int]:
    """The likeliest states, after state ``enter`` (None: at the start) and ending in ``leave`` (None: any).

    Of equally likely states the first in the order of ``STATES`` is taken.
    """
    best = (model.start if enter is None else model.step[enter]) + scores[0]
    back = np.zeros((len(scores), _N), dtype=np.int8)
    for i in range(1, len(scores)):
        ways = best[:, None] + model.step
        back[i] = ways.argmax(axis=0)
        best = ways[back[i], np.arange(_N)] + scores[i]
    path = [int(best.argmax()) if leave is None else leave]
    for i in range(len(scores) - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return path[::-1]


def borders(model: Model, first: np.ndarray, matrices: list[np.ndarray]) -> list[int]:
    """The last state of every chunk on the best path; ``first``: best scores at the end of the first chunk."""
    best, back = first, []
    for m in matrices:
        ways = best[:, None] + m
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    states = [int(best.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


# --- Spark --------------------------------------------------------------------------------

_CHUNK = "conv_id bigint, place bigint, parts array<bigint>, nos array<bigint>, lines array<string>, matrix array<double>"
_CHUNK_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("place", pa.int64()), ("parts", pa.list_(pa.int64())),
        ("nos", pa.list_(pa.int64())), ("lines", pa.list_(pa.string())), ("matrix", pa.list_(pa.float64())),
    ]
)
_TURN = "conv_id bigint, part bigint, line_no bigint, role string, starts boolean, n_lines int, rendered string"


def _chunker(model: Model):
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        conv, parts, nos, lines = None, [], [], []

        def close() -> pa.RecordBatch:
            nonlocal place, parts, nos, lines
            # the matrix of a conversation's only chunk is never read, but a task can't tell which are
            matrix = transfer(model, model.scores(lines)).ravel().tolist()
            row = {"conv_id": conv, "place": place, "parts": parts, "nos": nos, "lines": lines, "matrix": matrix}
            place, parts, nos, lines = place + 1, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_CHUNK_ARROW)

        opened = False
        for batch in batches:
            for c, p, n, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if opened and (c != conv or len(lines) >= CHUNK_LINES):
                    yield close()
                conv, opened = c, True
                parts.append(p)
                nos.append(n)
                lines.append(line or "")
        if opened:
            yield close()

    return chunk


def _border_states(model: Model):
    def walk(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("place")
        matrices = [np.array(m).reshape(_N, _N) for m in chunks["matrix"]]
        first = np.array(chunks["opening"].iloc[0])
        states = borders(model, first, matrices[1:])
        return pd.DataFrame({"place": chunks["place"], "enter": [-1, *states[:-1]], "leave": states})

    return walk


def parse(lines: DataFrame, model: Model) -> DataFrame:
    """Turn pieces of transcript lines (conv_id, part, line_no, line), canonically rendered.

    Columns: conv_id, part and line_no of the first line, role, starts (a new
    turn; false only where a chunk border cuts a turn), n_lines, rendered. The
    ``rendered`` of a conversation, joined in order, is its canonical text:
    ``<|role|>`` line, the turn's lines without markers, ``<|end|>`` line.
    Null lines are empty, null order numbers come first, a null conv_id is a
    conversation of its own. Ties in the order are broken by the line itself.
    """
    spark = lines.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["conv_id", "part", "line_no", "line"]
    shared = spark.sparkContext.broadcast(model)  # a few hundred floats
    chunks = stored(
        lines.select(*(F.col(c).cast("string" if c == "line" else "bigint").alias(c) for c in keys))
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(lambda b: _chunker(shared.value)(b), _CHUNK),
        "chat-chunks",
    )
    # only conversations of several chunks need the states at their borders
    small = chunks.select("conv_id", "place", "matrix", "lines")
    several = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("head")).filter("n > 1")

    @F.pandas_udf("array<double>")
    def opening(texts: pd.Series) -> pd.Series:
        m = shared.value
        out = []
        for t in texts:
            s = m.scores(list(t))
            best = m.start + s[0]
            for row in s[1:]:
                best = (best[:, None] + m.step).max(axis=0) + row
            out.append(best)
        return pd.Series(out)

    cross = small.alias("c").join(several.alias("s"), F.col("c.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        "c.conv_id", "place", "matrix", (F.col("place") == F.col("head")).alias("is_head"), "lines"
    )
    heads = cross.filter("is_head").select("conv_id", "place", "matrix", opening(F.col("lines")).alias("opening"))
    rest = cross.filter("not is_head").select("conv_id", "place", "matrix", F.array().cast("array<double>").alias("opening"))
    states = stored(
        heads.unionByName(rest)
        .groupBy("conv_id")
        .applyInPandas(lambda df: _border_states(shared.value)(df), "place bigint, enter int, leave int"),
        "chat-borders",
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for df in batches:
            rows: list[tuple] = []
            for conv, parts, nos, texts, enter, leave in zip(df["conv_id"], df["parts"], df["nos"], df["lines"], df["enter"], df["leave"]):
                rows += _pieces(m, conv, parts, nos, list(texts), enter, leave)
            out = pd.DataFrame(rows, columns=["conv_id", "part", "line_no", "role", "starts", "n_lines", "rendered"])
            yield out.astype({"conv_id": "Int64", "part": "Int64", "line_no": "Int64"})

    ends = states.select("place", "enter", "leave")
    joined = chunks.join(ends, "place", "left").select(
        "conv_id", "parts", "nos", "lines", F.coalesce("enter", F.lit(-1)).alias("enter"), F.coalesce("leave", F.lit(-1)).alias("leave")
    )
    return joined.mapInPandas(decode, _TURN)


def _pieces(model: Model, conv, parts, nos, lines: list[str], enter: int, leave: int) -> list[tuple]:
    path = viterbi(model, model.scores(lines), None if enter < 0 else enter, None if leave < 0 else leave)
    opens = [i for i, s in enumerate(path) if i == 0 or STATES[s][1]]
    rows = []
    for a, b in zip(opens, [*opens[1:], len(path)]):
        role, starts = STATES[path[a]]
        body = [marker(lines[a])[1] if starts else lines[a], *lines[a + 1 : b]]
        head = ("" if a == 0 and enter < 0 else "<|end|>\n") + f"<|{role}|>\n" if starts else ""
        conv_id = None if conv is None or conv != conv else int(conv)
        rows.append((conv_id, _int(parts[a]), _int(nos[a]), role, starts, b - a, head + "".join(f"{x}\n" for x in body)))
    return rows


def _int(x) -> int | None:
    return None if x is None or x != x else int(x)


# --- transcripts and labels from the conversations table ------------------------------------

#: How a transcript marks speakers, by style; the last style marks every third turn only.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### System: ", "user": "### Human: ", "assistant": "### Assistant: "},
    {"system": "[sys]: ", "user": "Q: ", "assistant": "A: "},
    {"system": "System: ", "user": "> Human: ", "assistant": "AI: "},
)


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: conv_id, part (turn), line_no, line, role.

    The style follows crc32 of conv_id; in the last style a turn has no marker
    unless crc32 of conv_id and turn leaves no remainder by 3. Null roles have no marker.
    """
    style = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % len(STYLES), F.lit(0))
    name = F.lit("")
    for k, marks in enumerate(STYLES):
        for role, mark in marks.items():
            name = F.when((style == k) & (F.col("role") == role), mark).otherwise(name)
    bare = (style == len(STYLES) - 1) & (F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 3 != 0)
    text = F.concat(F.when(bare, "").otherwise(name), F.coalesce("text", F.lit("")))
    lines = F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")
    return conversations.select("conv_id", F.col("turn").alias("part"), "role", lines).select(
        "conv_id", "part", F.col("line_no").cast("long").alias("line_no"), "line", "role"
    )


@F.pandas_udf(T.StructType([T.StructField(c, T.ByteType()) for c in ("marker", "length", "ending")]))
def _observed(lines: pd.Series) -> pd.DataFrame:
    seen = [observe(x or "") for x in lines]
    return pd.DataFrame(seen, columns=["marker", "length", "ending"])


def counts(lines: DataFrame) -> tuple[dict, dict]:
    """What ``fit`` takes, from all labelled ``lines`` but those of held-out conversations (crc32(conv_id) mod 4 = 2).

    Line 0 opens a turn. A turn follows the turn of the preceding number in its
    conversation; without one, or behind an unknown role, it counts as an
    opening. Rows of one turn number are one turn, of the least role. Unknown
    roles, and lines without conversation, turn or line number, are left out.
    Counts are summed on the map side; only two tables of a size that the
    states fix (21 and 1,080 rows at most) reach the driver.
    """
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    known = lines.filter(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2)
    known = known.select("conv_id", "part", "line_no", "line", role.alias("role")).filter("role >= 0 and part is not null and line_no is not null")
    place = F.least("line_no", F.lit(2)).cast("int").alias("place")
    seen = known.select("role", place, _observed("line").alias("o")).groupBy("role", "place", "o.marker", "o.length", "o.ending").count()
    turns = known.groupBy("conv_id", "part").agg(F.min("role").alias("role"), (F.max("line_no") > 0).alias("more"))
    before = turns.select("conv_id", (F.col("part") + 1).alias("part"), F.col("role").alias("before"), "more")
    steps = turns.drop("more").join(before, ["conv_id", "part"], "left").groupBy("before", "more", "role").count()
    return {tuple(r)[:-1]: r["count"] for r in steps.collect()}, {tuple(r)[:-1]: r["count"] for r in seen.collect()}


def train(lines: DataFrame) -> Model:
    """The model of labelled ``lines``: conv_id, part, line_no, line, role; see ``counts``."""
    return fit(*counts(lines))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Recovered turns of every conversation, from its raw transcript: see ``parse``; part is the source turn."""
    lines = transcript_lines(conversations.select("conv_id", "turn", "role", "text"))
    return parse(lines.drop("role"), train(lines))
