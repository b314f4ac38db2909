"""Transcript parsing: a hidden Markov model over speaker-marker and line features recovers roles by Viterbi, then turns are rendered canonically.

A state is a role with "first line of a turn" or "further line". What a line
shows is its speaker marker, if any, and coarse features of its form. Scores
add up along a path, so a run of lines acts on the scores of its entry as a
small matrix under (max, +). Long transcripts come in segments: each segment's
matrix is found on its own, the matrices are chained per transcript, and every
segment is then decoded between its known entry and exit. The path is the one
that decoding the whole transcript at once gives, but no task holds it whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrowio import slices
from tidemark.storage import materialize

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
#: Words that name a speaker, in any case, by role. Fixed values.
NAMES = {"system": "system sys instructions instruction context", "user": "user human customer client q question me prompter", "assistant": "assistant ai bot model agent a answer gpt"}
ROLE_OF = {n: r for r, names in NAMES.items() for n in names.split()}
_NAME = "|".join(sorted(ROLE_OF, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:[#>*\-]{{1,4}}\s*)?(?:\[({_NAME})\]\s*:?|<\|?({_NAME})\|?>\s*:?|\*\*({_NAME})\*\*\s*:?|({_NAME})\s*(?:\([^)\n]{{0,40}}\))?\s*:)\s*", re.I)
FORMS = ("empty", "asks", "list", "code", "short", "long")
#: Counts added to every event when the model is fitted, and turns of a segment.
PRIOR, TURNS_A_SEGMENT = 0.5, 256
#: How turns are written where a transcript is made of them; the last has no marker, only an empty line before it.
STYLES = ("{0}: ", "[{0}] ", "### {0}:\n", "**{0}**: ", "<{0}> ", "\n")
#: What begins a control word of the canonical rendering, and how it is written where a text holds it.
CONTROL, ESCAPED = "<|", "<\\|"


def marker(line: str) -> tuple[str | None, str]:
    """(role, rest of the line); no marker, no role."""
    m = MARKER.match(line)
    if not m:
        return None, line
    return ROLE_OF[next(g for g in m.groups() if g).lower()], line[m.end():]


def form(line: str) -> int:
    x = line.strip()
    if not x:
        return 0
    if x.endswith("?"):
        return 1
    if x[:2] in ("- ", "* ") or x[:1].isdigit():
        return 2
    if x.startswith(("```", "    ", "def ", "{", "}")):
        return 3
    return 4 if len(x) < 60 else 5


class Hmm:
    """Log scores: start[state], step[from, to], mark[state, marker role or none], shape[state, form]."""

    def __init__(self, start: np.ndarray, step: np.ndarray, mark: np.ndarray, shape: np.ndarray):
        self.start, self.step, self.mark, self.shape = start, step, mark, shape

    @classmethod
    def from_counts(cls, start, step, mark, shape) -> Hmm:
        """From counted events; a further line never starts a turn, and only first lines follow another role's."""
        n = len(STATES)
        allowed = np.array([[b or (ra == rb) for rb, b in STATES] for ra, _ in STATES])

        def logs(x: np.ndarray, ok=None) -> np.ndarray:
            x = x + PRIOR
            if ok is not None:
                x = np.where(ok, x, 0)
            with np.errstate(divide="ignore"):
                return np.log(x / x.sum(axis=-1, keepdims=True))

        firsts = np.array([b for _, b in STATES])
        return cls(logs(np.asarray(start, float).reshape(n), firsts), logs(np.asarray(step, float).reshape(n, n), allowed), logs(np.asarray(mark, float).reshape(n, 4)), logs(np.asarray(shape, float).reshape(n, len(FORMS))))

    @classmethod
    def default(cls) -> Hmm:
        """Without examples: markers are trusted, user and assistant take turns, system comes first."""
        n = len(STATES)
        start = [30, 0, 60, 0, 10, 0]
        step, mark, shape = np.zeros((n, n)), np.zeros((n, 4)), np.ones((n, len(FORMS))) * 50
        for i, (r, first) in enumerate(STATES):
            other = {"system": "user", "user": "assistant", "assistant": "user"}[r]
            for j, (q, b) in enumerate(STATES):
                step[i, j] = 70 if q == r and not b else 28 if q == other and b else 1 if b else 0
            k = ROLES.index(r)
            mark[i] = [85 if x == k else 0.5 if x < 3 else 14 for x in range(4)] if first else [0.2, 0.2, 0.2, 99.4]
        return cls.from_counts(start, step, mark, shape)

    def emissions(self, lines: list[str]) -> np.ndarray:
        seen = [marker(x) for x in lines]
        marks = np.array([ROLES.index(r) if r else 3 for r, _ in seen])
        forms = np.array([form(rest) for _, rest in seen])
        return self.mark[:, marks].T + self.shape[:, forms].T

    def matrix(self, lines: list[str]) -> np.ndarray:
        """Best scores from each state before the lines to each state at their last."""
        out = None
        for e in self.emissions(lines):
            step = self.step + e[None, :]
            out = step if out is None else (out[:, :, None] + step[None, :, :]).max(axis=1)
        return out

    def decode(self, lines: list[str], entry: int | None, leave: int | None) -> list[int]:
        """The best path given the state before the lines (None: they begin the transcript) and that at their last (None: any)."""
        e = self.emissions(lines)
        score = (self.start if entry is None else self.step[entry]) + e[0]
        back = np.zeros(e.shape, dtype=np.int8)
        for t in range(1, len(e)):
            total = score[:, None] + self.step
            back[t] = total.argmax(axis=0)
            score = total.max(axis=0) + e[t]
        path = [int(score.argmax()) if leave is None else leave]
        for t in range(len(e) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]


def written(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, t, r, x): turns written as raw transcript lines.

    A turn's style is drawn by a hash of its place; a sixth have no marker but
    an empty line before them. Null roles have neither.
    """
    style = F.pmod(F.xxhash64(F.col(conv_col), F.col(turn_col), F.lit(3)), F.lit(len(STYLES)))
    name = F.initcap(F.col(role_col))
    wrote: Column = F.lit("")
    for i, s in enumerate(STYLES):
        a, _, b = s.partition("{0}")
        wrote = F.when((style == i) & name.isNotNull(), F.concat(F.lit(a), name, F.lit(b)) if b else F.lit(a)).otherwise(wrote)
    return turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.concat(wrote, F.coalesce(F.col(text_col), F.lit(""))).alias("x"))


def fit(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Hmm:
    """Count events over all labelled turns as written(): markers and forms of lines, and which role follows which.

    What reaches the driver is a few dozen counts. Turns of other or null
    roles do not teach; turns of one number are ordered by role; null texts
    are empty; repeated rows count each. An empty table gives the priors
    alone. The order of roles is found without their texts.
    """
    rows = written(turns, conv_col, turn_col, role_col, text_col).withColumn("r", F.lower("r")).where(F.col("r").isin(*ROLES))
    before = F.lag("r").over(Window.partitionBy("c").orderBy("t", "r"))
    pairs = rows.select("c", "t", "r").withColumn("b", before).groupBy("b", "r").count().collect()
    width = len(FORMS) + 4

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(STATES), width), dtype=np.int64)
        for roles, texts in slices(batches):
            for r, x in zip(roles, texts):
                for k, line in enumerate(x.split("\n")):
                    s, (who, rest) = STATES.index((r, k == 0)), marker(line)
                    out[s, ROLES.index(who) if who else 3] += 1
                    out[s, 4 + form(rest)] += 1
        i, j = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.reshape(-1).astype(np.int64)) for a in (i, j, out)], names=["s", "f", "n"])

    seen = rows.select("r", "x").mapInArrow(events, "s long, f long, n long").groupBy("s", "f").agg(F.sum("n").alias("n")).collect()
    n, counts = len(STATES), np.zeros((len(STATES), width))
    for r in seen:
        counts[r.s, r.f] = r.n
    start, step = np.zeros(n), np.zeros((n, n))
    for p in pairs:
        if p.b is None:
            start[STATES.index((p.r, True))] += p["count"]
        else:
            for first in (True, False):
                step[STATES.index((p.b, first)), STATES.index((p.r, True))] += p["count"]
    for r in ROLES:
        for first in (True, False):
            step[STATES.index((r, first)), STATES.index((r, False))] += counts[STATES.index((r, False)), :4].sum()
    return Hmm.from_counts(start, step, counts[:, :4], counts[:, 4:])


def segments_of_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per: int = TURNS_A_SEGMENT) -> DataFrame:
    """(conv_id, segment, text): turns as written(), per turns a segment at most by turn number.

    Turns that share a number are in one segment, ordered by role and text.
    """
    rows = written(turns, conv_col, turn_col, role_col, text_col)
    placed = rows.select(F.col("c").alias("conv_id"), F.floor(F.coalesce("t", F.lit(0)) / per).cast("long").alias("segment"), F.struct("t", "r", "x").alias("row"))
    return placed.groupBy("conv_id", "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x["x"]), "\n").alias("text"))


def parse(segments: DataFrame, model: Hmm) -> DataFrame:
    """(conv_id, segment, line, role, first, text): every line of each transcript with its recovered role.

    segments: (conv_id, segment, text) with one row a segment, in segment
    order; a transcript in one row is one segment. text is the line without
    its marker; first says that a turn begins there. Null text is an empty
    line, null conv_id a transcript like others, repeated (conv_id, segment)
    are ordered by a hash of their text. An empty table gives an empty result.
    """
    spark = segments.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = materialize(segments.select("conv_id", "segment", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid")), "transcript-segments")
    # a conversation's segments are counted and placed without their texts
    heads = rows.select("conv_id", "segment", "rid", F.xxhash64("text").alias("h"))
    places = heads.select("rid", F.count("*").over(Window.partitionBy("conv_id")).alias("parts"), F.row_number().over(Window.partitionBy("conv_id").orderBy("segment", "h", "rid")).alias("place"))
    rows = materialize(rows.join(places, "rid").drop("rid"), "transcript-places")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, place, texts in slices(batches):
            found = [held.value.matrix(t.split("\n")).reshape(-1).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(place, pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["conv_id", "place", "m"])

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        """States before and at the end of each segment on the best path; a row here is 36 numbers, whatever the segment's length."""
        g = g.sort_values("place")
        n = len(STATES)
        each = [np.array(x).reshape(n, n) for x in g["m"]]
        score, back = None, []
        for k, x in enumerate(each):
            if k == 0:
                score = np.array(g["s"].iloc[0])
            else:
                total = score[:, None] + x
                back.append(total.argmax(axis=0))
                score = total.max(axis=0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        return pd.DataFrame({"conv_id": g["conv_id"], "place": g["place"], "entry": [-1, *ends[:-1]], "leave": ends})

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores at the end of first segments, by state."""
        for conv, texts in slices(batches):
            out = []
            for t in texts:
                lines, m = t.split("\n"), held.value
                score = m.start + m.emissions(lines[:1])[0]
                if len(lines) > 1:
                    score = (score[:, None] + m.matrix(lines[1:])).max(axis=0)
                out.append(score.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "s"])

    many = rows.where("parts > 1").withColumn("conv_id", F.col("conv_id").cast("long"))
    each = many.select("conv_id", "place", "text").mapInArrow(matrices, "conv_id long, place int, m array<double>")
    begin = many.where("place = 1").select("conv_id", "text").mapInArrow(firsts, "conv_id long, s array<double>").withColumnRenamed("conv_id", "c")
    bounds = (each.join(begin, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").groupBy("conv_id")
              .applyInPandas(chain, "conv_id long, place int, entry int, leave int").withColumnsRenamed({"conv_id": "c", "place": "p"}))
    known = rows.where("parts > 1").join(bounds, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p"))).select("conv_id", "segment", "text", "entry", "leave")
    alone = rows.where("parts = 1").select("conv_id", "segment", "text", F.lit(-1).alias("entry"), F.lit(-1).alias("leave"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, segment, texts, entry, leave in slices(batches):
            out = []
            for c, s, t, a, z in zip(conv, segment, texts, entry, leave):
                lines = t.split("\n")
                path = held.value.decode(lines, None if a < 0 else a, None if z < 0 else z)
                out += [(c, s, i, *STATES[k], marker(x)[1]) for i, (x, k) in enumerate(zip(lines, path))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "segment", "line", "role", "first", "text"])

    return alone.unionByName(known).select(F.col("conv_id").cast("long"), F.col("segment").cast("long"), "text", "entry", "leave").mapInArrow(decode, "conv_id long, segment long, line int, role string, first boolean, text string")


def render(lines: DataFrame) -> DataFrame:
    """(conv_id, segment, n_lines, n_turns, roles, rendered): turns as <|role|>, their lines, <|end|>; a segment that continues a turn begins with its lines.

    The empty line that begins an unmarked turn is left out. Where a text
    holds the beginning of a control word it is escaped, so that no text can
    forge a turn.
    """
    text = F.replace("text", F.lit(CONTROL), F.lit(ESCAPED))
    per = lines.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("line", "role", "first", text.alias("text")))).alias("rows"))
    heads = F.transform("rows", lambda x, i: F.concat(F.when(x["first"] & (i > 0), F.lit("<|end|>\n")).otherwise(F.lit("")), F.when(x["first"], F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))).otherwise(F.lit(""))))
    blank = lambda x, i: x["first"] & (x["text"] == "") & F.coalesce(~F.get("rows", i + 1)["first"], F.lit(False))
    lines_ = F.transform("rows", lambda x, i: F.when(blank(x, i), F.lit("")).otherwise(F.concat(x["text"], F.lit("\n"))))
    said = F.zip_with(heads, lines_, lambda h, x: F.concat(h, x))
    turns = F.filter("rows", lambda x: x["first"])
    return per.select("conv_id", "segment", F.size("rows").cast("long").alias("n_lines"), F.size(turns).cast("long").alias("n_turns"), F.array_join(F.transform(turns, lambda x: x["role"]), ",").alias("roles"), F.concat(F.array_join(said, ""), F.lit("<|end|>\n")).alias("rendered"))


def op9_chat_transcripts(turns: DataFrame) -> DataFrame:
    """conv_id, segment, n_lines, n_turns, roles, rendered: conversations written as raw transcripts and parsed again."""
    return render(parse(segments_of_turns(turns), fit(turns)))
