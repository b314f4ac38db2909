"""Best-fit packing by patterns and non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers, whatever
the corpus) is planned with. Patterns of one to four lengths that fill a
sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded, and what is left is packed best-fit,
longest first, over counts of equal lengths and equal gaps. The plan says for
each length which ranks lie in which sequences, so a piece finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrowio import slices
from tidemark.llm.wordcache import shared
from tidemark.storage import materialize

CAPACITY, END_ID = 4096, 1
#: Choices of each further length, tokens a pattern may leave free, and the fit's largest projected gradient, in pieces.
PATTERNS_EACH, SLACK, TOLERANCE = 4, 8, 0.5


def enumerate_patterns(hist: np.ndarray, capacity: int, each: int = PATTERNS_EACH, slack: int = SLACK) -> list[tuple[int, ...]]:
    """Patterns (longest first) of one to four lengths present, filling capacity but for slack at most.

    For each longest length the second (and third) lengths tried are those of
    most pieces; the last is the longest that fits.
    """
    present = np.flatnonzero(hist)
    out: set[tuple[int, ...]] = set()
    best_below = np.full(capacity + 1, 0)  # the longest present length up to i, 0 if none
    best_below[present] = present
    np.maximum.accumulate(best_below, out=best_below)

    def most(limit: int, n: int) -> np.ndarray:
        some = present[present <= limit]
        return some[np.argsort(-hist[some], kind="stable")[:n]]

    for a in present[::-1].tolist():
        left = capacity - a
        if left <= slack:
            out.add((a,))
            continue
        b = int(best_below[min(left, a)])
        if b and left - b <= slack:
            out.add((a, b))
        second = present[present <= min(a, left - 1)]
        third = best_below[np.minimum(left - second, second)]
        ok = (third > 0) & (left - second - third <= slack)
        scarce = np.minimum(hist[second[ok]], hist[third[ok]])
        top = np.argsort(-scarce, kind="stable")[:each]
        out.update((a, int(x), int(y)) for x, y in zip(second[ok][top], third[ok][top]))
        for x in most(min(a, left - 1), each).tolist():
            y = most(min(x, left - x - 1), each) if left - x > 1 else present[:0]
            z = best_below[np.minimum(left - x - y, y)]
            fine = (z > 0) & (left - x - y - z <= slack)
            out.update((a, x, int(y), int(z)) for y, z in zip(y[fine], z[fine]))
    return sorted(out, reverse=True)


def fit_repeats(hist: np.ndarray, patterns: list[tuple[int, ...]], tolerance: float = TOLERANCE) -> list[int]:
    """Whole repeat counts: non-negative least squares, then rounded to what the histogram holds.

    Minimises the squared difference between the histogram and the lengths
    that the patterns use, by accelerated projected gradients with restarts,
    until no coordinate's projected gradient is above tolerance pieces.
    Counts are rounded down, and then up in the order of their fractions as
    long as the histogram holds the pieces.
    """
    if not patterns:
        return []
    h, width = hist.astype(float), max(map(len, patterns))
    uses = np.zeros((len(patterns), width), dtype=np.int64)
    for k, p in enumerate(patterns):
        uses[k, : len(p)] = p
    used = (uses > 0).astype(float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(uses.ravel(), weights=(x[:, None] * used).ravel(), minlength=len(h))

    def slope(x: np.ndarray) -> np.ndarray:
        return ((forward(x) - h)[uses] * used).sum(axis=1)

    v = np.ones(len(patterns))
    for _ in range(30):  # the largest curvature
        v = (forward(v)[uses] * used).sum(axis=1)
        top = float(np.sqrt(v @ v))
        v /= top
    x = y = np.zeros(len(patterns))
    speed = 1.0
    while True:
        g = slope(y)
        new = np.maximum(0.0, y - g / (1.02 * top))
        if g @ (new - x) > 0:  # going uphill: begin again without momentum
            speed, y = 1.0, x
            g = slope(y)
            new = np.maximum(0.0, y - g / (1.02 * top))
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        y, x, speed = new + (speed - 1) / faster * (new - x), new, faster
        rest = slope(x)
        if np.abs(np.where(x > 0, rest, np.minimum(rest, 0))).max() <= tolerance:
            break
    left, out = hist.copy(), [0] * len(patterns)
    whole = np.floor(x + 1e-9)
    for extra in (False, True):
        order = np.argsort(-(x - whole), kind="stable").tolist() if extra else range(len(patterns))
        for k in order:
            n = int(x[k] > 1e-6) if extra else int(whole[k])
            if n:
                lengths, count = np.unique(patterns[k], return_counts=True)
                n = max(0, min(n, int((left[lengths] // count).min())))
                left[lengths] -= n * count
                out[k] += n
    return out


def pack_residuals(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths in a sequence, how many such sequences).

    All sequences alike are one entry, so the work follows the number of
    different lengths and fillings, not of pieces.
    """
    open_by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in np.flatnonzero(hist)[::-1].tolist():
        todo = int(hist[length])
        while todo:
            gap = next((g for g in range(length, capacity) if open_by_gap.get(g)), None)
            if gap is None:
                fit = capacity // length
                if todo >= fit:
                    open_by_gap[capacity - fit * length][(length,) * fit] += todo // fit
                    todo %= fit
                if todo:
                    open_by_gap[capacity - todo * length][(length,) * todo] += 1
                break
            content, n = next(iter(open_by_gap[gap].items()))
            fit = gap // length
            take = min(n, -(-todo // fit))
            full = min(take, todo // fit)
            if full:
                open_by_gap[gap - fit * length][content + (length,) * fit] += full
                todo -= full * fit
            part = take - full
            if part:  # the last few of this length, in one sequence
                open_by_gap[gap - todo * length][content + (length,) * todo] += 1
                todo = 0
            if n == take:
                del open_by_gap[gap][content]
            else:
                open_by_gap[gap][content] = n - take
            if not open_by_gap[gap]:
                del open_by_gap[gap]
    return [(content, n) for kinds in open_by_gap.values() for content, n in kinds.items()]


def fill_patterns(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, how many such sequences) from patterns alone.

    Patterns are enumerated and fitted again to what the last fit's rounding
    left, for as long as that places a hundredth of what was left.
    """
    left, out = hist.copy(), []
    while left.any():
        patterns = enumerate_patterns(left, capacity)
        fills = [(p, n) for p, n in zip(patterns, fit_repeats(left, patterns)) if n]
        placed = sum(len(p) * n for p, n in fills)
        before = int(left.sum())
        for p, n in fills:
            for x in p:
                left[x] -= n
        out += fills
        if 100 * placed < before:
            break
    return out


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its runs, the runs' first sequences and offsets.

    A run is one slot of all repeats of one filling: rank r of the length lies
    in the sequence first + (r - first rank).
    """
    h = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in hist.items():
        h[length] = n
    fills = fill_patterns(h, capacity)
    for p, n in fills:
        for x in p:
            h[x] -= n
    fills += pack_residuals(h, capacity)
    runs, used, first = defaultdict(list), defaultdict(int), 0
    for p, n in fills:
        at = 0
        for x in p:
            runs[x].append((used[x], first, at))
            used[x] += n
            at += x
        first += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents in pieces of capacity tokens, the last one shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = shared(tokenizer), end_id.to_bytes(4, "little")
        for ids, texts in slices(batches):
            rows = []
            for i, b in zip(ids, cache.ids(texts)):
                b = (b if cache.width == 4 else np.frombuffer(b, dtype=cache.dtype).astype("<u4").tobytes()) + end
                for k, at in enumerate(range(0, len(b), 4 * capacity)):
                    part = b[at:at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset; every piece has a length from 1 to capacity.

    pieces must be a stored table: it is read three times. Ranks within a
    length are counted in ranges of a hash first, as many as the square root
    of the number of pieces, so no task ranks all pieces of a common length.
    Equal pieces are ranked in any order and stay apart. An empty table gives
    an empty result.
    """
    hist = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(not 1 <= (x or 0) <= capacity for x in hist):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs = pieces.sparkSession.sparkContext.broadcast(plan(hist, capacity))
    ranges = max(1, math.isqrt(sum(hist.values())))
    rows = pieces.withColumn("range", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(ranges)))
    sums = rows.groupBy("length", "range").count()
    ahead = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (rows.withColumn("own", F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "piece", "start", "ids_crc32")))
              .join(sums.withColumn("ahead", ahead).drop("count"), ["length", "range"])
              .withColumn("rank", F.col("ahead") + F.col("own") - 1).select(*pieces.columns, "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = runs.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length).tolist():
                rows_of = np.flatnonzero(length == x)
                first_rank, first, at = known[x]
                k = np.searchsorted(first_rank, rank[rows_of], side="right") - 1
                sequence[rows_of], offset[rows_of] = first[k] + rank[rows_of] - first_rank[k], at[k]
            keep = [i for i, f in enumerate(batch.schema) if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)], names=[*[batch.schema[i].name for i in keep], "sequence_id", "offset"])

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of all docs packed: one row a piece, with sequence_id and offset.

    A null text is like an empty one, the end id alone. A null id is kept.
    Repeated rows are packed each. Other columns are ignored. An empty table
    gives an empty result.
    """
    return pack(materialize(cut_documents(docs, tokenizer, end_id, capacity, id_col, text_col), "pack-pieces"), capacity)


def op1_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, tokenizer).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
