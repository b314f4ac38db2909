"""Order-dependent replays of scored candidates. A null score counts as lower than every score."""

from __future__ import annotations

import bisect
import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import Scan, ordered_scan

_ARRIVAL = ["ts", "candidate_id", "score"]


def _low(score: float | None) -> float:
    return -math.inf if score is None else score


class _Admitted(Scan):
    def __init__(self, k: int):
        self.k, self.best = k, []

    def step(self, ident, score):
        took, score = len(self.best) < self.k, _low(score)
        if took:
            heapq.heappush(self.best, score)
        elif self.k and self.best[0] < score:
            took = True
            heapq.heapreplace(self.best, score)
        return ((ident, took),)


def ever_admitted(rows: DataFrame, k: int, session: str = "session_id") -> DataFrame:
    """(session, candidate_id, admitted): whether fewer than k earlier arrivals had a score as high, so that a heap of the k best took it.

    The state is that heap.
    """
    return ordered_scan(rows, session, ["candidate_id", "score"], _ARRIVAL, lambda: _Admitted(k), "candidate_id long, admitted boolean")


class _Alert(Scan):
    def __init__(self, k: int, threshold: float):
        self.k, self.threshold, self.best, self.peak, self.at = min(k, 2), threshold, [], -1.0, None

    def step(self, ts, score):
        self.best = sorted([*self.best, _low(score)], reverse=True)[: self.k]
        pooled = sum(self.best) / 2 if len(self.best) == 2 else -1.0
        self.peak = max(self.peak, pooled)
        if self.at is None and pooled >= self.threshold:
            self.at = ts
        return ()

    def end(self):
        return ((self.peak, self.at),)


def earliest_alert(rows: DataFrame, k: int, threshold: float, session: str = "session_id") -> DataFrame:
    """(session, peak, alert_ts): the largest mean of the two best scores so far (-1 before the second), and when it first reached threshold.

    Of the k best only the two best are ever pooled, so these are the state.
    """
    return ordered_scan(rows, session, ["ts", "score"], _ARRIVAL, lambda: _Alert(k, threshold), "peak double, alert_ts double")


class _Spread(Scan):
    def __init__(self, gap_s: float):
        self.gap_s, self.times, self.passed = gap_s, [], 0

    def step(self, ident, ts):
        at = bisect.bisect_left(self.times, ts)
        near = any(abs(self.times[i] - ts) < self.gap_s for i in (at - 1, at) if 0 <= i < len(self.times))
        if near:
            self.passed += 1
            return ((ident, False, self.passed),)
        self.times.insert(at, ts)
        return ((ident, True, len(self.times)),)


def diverse_rank(rows: DataFrame, gap_s: float, session: str = "session_id") -> DataFrame:
    """(session, candidate_id, rank): by falling score, but each next one at least gap_s from all taken while there is such a one.

    What is too near once stays so: one pass in order takes the spread ones,
    the rest follow in order. The state is the sorted times of those taken, at
    most span / gap_s + 1 a session; a new time meets its two neighbours only.
    """
    out = ordered_scan(rows, session, ["candidate_id", "ts"], [-F.col("score"), "ts", "candidate_id"], lambda: _Spread(gap_s), "candidate_id long, spread boolean, place long")
    taken = F.count_if("spread").over(Window.partitionBy(session))
    return out.select(session, "candidate_id", F.when(F.col("spread"), F.col("place")).otherwise(taken + F.col("place")).alias("rank"))


class _Merged(Scan):
    def __init__(self, merge_s: float):
        self.merge_s, self.at, self.n = merge_s, None, 0

    def step(self, ts):
        if self.n and ts - self.at <= self.merge_s:
            self.n += 1
            return ()
        done = self.end()
        self.at, self.n = ts, 1
        return done

    def end(self):
        return ((self.at, self.n),) if self.n else ()


def merge_boundaries(rows: DataFrame, merge_s: float, session: str = "session_id") -> DataFrame:
    """(session, ts, merged): boundaries within merge_s of the first kept one join it."""
    return ordered_scan(rows, session, ["ts"], ["ts"], lambda: _Merged(merge_s), "ts double, merged long")


def as_of(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """left (key, ts, candidate_id) with the value of the last right (key, ts, value) at or before ts: one union and one window, no join."""
    both = left.select(key, "ts", "candidate_id", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(right.select(key, "ts", F.lit(None).cast("long").alias("candidate_id"), value, F.lit(0).alias("side")))
    w = Window.partitionBy(key).orderBy("ts", "side", value).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").select(key, "ts", "candidate_id", value)
