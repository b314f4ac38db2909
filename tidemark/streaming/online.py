"""Causal operators over streams of packet-like rows, with event-time watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_bursts(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Bursts by Spark's session window, closed when the watermark passes. As in bursts(), a gap equal to the limit stays."""
    return (events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
            .agg(F.count("*").alias("n_pkts"), F.sum("length").cast("long").alias("bytes_total"))
            .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_pkts", "bytes_total"))


def exact_bursts(events: DataFrame, key: str, gap_s: float, late: str, ts: str = "ts") -> DataFrame:
    """Bursts with the batch rule: only a gap over gap_s splits. One open burst a key is the state; it is emitted when the watermark is gap_s past its end.

    events: (key, ts timestamp, length). Rows of a batch are sorted within
    their key; rows later than the watermark are dropped by Spark.
    """
    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        held = list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], *held)], columns=["key", "start", "end", "n_pkts", "bytes_total"])
            return
        rows = pd.concat(list(frames)).sort_values("t")
        for t, size in zip(rows["t"], rows["length"]):
            if held is not None and held[0] - gap_s <= t <= held[1] + gap_s:
                held = [min(held[0], t), max(held[1], t), held[2] + 1, held[3] + int(size)]
            elif held is None or t > held[1]:
                if held is not None:
                    out.append((k[0], *held))
                held = [float(t), float(t), 1, int(size)]
            else:  # out of order and apart from the open burst
                out.append((k[0], float(t), float(t), 1, int(size)))
        state.update(tuple(held))
        due = int(held[1] * 1000 + gap_s * 1000) + 1
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "start", "end", "n_pkts", "bytes_total"])

    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("at"), (F.unix_micros(ts) / 1e6).alias("t"), F.col("length").cast("long").alias("length"))
    return rows.groupBy("key").applyInPandasWithState(step, "key long, start double, end double, n_pkts long, bytes_total long", "start double, end double, n long, bytes long", "append", GroupStateTimeout.EventTimeTimeout)


def topk_alerts(scored: DataFrame, key: str, k: int, threshold: float, late: str, ts: str = "ts") -> DataFrame:
    """The first time at which the mean of a key's two best scores so far, of its k best, reaches threshold; at most one alert a key.

    The state is k scores and whether the alert was given, whatever the
    stream's length.
    """
    def step(g: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, given = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
        out = []
        for t, s in pd.concat(list(frames)).sort_values(["t", "score"])[["t", "score"]].itertuples(index=False):
            best = sorted([*best, float(s)], reverse=True)[:k]
            if not given and len(best) > 1 and (best[0] + best[1]) / 2 >= threshold:
                out.append((g[0], float(t), (best[0] + best[1]) / 2))
                given = True
        state.update((best, given))
        yield pd.DataFrame(out, columns=["key", "ts", "pooled"])

    rows = scored.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts).alias("at"), (F.unix_micros(ts) / 1e6).alias("t"), "score")
    return rows.groupBy("key").applyInPandasWithState(step, "key long, ts double, pooled double", "best array<double>, given boolean", "append", GroupStateTimeout.NoTimeout)
