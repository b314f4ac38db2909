"""Ordered computations on packet-like rows: bursts, gaps, positions and running values.

Rows have capture_id, ts (seconds), length, direction and an event_id that
breaks ties of ts. Every window is partitioned by capture or flow.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp
from tidemark.operators.scan import Scan, ordered_scan


def by_time(*keys: str):
    return Window.partitionBy(*(keys or ("capture_id",))).orderBy("ts", "event_id")


def with_bursts(packets: DataFrame, gap_s: float, *keys: str) -> DataFrame:
    """packets with burst_no: a new burst begins where the gap is over gap_s; an equal gap stays."""
    keys = keys or ("capture_id",)
    new = F.when(F.col("ts") - F.lag("ts").over(by_time(*keys)) > gap_s, 1).otherwise(0)
    return packets.withColumn("_new", new).withColumn("burst_no", F.sum("_new").over(by_time(*keys)).cast("long")).drop("_new")


def bursts(packets: DataFrame, gap_s: float, *keys: str) -> DataFrame:
    """One row a burst: start, end, n_pkts, bytes_total."""
    keys = keys or ("capture_id",)
    return with_bursts(packets, gap_s, *keys).groupBy(*keys, "burst_no").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_pkts"), F.sum("length").cast("long").alias("bytes_total"))


def _sized(packets: DataFrame) -> DataFrame:
    """packets with log_len, the log of the payload's length or else the packet's, and iat, the gap to the packet before, 0 at the start."""
    size = F.when(F.col("payload_len") > 0, F.col("payload_len")).otherwise(F.col("length"))
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(by_time()), F.lit(0.0))
    return packets.withColumn("log_len", F.log1p(size.cast("double"))).withColumn("iat", F.greatest(F.lit(0.0), gap))


_SHAPE = ["event_id", "log_len", "diff", "iat", "rel_iat", "rel_time"]


class _Median(Scan):
    """The lower half of the values so far as a heap of negatives, the upper half as a heap."""

    def __init__(self):
        self.low, self.high = [], []

    def step(self, event_id, x, *rest):
        if x is not None:
            heapq.heappush(self.high, -heapq.heappushpop(self.low, -x))
            if len(self.high) > len(self.low):
                heapq.heappush(self.low, -heapq.heappop(self.high))
        if not self.low:
            med = None
        else:
            med = -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2
        return ((event_id, x, *rest, med),)


def shape_rows(packets: DataFrame) -> DataFrame:
    """Per packet: log length, its running median and offset, first difference, clipped inter-arrival time and its scale, relative time.

    Length is the payload where there is one. Times count from the capture's
    first packet; the scale is the median positive gap, 1 where there is none.
    The running median is a scan with two heaps, a logarithmic step a packet;
    its state is the lengths of one capture.
    """
    whole = Window.partitionBy("capture_id")
    rows = _sized(packets).withColumn("start", F.min("ts").over(whole)).withColumn("dur", F.max("ts").over(whole) - F.col("start"))
    rows = rows.withColumn("diff", F.coalesce(F.col("log_len") - F.lag("log_len").over(by_time()), F.lit(0.0)))
    scale = F.coalesce(F.percentile(F.when(F.col("iat") > 1e-6, F.col("iat")), F.lit(0.5)).over(whole), F.lit(1.0))
    rows = rows.withColumn("rel_iat", clamp(F.col("iat") / scale, 0, 20)).withColumn("rel_time", clamp((F.col("ts") - F.col("start")) / F.greatest(F.col("dur"), F.lit(1e-6)), 0, 1))
    doubles = ", ".join(f"{c} double" for c in [*_SHAPE[1:], "running_median"])
    out = ordered_scan(rows, "capture_id", _SHAPE, ["ts", "event_id"], _Median, f"event_id long, {doubles}")
    return out.withColumn("offset", F.col("log_len") - F.col("running_median"))


def direction_code(direction: Column) -> Column:
    return F.when(direction == "up", 1).when(direction == "down", -1).otherwise(0)


def switches(packets: DataFrame) -> DataFrame:
    """Per capture: direction changes, up-to-down changes, and both over the number of adjacent pairs."""
    before = F.lag("direction").over(by_time())
    rows = packets.withColumn("before", before)
    pairs = F.count("before")
    changed, turned = F.count_if(F.col("before") != F.col("direction")), F.count_if((F.col("before") == "up") & (F.col("direction") == "down"))
    return rows.groupBy("capture_id").agg(changed.alias("n_switches"), turned.alias("n_up_down"), F.coalesce(F.try_divide(changed, pairs), F.lit(0.0)).alias("switch_rate"))


def first_n(packets: DataFrame, n: int) -> DataFrame:
    return packets.withColumn("pos", F.row_number().over(by_time())).where(F.col("pos") <= n)


def prefix_pivot(packets: DataFrame, n: int, value: str = "length") -> DataFrame:
    """Columns view_0 .. view_{n-1}: the value at each of the first n places, 0 beyond the end."""
    return first_n(packets, n).groupBy("capture_id").agg(*[F.coalesce(F.max(F.when(F.col("pos") == i + 1, F.col(value))), F.lit(0)).cast("double").alias(f"view_{i}") for i in range(n)])


def length_gap_correlation(packets: DataFrame) -> DataFrame:
    """Per capture the correlation of log length and gap; 0 with fewer than 3 rows or no spread."""
    rows = _sized(packets)
    r = F.corr("log_len", "iat")
    ok = (F.count("*") >= 3) & (F.stddev_pop("log_len") > 1e-9) & (F.stddev_pop("iat") > 1e-9)
    return rows.groupBy("capture_id").agg(F.when(ok, r).otherwise(0.0).alias("len_iat_corr"))


def first_seen(packets: DataFrame, key: str) -> DataFrame:
    return packets.groupBy("capture_id", key).agg(F.min("ts").alias("first_ts"))


def reactivations(packets: DataFrame, key: str, quiet_s: float) -> DataFrame:
    """Rows at which a key is seen first, or again after quiet_s or more."""
    gap = F.col("ts") - F.lag("ts").over(by_time("capture_id", key))
    return packets.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= quiet_s)).select("capture_id", key, "event_id", "ts", F.col("gap").isNotNull().alias("again"))


class _Kept(Scan):
    def __init__(self, merge_s: float, top_k: int):
        self.merge_s, self.top_k, self.times = merge_s, top_k, []

    def step(self, event_id, ts, score):
        if len(self.times) >= self.top_k or any(abs(t - ts) <= self.merge_s for t in self.times):
            return ()
        self.times.append(ts)
        return ((len(self.times), event_id, ts, score),)


def suppress_near(candidates: DataFrame, merge_s: float, top_k: int) -> DataFrame:
    """Greedy suppression: by falling score, then time, a candidate is kept if no kept one is within merge_s; at most top_k, ranked from 1.

    A scan of each capture's candidates in that order (null scores last), with
    the times kept, top_k at most, as its state.
    """
    return ordered_scan(candidates, "capture_id", ["event_id", "ts", "score"], [-F.col("score"), "ts", "event_id"], lambda: _Kept(merge_s, top_k), "rank long, event_id long, ts double, score double")


def fanout(packets: DataFrame, window_s: float, least_flows: int) -> DataFrame:
    """Flows that start a fan-out: least_flows or more flows begin within window_s at or after their start.

    A range join of flow starts bucketed by window_s, so a capture's flows
    meet only those of the same or the next bucket.
    """
    starts = packets.groupBy("capture_id", "flow_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("capture_id", "flow_id", F.col("f.ts").alias("ts"), F.col("f.event_id").alias("event_id"))
    b = F.floor(F.col("ts") / window_s)
    left = starts.select("capture_id", "flow_id", "ts", "event_id", F.explode(F.array(b, b + 1)).alias("cell"))
    right = starts.select(F.col("capture_id").alias("c"), F.col("ts").alias("t"), F.col("event_id").alias("e"), b.alias("k"))
    later = (F.col("t") > F.col("ts")) | ((F.col("t") == F.col("ts")) & (F.col("e") >= F.col("event_id")))
    met = left.join(right, (F.col("capture_id") == F.col("c")) & (F.col("cell") == F.col("k")) & later & (F.col("t") <= F.col("ts") + window_s))
    return met.groupBy("capture_id", "flow_id").agg(F.count("*").alias("n_within")).where(F.col("n_within") >= least_flows)
