"""Site-open boundaries, block-wise suppression, anchors and addresses of captures."""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp
from tidemark.operators.ordered import bursts
from tidemark.operators.scan import Scan, ordered_scan


def site_opens(packets: DataFrame, identity: str, merge_s: float, look_s: float, past_s: float, least_new: int = 1, least_flows: int = 2, least_bytes: int = 900, quiet_norm: float = 20000.0) -> DataFrame:
    """(capture_id, ts, novelty, flows, bytes, quiet): groups of first sightings of an identity that open enough flows and bytes.

    A group goes on while the next first sighting is within merge_s of the
    last one. Flows count that begin in [ts, ts + look_s], bytes those in
    [ts, ts + look_s), quiet falls with the bytes of [ts - past_s, ts).
    """
    first = packets.groupBy("capture_id", identity).agg(F.min("ts").alias("ts"))
    w = Window.partitionBy("capture_id").orderBy("ts", identity)
    rows = first.withColumn("new", F.when(F.col("ts") - F.lag("ts").over(w) <= merge_s, 0).otherwise(1)).withColumn("grp", F.sum("new").over(w))
    groups = rows.groupBy("capture_id", "grp").agg(F.min("ts").alias("g"), F.count("*").alias("novelty")).where(F.col("novelty") >= least_new).select("capture_id", "g", "novelty")
    # packets and flow starts meet only the groups whose span touches their cell of time
    cell = float(past_s + look_s)
    spans = groups.select("capture_id", "g", F.explode(F.sequence(F.floor((F.col("g") - past_s) / cell), F.floor((F.col("g") + look_s) / cell))).alias("cell"))

    def near(rows: DataFrame, ts: str) -> DataFrame:
        return rows.withColumn("cell", F.floor(F.col(ts) / cell)).join(spans, ["capture_id", "cell"])

    flows = near(packets.groupBy("capture_id", "flow_id").agg(F.min("ts").alias("f")), "f").where((F.col("f") >= F.col("g")) & (F.col("f") <= F.col("g") + look_s)).groupBy("capture_id", "g").agg(F.count("*").alias("flows"))
    met = near(packets.select("capture_id", "ts", "length"), "ts").where((F.col("ts") >= F.col("g") - past_s) & (F.col("ts") < F.col("g") + look_s))
    after = F.col("ts") >= F.col("g")
    traffic = met.groupBy("capture_id", "g").agg(F.coalesce(F.sum(F.when(after, F.col("length"))), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(F.when(~after, F.col("length"))), F.lit(0)).cast("long").alias("past"))
    found = groups.join(flows, ["capture_id", "g"]).join(traffic, ["capture_id", "g"]).where((F.col("flows") >= least_flows) & (F.col("bytes") >= least_bytes))
    return found.select("capture_id", F.col("g").alias("ts"), "novelty", "flows", "bytes", clamp(1 - F.col("past") / quiet_norm, 0, 1).alias("quiet"))


class _Blocks(Scan):
    """Candidates by time; carried and buffered are those that a later block, or this one, may still suppress."""

    def __init__(self, merge_s: float, block_s: float):
        self.merge_s, self.block_s, self.t0, self.block, self.items, self.carry = merge_s, block_s, None, None, [], []

    def _emit(self, kept: list, before: float):
        self.carry = [x for x in kept if x[1] >= before]
        return [(t, ident, score, self.t0) for _, t, ident, score in kept if t < before]

    def _close(self):
        kept, times = [], []
        for x in sorted(self.carry + self.items, key=lambda x: x[:3]):
            i = bisect.bisect_left(times, x[1])
            if not any(abs(times[j] - x[1]) <= self.merge_s for j in (i - 1, i) if 0 <= j < len(times)):
                times.insert(i, x[1])
                kept.append(x)
        self.items = []
        return self._emit(kept, self.t0 + (self.block + 1) * self.block_s - self.merge_s)

    def step(self, event_id, ts, score):
        out = []
        if self.t0 is None:
            self.t0, self.block = ts, 0
        block = math.floor((ts - self.t0) / self.block_s)
        if block != self.block:
            out = self._close()
            self.block = block
            # blocks without candidates end too: what they would let go of is let go of before
            out += self._emit(self.carry, self.t0 + block * self.block_s - self.merge_s)
        self.items.append((math.inf if score is None else -score, ts, event_id, score))
        return out

    def end(self):
        return self._close() + self._emit(self.carry, math.inf)


def suppress_in_blocks(candidates: DataFrame, merge_s: float, block_s: float, delay_s: float) -> DataFrame:
    """(capture_id, rank, event_id, ts, score, emit_ts): greedy suppression block by block, as a causal reader can do it.

    At a block's end, what was carried and what came in the block are
    suppressed together, null scores last. Survivors within merge_s of the end
    are carried on; earlier ones are emitted, suppressed ones forgotten. Ranks
    follow time. emit_ts is no earlier than ts + merge_s + delay_s. A scan by
    time whose state is one block's candidates and what is carried.
    """
    out = ordered_scan(candidates, "capture_id", ["event_id", "ts", "score"], ["ts", "event_id"], lambda: _Blocks(merge_s, block_s), "ts double, event_id long, score double, t0 double")
    rank = F.row_number().over(Window.partitionBy("capture_id").orderBy("ts", "event_id")).cast("long")
    block_end = F.col("t0") + (F.floor((F.col("ts") - F.col("t0")) / block_s) + 1) * F.lit(float(block_s))
    return out.select("capture_id", rank.alias("rank"), "event_id", "ts", "score", F.greatest(block_end, F.col("ts") + merge_s + delay_s).alias("emit_ts"))


def jitter_anchors(anchors: DataFrame, offsets: list[float]) -> DataFrame:
    """(capture_id, rank, ts): the reference anchor with rank 0 and shifted ones from 901 on, held within the capture."""
    items = F.array(F.struct(F.lit(0).alias("rank"), F.lit(0.0).alias("d")), *[F.struct(F.lit(901 + i).alias("rank"), F.lit(float(d)).alias("d")) for i, d in enumerate(offsets)])
    return anchors.select("capture_id", "anchor", "capture_start", "capture_end", F.explode(items).alias("x")).select("capture_id", F.col("x.rank").alias("rank"), F.greatest("capture_start", F.least("capture_end", F.col("anchor") + F.col("x.d"))).alias("ts"))


def capture_end(declared: Column, observed: Column, slack_s: float = 2.0) -> Column:
    """The declared end, or the observed one where it is missing, 0, later than observed by over slack_s, or before it."""
    ok = declared.isNotNull() & (declared != 0) & (declared >= observed) & (declared <= observed + slack_s)
    return F.when(ok, declared).otherwise(observed)


def is_private(ip: Column) -> Column:
    """Private IPv4 and IPv6 ranges, loopback and link-local."""
    return F.coalesce(ip.rlike(r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)|^(?i)(f[cd]|fe[89ab]|::1$)"), F.lit(False))


def local_address(packets: DataFrame, capture: str = "capture_id") -> DataFrame:
    """(capture, ip): the private address seen most, else the one that opens most TCP connections, else the commonest; the smallest among equals."""
    ends = packets.select(capture, F.explode(F.array(F.struct(F.col("src_ip").alias("ip"), ((F.col("tcp_flags").bitwiseAND(18)) == 2).alias("opens")), F.struct(F.col("dst_ip").alias("ip"), F.lit(False).alias("opens")))).alias("e")).select(capture, "e.ip", "e.opens")
    per = ends.groupBy(capture, "ip").agg(F.count("*").alias("n"), F.count_if("opens").alias("opens"))
    order = F.struct((~is_private(F.col("ip"))).alias("a"), F.when(is_private(F.col("ip")), F.lit(0)).otherwise(-F.col("opens")).alias("b"), (-F.col("n")).alias("c"), F.col("ip").alias("d"))
    return per.groupBy(capture).agg(F.min_by("ip", order).alias("ip"))


def with_direction(packets: DataFrame, capture: str = "capture_id") -> DataFrame:
    """packets with direction: up from the local address, down to it, else from the port that is not well known."""
    local = local_address(packets, capture).withColumnRenamed("ip", "_local")
    rows = packets.join(local, capture, "left")
    d = F.when(F.col("src_ip") == F.col("_local"), "up").when(F.col("dst_ip") == F.col("_local"), "down").when(F.col("dst_port").isin(80, 443, 53), "up").when(F.col("src_port").isin(80, 443, 53), "down").otherwise("unknown")
    return rows.withColumn("direction", d).drop("_local")


def units(packets: DataFrame, gap_s: float, span_s: float) -> DataFrame:
    """(capture_id, unit_no, start, end, n_pkts, bytes_total): bursts merged while the gap is at most gap_s and the unit no longer than span_s.

    A fold over a capture's packets grouped into bursts of gap_s first, so its
    steps are bursts.
    """
    b = bursts(packets, gap_s / 4)
    per = b.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("a"), F.col("end").alias("z"), F.col("n_pkts").alias("n"), F.col("bytes_total").alias("b")))).alias("e"))
    kind = "array<struct<a:double,z:double,n:bigint,b:bigint>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["a"] - last["z"] <= gap_s) & (x["z"] - last["a"] <= span_s)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), x["z"].alias("z"), (last["n"] + x["n"]).alias("n"), (last["b"] + x["b"]).alias("b"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(x)))

    out = per.select("capture_id", F.posexplode(F.aggregate("e", F.array().cast(kind), step)).alias("unit_no", "u"))
    return out.select("capture_id", F.col("unit_no").cast("long").alias("unit_no"), F.col("u.a").alias("start"), F.col("u.z").alias("end"), F.col("u.n").alias("n_pkts"), F.col("u.b").alias("bytes_total"))


def causal_audit(candidates: DataFrame, merge_s: float) -> DataFrame:
    """One row: whether candidates are unique, apart by merge_s, emitted after they start, and ranked by time."""
    w = Window.partitionBy("capture_id").orderBy("rank")
    rows = candidates.withColumn("prev", F.lag("ts").over(w)).withColumn("copies", F.count("*").over(Window.partitionBy("capture_id", "rank")))
    return rows.agg(F.count("*").alias("n"), F.bool_and(F.col("copies") == 1).alias("unique"), F.bool_and(F.col("prev").isNull() | (F.col("ts") - F.col("prev") >= -1e-7)).alias("chronological"), F.bool_and(F.col("emit_ts") >= F.col("ts") + merge_s).alias("emitted_after"))
