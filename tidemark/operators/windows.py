"""Episode windows after an anchor, and features of the packets in a window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import safe_div, stat8
from tidemark.operators.ordered import bursts, with_bursts


def anchors_at_start(packets: DataFrame) -> DataFrame:
    """(capture_id, anchor, capture_end): each capture's first and last time."""
    return packets.groupBy("capture_id").agg(F.min("ts").alias("anchor"), F.max("ts").alias("capture_end"))


def fixed_windows(anchors: DataFrame, seconds: list[float]) -> DataFrame:
    """(capture_id, window_name, start, end, reason): anchor-relative windows, clipped to the capture."""
    names = F.array(*[F.struct(F.lit(f"w{s:g}").alias("name"), F.lit(float(s)).alias("s")) for s in seconds])
    rows = anchors.select("capture_id", "anchor", "capture_end", F.explode(names).alias("w"))
    end = F.col("anchor") + F.col("w.s")
    clipped = F.col("capture_end").isNotNull() & (end > F.col("capture_end"))
    return rows.select("capture_id", F.col("w.name").alias("window_name"), F.col("anchor").alias("start"), F.when(clipped, F.col("capture_end")).otherwise(end).alias("end"), F.when(clipped, "clipped_by_capture").otherwise("full").alias("reason"))


def _post(packets: DataFrame, anchors: DataFrame, most_s: float) -> DataFrame:
    """Packets from the anchor to its hard end, with both."""
    a = anchors.withColumn("hard_end", F.least(F.col("anchor") + most_s, F.coalesce("capture_end", F.col("anchor") + most_s)))
    return packets.join(a, "capture_id").where(F.col("ts").between(F.col("anchor"), F.col("hard_end")))


def dynamic_window(packets: DataFrame, anchors: DataFrame, least_s: float = 15.0, most_s: float = 90.0, gap_s: float = 0.35, idle_s: float = 5.0, tail_s: float = 0.25, least_pkts: int = 4, least_bytes: int = 1024) -> DataFrame:
    """(capture_id, start, end, reason): ends after the first significant burst past least_s that an idle gap follows.

    Reasons: no_post_packets, no_significant_burst, idle_gap, last_burst,
    capture_stop_after_last_burst, capture_stop_before_min_window, min_window.
    """
    a = anchors.withColumn("hard_end", F.least(F.col("anchor") + most_s, F.coalesce("capture_end", F.col("anchor") + most_s)))
    post = _post(packets, anchors, most_s)
    sig = bursts(post, gap_s).where((F.col("n_pkts") >= least_pkts) | (F.col("bytes_total") >= least_bytes))
    sig = sig.withColumn("next", F.lead("start").over(Window.partitionBy("capture_id").orderBy("start")))
    sig = sig.join(a.select("capture_id", "anchor"), "capture_id")
    ends = sig.where((F.col("end") - F.col("anchor") >= least_s) & (F.col("next").isNull() | (F.col("next") - F.col("end") >= idle_s)))
    hit = ends.groupBy("capture_id").agg(F.min(F.struct("end", "next")).alias("hit"))
    some = sig.groupBy("capture_id").agg(F.count("*").alias("n_sig"))
    last = post.groupBy("capture_id").agg(F.max("ts").alias("last_ts"))
    rows = a.join(last, "capture_id", "left").join(some, "capture_id", "left").join(hit, "capture_id", "left")
    at = F.least("hard_end", F.col("hit.end") + tail_s)
    stop = F.col("hit.next").isNull() & F.coalesce(F.col("capture_end") <= at + idle_s, F.lit(False))
    short = F.coalesce(F.col("capture_end") <= F.col("anchor") + least_s, F.lit(False))
    none, quiet, found = F.col("last_ts").isNull(), F.col("n_sig").isNull(), F.col("hit").isNotNull()
    end = (F.when(none, F.col("hard_end")).when(quiet, F.least("hard_end", F.col("last_ts") + tail_s)).when(found & stop, F.col("hard_end")).when(found, at)
           .when(short, F.col("hard_end")).otherwise(F.least("hard_end", F.col("anchor") + least_s)))
    reason = (F.when(none, "no_post_packets").when(quiet, "no_significant_burst").when(found & stop, "capture_stop_after_last_burst").when(found & F.col("hit.next").isNull(), "last_burst")
              .when(found, "idle_gap").when(short, "capture_stop_before_min_window").otherwise("min_window"))
    return rows.select("capture_id", F.col("anchor").alias("start"), end.alias("end"), reason.alias("reason"))


def adaptive_window(packets: DataFrame, anchors: DataFrame, important: list[str], nuisance: list[str], least_s: float = 1.25, most_s: float = 14.0, gap_s: float = 0.35, idle_s: float = 0.9, tail_s: float = 0.1,
                    least_pkts: int = 4, least_bytes: int = 1200, least_important: int = 900, full_bytes: int = 12000, full_share: float = 0.4) -> DataFrame:
    """(capture_id, start, end, reason): closes when gathered evidence is full or the traffic idles.

    Evidence are running sums over the bursts; the first burst at whose end
    there is enough, and which is full, last or followed by an idle gap, closes.
    """
    most_s = max(0.25, most_s)
    a = anchors.withColumn("hard_end", F.least(F.col("anchor") + most_s, F.coalesce("capture_end", F.col("anchor") + most_s)))
    post = _post(packets, anchors, most_s)
    role = F.lower(F.coalesce("role", F.lit("unknown")))
    rows = post.withColumn("imp", F.when(role.isin(important), F.col("length")).otherwise(0)).withColumn("nui", F.when(role.isin(nuisance), F.col("length")).otherwise(0))
    per = with_bursts(rows, gap_s).groupBy("capture_id", "anchor", "hard_end", "burst_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum("imp").alias("imp"), F.sum("nui").alias("nui"))
    w = Window.partitionBy("capture_id").orderBy("burst_no")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    for c in ("n", "bytes", "imp", "nui"):
        per = per.withColumn(f"c_{c}", F.sum(c).over(run))
    stop = F.greatest(F.col("end") + tail_s, F.col("anchor") + least_s)
    per = per.withColumn("next", F.lead("start").over(w)).withColumn("stop", stop).withColumn("over", F.max(F.when(stop > F.col("hard_end"), 1).otherwise(0)).over(run))
    enough = (F.col("c_n") >= least_pkts) & (F.col("c_bytes") >= least_bytes) & (F.col("c_imp") >= least_important)
    full = (F.col("c_bytes") >= full_bytes) & (F.col("c_imp") / F.col("c_bytes") >= full_share) & (F.col("c_nui") / F.col("c_bytes") < 0.8)
    closes = per.where((F.col("over") == 0) & enough & (full | F.col("next").isNull() | (F.col("next") - F.col("end") >= idle_s)))
    waited = F.least(F.greatest("stop", F.col("end") + idle_s), F.col("hard_end"))
    closes = closes.withColumn("at", F.when(full, F.least("stop", "hard_end")).otherwise(waited)).withColumn("why", F.when(full, "saturated").when(F.col("next").isNull(), "last_burst_idle").otherwise("idle_gap"))
    hit = closes.groupBy("capture_id").agg(F.min(F.struct("burst_no", "at", "why")).alias("hit"))
    last = post.groupBy("capture_id").agg(F.max("ts").alias("last_ts"))
    out = a.join(last, "capture_id", "left").join(hit, "capture_id", "left")
    weak = F.least(F.greatest(F.col("anchor") + least_s, F.col("last_ts") + tail_s), F.col("hard_end"))
    end = F.when(F.col("last_ts").isNull(), F.col("hard_end")).when(F.col("hit").isNotNull(), F.col("hit.at")).otherwise(weak)
    reason = F.when(F.col("last_ts").isNull(), "no_post_packets").when(F.col("hit").isNotNull(), F.col("hit.why")).otherwise("weak_evidence")
    return out.select("capture_id", F.col("anchor").alias("start"), end.alias("end"), reason.alias("reason"))


def in_windows(packets: DataFrame, windows: DataFrame) -> DataFrame:
    """A row for each packet in each window of its capture, both bounds included: an equi-join on the capture with the range as its condition."""
    w = windows.withColumnsRenamed({"start": "w_start", "end": "w_end"})
    return packets.join(w, "capture_id").where(F.col("ts").between(F.col("w_start"), F.col("w_end")))


def base_features(packets: DataFrame, windows: DataFrame, active_bin_s: float = 1.0) -> DataFrame:
    """Counts, rates, activity, gaps and sizes of each window; windows without packets have zeros."""
    key = ["capture_id", "window_name"]
    rows = in_windows(packets, windows)
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy(*key).orderBy("ts", "event_id"))
    rows = rows.withColumn("gap", gap).withColumn("bin", F.floor((F.col("ts") - F.col("w_start")) / active_bin_s))
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    agg = rows.groupBy(*key).agg(
        F.count("*").alias("n_pkts"), F.countDistinct("flow_id").alias("n_flows"), F.sum("length").cast("long").alias("bytes"),
        F.coalesce(F.sum(F.when(up, F.col("length"))), F.lit(0)).cast("long").alias("bytes_up"), F.coalesce(F.sum(F.when(down, F.col("length"))), F.lit(0)).cast("long").alias("bytes_down"),
        F.count_if(up).alias("pkts_up"), F.count_if(down).alias("pkts_down"), F.countDistinct("bin").alias("bins"),
        F.count_if(F.col("length") >= 1000).alias("large"), F.count_if(F.col("length") <= 80).alias("small"),
        *stat8(F.col("gap"), "iat"), *stat8(F.col("length"), "size"))
    out = windows.select(*key, (F.col("end") - F.col("start")).alias("duration")).join(agg, key, "left").na.fill(0)
    return out.withColumns({
        "up_ratio": safe_div(F.col("bytes_up"), F.col("bytes")), "pkt_rate": safe_div(F.col("n_pkts"), F.col("duration")), "byte_rate": safe_div(F.col("bytes"), F.col("duration")),
        "active_s": F.col("bins") * F.lit(float(active_bin_s)), "large_frac": safe_div(F.col("large"), F.col("n_pkts")), "small_frac": safe_div(F.col("small"), F.col("n_pkts"))}).drop("bins", "large", "small")


def flow_records(packets: DataFrame) -> DataFrame:
    """Per flow: first, last, duration, bytes, packets and the commonest role, that seen first among equals."""
    roles = packets.groupBy("capture_id", "flow_id", "role").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    top = roles.groupBy("capture_id", "flow_id").agg(F.min_by("role", F.struct(-F.col("n"), "first")).alias("main_role"))
    per = packets.groupBy("capture_id", "flow_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_pkts"), F.sum("length").cast("long").alias("bytes"),
                                                       F.coalesce(F.sum(F.when(F.col("direction") == "up", F.col("length"))), F.lit(0)).cast("long").alias("bytes_up"))
    return per.join(top, ["capture_id", "flow_id"]).withColumn("duration", F.col("last_ts") - F.col("first_ts"))


def concurrent_flows(packets: DataFrame, bin_s: float = 1.0) -> DataFrame:
    """Per capture the largest and the mean number of flows over the time bins that any flow occupies.

    A flow makes two rows, in the bin it opens and after that it closes in; what
    is open after the steps of a bin stays so to the next step, so bins are
    counted and not made.
    """
    per = packets.groupBy("capture_id", "flow_id").agg(F.floor(F.min("ts") / bin_s).alias("a"), F.floor(F.max("ts") / bin_s).alias("z"))
    steps = F.array(F.struct(F.col("a").alias("bin"), F.lit(1).alias("d")), F.struct((F.col("z") + 1).alias("bin"), F.lit(-1).alias("d")))
    each = per.where("a is not null").select("capture_id", F.explode(steps).alias("s")).groupBy("capture_id", "s.bin").agg(F.sum("s.d").alias("d"))
    w = Window.partitionBy("capture_id").orderBy("bin")
    each = each.withColumn("open", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("bins", F.lead("bin").over(w) - F.col("bin")).where("open > 0")
    return each.groupBy("capture_id").agg(F.max("open").alias("max_flows"), (F.sum(F.col("open") * F.col("bins")) / F.sum("bins")).alias("mean_flows"))


def post_load_end(packets: DataFrame, bin_s: float, loud_rate: float, quiet_s: float, cap_s: float, least_bytes: int) -> DataFrame:
    """(capture_id, load_end): the end of the last loud bin before the first quiet run of quiet_s, once least_bytes were seen; the cap where there is none."""
    start = packets.groupBy("capture_id").agg(F.min("ts").alias("t0"))
    rows = packets.join(start, "capture_id").withColumn("bin", F.floor((F.col("ts") - F.col("t0")) / bin_s)).where(F.col("bin") * bin_s < cap_s)
    per = rows.groupBy("capture_id", "bin").agg(F.sum("length").alias("bytes"))
    loud = per.withColumn("seen", F.sum("bytes").over(Window.partitionBy("capture_id").orderBy("bin"))).where(F.col("bytes") >= loud_rate * bin_s)
    after = F.lead("bin").over(Window.partitionBy("capture_id").orderBy("bin"))
    quiet = (F.coalesce("after", F.lit(2**40)) - F.col("bin") - 1) * bin_s >= quiet_s
    hit = loud.withColumn("after", after).where(quiet & (F.col("seen") >= least_bytes)).groupBy("capture_id").agg(F.min("bin").alias("bin"))
    return start.join(hit, "capture_id", "left").select("capture_id", F.when(F.col("bin").isNull(), F.col("t0") + cap_s).otherwise(F.least(F.col("t0") + (F.col("bin") + 1) * bin_s, F.col("t0") + cap_s)).alias("load_end"))
