"""Role shares of windows: per role, per overlapping group, phases, entropy and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import safe_div


def role_shares(packets: DataFrame, roles: list[str], key: str = "capture_id") -> DataFrame:
    """Byte, packet and flow fractions for each role of a fixed list, one column each."""
    aggs = [F.sum("length").cast("long").alias("bytes"), F.count("*").alias("pkts"), F.countDistinct("flow_id").alias("flows")]
    for r in roles:
        mine = F.col("role") == r
        aggs += [F.coalesce(F.sum(F.when(mine, F.col("length"))), F.lit(0)).cast("long").alias(f"b_{r}"), F.count_if(mine).alias(f"p_{r}"), F.countDistinct(F.when(mine, F.col("flow_id"))).alias(f"f_{r}")]
    rows = packets.groupBy(key).agg(*aggs)
    out = [safe_div(F.col(f"{p}_{r}"), F.col(t)).alias(f"{n}_{r}") for r in roles for p, t, n in (("b", "bytes", "byte_frac"), ("p", "pkts", "pkt_frac"), ("f", "flows", "flow_frac"))]
    return rows.select(key, *out)


def group_shares(packets: DataFrame, groups: dict[str, list[str]], key: str = "capture_id") -> DataFrame:
    """(key, grp, byte_frac, pkt_frac, flow_frac) of overlapping role groups; a flow counts once in a group."""
    spark = packets.sparkSession
    bridge = spark.createDataFrame([(r, g) for g, rs in groups.items() for r in rs], "role string, grp string")
    total = packets.groupBy(key).agg(F.sum("length").alias("bytes"), F.count("*").alias("pkts"), F.countDistinct("flow_id").alias("flows"))
    # the bridge has one row for each member of a configured group
    mine = packets.join(F.broadcast(bridge), "role").groupBy(key, "grp").agg(F.sum("length").alias("b"), F.count("*").alias("p"), F.countDistinct("flow_id").alias("f"))
    return mine.join(total, key).select(key, "grp", safe_div(F.col("b"), F.col("bytes")).alias("byte_frac"), safe_div(F.col("p"), F.col("pkts")).alias("pkt_frac"), safe_div(F.col("f"), F.col("flows")).alias("flow_frac"))


def role_entropy(packets: DataFrame, key: str = "capture_id") -> DataFrame:
    """Entropy of the byte shares of roles, in nats, and the largest share."""
    per = packets.groupBy(key, "role").agg(F.sum("length").alias("b"))
    total = packets.groupBy(key).agg(F.sum("length").alias("t"))
    p = F.col("b") / F.col("t")
    return per.join(total, key).groupBy(key).agg((-F.sum(p * F.log(p + 1e-12))).alias("role_entropy"), F.max(p).alias("dominant_share"))


def dominant_stage(packets: DataFrame, stages: dict[str, list[str]], key: str = "capture_id") -> DataFrame:
    """The first stage with the largest positive byte share, its share and its place in the list from 1; none: 0."""
    total = F.sum("length")
    share = [safe_div(F.coalesce(F.sum(F.when(F.col("role").isin(rs), F.col("length"))), F.lit(0)), total) for rs in stages.values()]
    best: Column = F.array_max(F.array(*[F.struct(s.alias("share"), F.lit(-i).alias("place"), F.lit(n).alias("stage")) for i, (n, s) in enumerate(zip(stages, share), 1)]))
    rows = packets.groupBy(key).agg(best.alias("b"))
    some = F.col("b.share") > 0
    return rows.select(key, F.when(some, F.col("b.stage")).otherwise("none").alias("stage"), F.when(some, F.col("b.share")).otherwise(0.0).alias("stage_frac"), F.when(some, -F.col("b.place")).otherwise(0).cast("long").alias("stage_code"))


def phase_features(packets: DataFrame, anchors: DataFrame, phases: list[tuple[str, float, float]], roles: list[str]) -> DataFrame:
    """Bytes and byte fractions of each role in each phase [from, to) after the anchor, and the phase's large-packet fraction."""
    rows = packets.join(anchors.select("capture_id", "anchor"), "capture_id").withColumn("rel", F.col("ts") - F.col("anchor"))
    aggs = []
    for name, a, z in phases:
        within = (F.col("rel") >= a) & (F.col("rel") < z)
        total = F.coalesce(F.sum(F.when(within, F.col("length"))), F.lit(0)).cast("long")
        aggs += [total.alias(f"{name}_bytes"), safe_div(F.count_if(within & (F.col("length") >= 1000)), F.count_if(within)).alias(f"{name}_large_frac")]
        for r in roles:
            mine = F.coalesce(F.sum(F.when(within & (F.col("role") == r), F.col("length"))), F.lit(0)).cast("long")
            aggs += [mine.alias(f"{name}_{r}_bytes"), safe_div(mine, total).alias(f"{name}_{r}_frac")]
    return rows.groupBy("capture_id").agg(*aggs)


def suppress_roles(packets: DataFrame, roles: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped counts per capture): packets, bytes and flows of the roles taken out."""
    gone = F.coalesce(F.lower("role").isin(roles), F.lit(False))
    lost = packets.groupBy("capture_id").agg(F.count_if(gone).alias("dropped_pkts"), F.coalesce(F.sum(F.when(gone, F.col("length"))), F.lit(0)).cast("long").alias("dropped_bytes"), F.countDistinct(F.when(gone, F.col("flow_id"))).alias("dropped_flows"))
    return packets.where(~gone), lost


def stable_fraction(key: Column, salt: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the key, salt and seed alone: the first 64 bits of a SHA-1."""
    digest = F.sha1(F.concat(F.lit(f"{salt}|"), key, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hide_visibility(packets: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """Per capture: flows whose name stays visible and those hidden at the given rate, whole flows at a time."""
    flows = packets.select("capture_id", "flow_id").distinct()
    hidden = stable_fraction(F.col("flow_id"), "sni", seed) < rate
    return flows.groupBy("capture_id").agg(F.count_if(hidden).alias("hidden_flows"), F.count_if(~hidden).alias("visible_flows"))


def unify_transport(packets: DataFrame) -> DataFrame:
    """Drop TCP rows without payload and UDP rows under 48 bytes of payload; length becomes the payload."""
    tcp = F.col("proto") == "TCP"
    keep = F.when(tcp, F.col("payload_len") > 0).otherwise(F.col("payload_len") >= 48)
    return packets.where(keep).withColumn("length", F.col("payload_len"))
