"""Roles of packets from what names their server: HAR entries, server names of flows, DNS answers; suppression and clipping by them.

Packets have capture_id, ts, length, direction, src, dst, flow_id and sni (null
or empty where none). What names a server is aggregated to a row a (capture,
address) or (capture, flow) before it meets the packets, so every join is an
equi-join with a side of one row a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.net import host_parts, matches_any, normalize_host

UNKNOWN = "unknown"
#: Ports of web traffic. Fixed values.
WEB_PORTS = (80, 443, 8080, 8443)
#: The flow name that all encrypted web flows of two addresses share. Fixed value.
MERGED = "ENC443"
Classify = Callable[[Column], Column]


def server_ip(direction: Column, src: Column, dst: Column) -> Column:
    """The address that is not the client's: the source of what comes down, else the destination."""
    return F.when(direction == "down", src).otherwise(dst)


def remote_endpoint(direction: Column, src: Column, sport: Column, dst: Column, dport: Column) -> Column:
    """struct(ip, port, web): the other end, and whether its port is one of the web's."""
    down = direction == "down"
    port = F.when(down, sport).otherwise(dport)
    return F.struct(F.when(down, src).otherwise(dst).alias("ip"), port.alias("port"), F.coalesce(port.isin(*WEB_PORTS), F.lit(False)).alias("web"))


def _best(role: Column, priority: list[str]) -> Column:
    """Aggregate: of a group's roles the one that comes first in priority; others come after all of them, by name."""
    place = F.array_position(F.array(*map(F.lit, priority)), role)
    return F.min_by(role, F.struct(F.when(place > 0, place).otherwise(len(priority) + 1), role))


def names_by_ip(entries: DataFrame, classify: Classify, priority: list[str]) -> DataFrame:
    """(capture_id, ip, hosts, role) from rows (capture_id, ip, host); null or empty addresses and hosts name nothing."""
    rows = entries.select("capture_id", "ip", normalize_host(F.col("host")).alias("host")).where("ip <> '' and host <> ''").distinct()
    rows = rows.withColumn("role", classify(F.col("host")))
    return rows.groupBy("capture_id", "ip").agg(F.array_join(F.array_sort(F.collect_set("host")), "|").alias("hosts"), _best(F.col("role"), priority).alias("role"))


def names_by_flow(packets: DataFrame, classify: Classify) -> DataFrame:
    """(capture_id, flow_id, hosts, role): the flow's last server name wins."""
    named = packets.where(F.col("sni") != "").groupBy("capture_id", "flow_id").agg(F.max_by("sni", F.struct("ts", "sni")).alias("hosts"))
    return named.withColumn("role", classify(normalize_host(F.col("hosts"))))


def _with(packets: DataFrame, names: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return packets.join(names.withColumnsRenamed({"hosts": f"{prefix}_hosts", "role": f"{prefix}_role"}), keys, "left")


def assign_roles(packets: DataFrame, classify: Classify, priority: list[str], har: DataFrame | None = None, dns: DataFrame | None = None, order: tuple[str, ...] = ("har", "sni")) -> DataFrame:
    """packets with role and hosts from the first source of ``order`` that names the packet's server: har, sni or dns.

    ("har",), ("sni",), ("sni", "dns") and ("har", "sni") are the usual ones.
    A role of unknown counts as none. Packets that nothing names are unknown
    with null hosts. har and dns are rows (capture_id, ip, host).
    """
    rows = packets.withColumn("ip", server_ip(F.col("direction"), F.col("src"), F.col("dst")))
    for name in order:
        if name == "sni":
            rows = _with(rows, names_by_flow(packets, classify), ["capture_id", "flow_id"], name)
        else:
            rows = _with(rows, names_by_ip({"har": har, "dns": dns}[name], classify, priority), ["capture_id", "ip"], name)
    known = [F.when(F.col(f"{n}_role") != UNKNOWN, F.struct(F.col(f"{n}_role").alias("role"), F.col(f"{n}_hosts").alias("hosts"))) for n in order]
    rows = rows.withColumn("named", F.coalesce(*known))
    gone = [f"{n}_{c}" for n in order for c in ("role", "hosts")]
    return rows.withColumn("role", F.coalesce("named.role", F.lit(UNKNOWN))).withColumn("hosts", F.col("named.hosts")).drop("named", "ip", *gone)


def observation_counts(packets: DataFrame, dns: DataFrame) -> DataFrame:
    """Per capture: different server names and their addresses, different DNS hosts and addresses."""
    ip = server_ip(F.col("direction"), F.col("src"), F.col("dst"))
    name = F.when(F.col("sni") != "", normalize_host(F.col("sni")))
    seen = packets.groupBy("capture_id").agg(F.countDistinct(name).alias("sni_hosts"), F.countDistinct(F.when(name.isNotNull(), ip)).alias("sni_ips"))
    told = dns.groupBy("capture_id").agg(F.countDistinct("host").alias("dns_hosts"), F.countDistinct("ip").alias("dns_ips"))
    return seen.join(told, "capture_id", "left").na.fill(0, ["dns_hosts", "dns_ips"])


def known_only(packets: DataFrame, include_unknown: bool = False) -> DataFrame:
    return packets if include_unknown else packets.where(F.coalesce(F.col("role"), F.lit(UNKNOWN)) != UNKNOWN)


def suppress_hosts(packets: DataFrame, patterns: list[str], keep_roles: tuple[str, ...] = (), keep_hosts: tuple[str, ...] = ()) -> DataFrame:
    """packets without those of which any host matches any pattern; kept roles stay, and hosts equal to or below a kept host do not count."""
    def spared(h: Column) -> Column:
        out = F.lit(False)
        for k in keep_hosts:
            out = out | (h == k) | h.endswith(f".{k}")
        return out

    open_ = F.array_join(F.filter(host_parts(F.col("hosts")), lambda h: ~spared(h)), "|") if keep_hosts else F.col("hosts")
    return packets.where(F.coalesce(F.col("role").isin(*keep_roles), F.lit(False)) | ~matches_any(open_, patterns))


def suppress_roles_unless_har(packets: DataFrame, roles: list[str], har: DataFrame) -> DataFrame:
    """packets without those of the roles, but for packets of which a host is in the capture's HAR.

    The hosts of a capture's HAR are one array, met by capture.
    """
    hosts = har.select("capture_id", normalize_host(F.col("host")).alias("host")).where("host <> ''").groupBy("capture_id").agg(F.collect_set("host").alias("har_hosts"))
    own = F.arrays_overlap(F.transform(host_parts(F.col("hosts")), normalize_host), "har_hosts")
    drop = F.coalesce(F.lower("role").isin(*roles), F.lit(False)) & ~F.coalesce(own, F.lit(False))
    return packets.join(hosts, "capture_id", "left").where(~drop).drop("har_hosts")


def merge_encrypted(packets: DataFrame) -> DataFrame:
    """packets with one flow for all of a pair of addresses, whichever sends."""
    pair = F.concat_ws("|", F.lit(MERGED), F.least("src", "dst"), F.greatest("src", "dst"))
    return packets.withColumn("flow_id", pair)


def clip_before_action(packets: DataFrame, actions: DataFrame) -> DataFrame:
    """packets from the capture's first action on; a capture with packets and no action is an error at run time.

    actions: (capture_id, first_action), one row a capture.
    """
    rows = packets.join(actions.select("capture_id", "first_action"), "capture_id", "left")
    start = F.when(F.col("first_action").isNull(), F.raise_error(F.concat(F.lit("no action in "), F.col("capture_id").cast("string"))).cast("double")).otherwise(F.col("first_action"))
    return rows.where(F.col("ts") >= start).drop("first_action")


def role_bytes(packets: DataFrame) -> DataFrame:
    """(capture_id, role, bytes) by lower-case role."""
    return packets.groupBy("capture_id", F.lower(F.coalesce("role", F.lit(UNKNOWN))).alias("role")).agg(F.sum("length").cast("long").alias("bytes"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


def cross_role_ratios(packets: DataFrame, pairs: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """Per capture: for each name the bytes of the first roles over those of the second, plus one."""
    def total(roles):
        return F.coalesce(F.sum(F.when(F.col("role").isin(*roles), F.col("length"))), F.lit(0))

    return packets.groupBy("capture_id").agg(*[(total(a) / (total(b) + 1)).alias(n) for n, (a, b) in pairs.items()])


def protocol_shares(packets: DataFrame, roles: list[str]) -> DataFrame:
    """Per capture: share of TCP packets and of UDP ones, over all packets and within each role."""
    aggs = []
    for name, mine in [("all", F.lit(True)), *[(r, F.col("role") == r) for r in roles]]:
        for proto in ("TCP", "UDP"):
            aggs.append(ratio(F.count_if(mine & (F.col("proto") == proto)), F.count_if(mine)).alias(f"{name}_{proto.lower()}_frac"))
    return packets.groupBy("capture_id").agg(*aggs)
