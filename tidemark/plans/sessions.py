"""Queries over events as packets: bursts, windows, shares, flows and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numbers import stat5, stat8
from tidemark.operators import ordered, shares, windows
from tidemark.plans.mapping import HOUR, ROLES, P, packets, rounded

GAP = 6 * HOUR
GROUPS = {"intent": ["click", "signup", "purchase"], "trade": ["purchase", "signup"], "noise": ["view", "error"]}
STAGES = {"enter": ["signup"], "browse": ["view", "click"], "buy": ["purchase"], "fail": ["error"]}
PHASES = [("p0", 0.0, 24 * HOUR), ("p1", 24 * HOUR, 96 * HOUR), ("p2", 96 * HOUR, 240 * HOUR)]
QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "WITH " + P + sql
        return f
    return add


def _stat8(x: str, prefix: str, where: str = "") -> str:
    f = f" FILTER ({where})" if where else ""
    parts = {"mean": f"avg({x})", "std": f"stddev_pop({x})", "p25": f"quantile_cont({x}, 0.25)", "p50": f"quantile_cont({x}, 0.5)", "p75": f"quantile_cont({x}, 0.75)", "p90": f"quantile_cont({x}, 0.9)", "max": f"max({x})", "min": f"min({x})"}
    return ", ".join(f"round(coalesce({v}{f}, 0), 6)::DOUBLE AS {prefix}_{k}" for k, v in parts.items())


_BURST = f""", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id ORDER BY ts, event_id) > {GAP} THEN 1 ELSE 0 END AS fresh FROM p),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY capture_id ORDER BY ts, event_id) AS burst_no FROM g),
b AS (SELECT capture_id, burst_no::BIGINT AS burst_no, min(ts) AS start, max(ts) AS "end", count(*) AS n_pkts, sum(length)::BIGINT AS bytes_total FROM r GROUP BY ALL)"""


@query(_BURST + """ SELECT capture_id, burst_no, round(start, 6) AS start, round("end", 6) AS "end", n_pkts, bytes_total FROM b""")
def bursts_gap_islands(spark, sf_dir):
    return rounded(ordered.bursts(packets(spark, sf_dir), GAP))


@query(_BURST + """ SELECT capture_id, count(*) AS n_bursts, round(avg(n_pkts), 6) AS mean_pkts, max(n_pkts) AS max_pkts, round(avg(bytes_total), 6) AS mean_bytes, max(bytes_total) AS max_bytes FROM b GROUP BY 1""")
def burst_summary(spark, sf_dir):
    return rounded(ordered.bursts(packets(spark, sf_dir), GAP).groupBy("capture_id").agg(F.count("*").alias("n_bursts"), F.avg("n_pkts").alias("mean_pkts"), F.max("n_pkts").alias("max_pkts"), F.avg("bytes_total").alias("mean_bytes"), F.max("bytes_total").alias("max_bytes")))


@query(f" SELECT capture_id, {_stat8('length', 'len')}, {_stat8('length', 'up', chr(100) + 'irection = ' + repr('up'))} FROM p GROUP BY 1")
def stat8_by_session(spark, sf_dir):
    return rounded(packets(spark, sf_dir).groupBy("capture_id").agg(*stat8(F.col("length"), "len"), *stat8(F.col("length"), "up", F.col("direction") == "up")))


@query(" SELECT flow_id, round(avg(length), 6) AS len_mean, round(stddev_pop(length), 6) AS len_std, round(quantile_cont(length, 0.5), 6)::DOUBLE AS len_p50, round(quantile_cont(length, 0.9), 6)::DOUBLE AS len_p90, max(length)::DOUBLE AS len_max FROM p GROUP BY 1")
def stat5_by_flow(spark, sf_dir):
    return rounded(packets(spark, sf_dir).groupBy("flow_id").agg(*stat5(F.col("length"), "len")))


_ANCHOR = """, a AS (SELECT capture_id, min(ts) AS anchor, max(ts) AS capture_end FROM p GROUP BY 1)"""
_FIXED = _ANCHOR + """, s AS (SELECT unnest([24.0, 48.0, 96.0]) * 3600 AS s),
w AS (SELECT capture_id, 'w' || s::BIGINT AS window_name, anchor AS start, least(anchor + s, capture_end) AS "end", CASE WHEN anchor + s > capture_end THEN 'clipped_by_capture' ELSE 'full' END AS reason FROM a, s)"""
SECONDS = [24 * HOUR, 48 * HOUR, 96 * HOUR]


@query(_FIXED + """ SELECT capture_id, window_name, round(start, 6) AS start, round("end", 6) AS "end", reason FROM w""")
def fixed_windows(spark, sf_dir):
    return rounded(windows.fixed_windows(windows.anchors_at_start(packets(spark, sf_dir)), SECONDS))


@query(_FIXED + f""", j AS (
  SELECT p.*, w.window_name, w.start, p.ts - lag(p.ts) OVER (PARTITION BY p.capture_id, w.window_name ORDER BY p.ts, p.event_id) AS gap
  FROM p JOIN w ON p.capture_id = w.capture_id AND p.ts BETWEEN w.start AND w."end"
), g AS (
  SELECT capture_id, window_name, count(*) AS n_pkts, count(DISTINCT flow_id) AS n_flows, sum(length)::BIGINT AS bytes,
    coalesce(sum(length) FILTER (direction = 'up'), 0)::BIGINT AS bytes_up, coalesce(sum(length) FILTER (direction = 'down'), 0)::BIGINT AS bytes_down,
    count(*) FILTER (direction = 'up') AS pkts_up, count(*) FILTER (direction = 'down') AS pkts_down, count(DISTINCT floor((ts - start) / 3600)) AS bins,
    count(*) FILTER (length >= 1000) AS large, count(*) FILTER (length <= 80) AS small, {_stat8('gap', 'iat')}, {_stat8('length', 'size')}
  FROM j GROUP BY ALL)
SELECT capture_id, window_name, round(w."end" - w.start, 6) AS duration, g.* EXCLUDE (capture_id, window_name, bins, large, small), round(coalesce(bytes_up / nullif(bytes, 0), 0), 6) AS up_ratio,
  round(coalesce(n_pkts / nullif(w."end" - w.start, 0), 0), 6) AS pkt_rate, round(coalesce(bytes / nullif(w."end" - w.start, 0), 0), 6) AS byte_rate, bins * 3600.0::DOUBLE AS active_s,
  round(large / n_pkts, 6) AS large_frac, round(small / n_pkts, 6) AS small_frac FROM w JOIN g USING (capture_id, window_name)""")
def window_base_counts(spark, sf_dir):
    p = packets(spark, sf_dir)
    return rounded(windows.base_features(p, windows.fixed_windows(windows.anchors_at_start(p), SECONDS), HOUR))


_DYN = dict(least_s=24 * HOUR, most_s=240 * HOUR, gap_s=GAP, idle_s=12 * HOUR, tail_s=HOUR, least_pkts=2, least_bytes=40000)


@query(_ANCHOR + f""", h AS (SELECT *, least(anchor + 864000, capture_end) AS hard_end FROM a),
post AS (SELECT p.*, anchor FROM p JOIN h USING (capture_id) WHERE ts BETWEEN anchor AND hard_end),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id ORDER BY ts, event_id) > {GAP} THEN 1 ELSE 0 END AS fresh FROM post),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY capture_id ORDER BY ts, event_id) AS b FROM g),
s0 AS (SELECT capture_id, anchor, b, min(ts) AS s, max(ts) AS e, count(*) AS n, sum(length) AS z FROM r GROUP BY ALL HAVING count(*) >= 2 OR sum(length) >= 40000),
s1 AS (SELECT *, lead(s) OVER (PARTITION BY capture_id ORDER BY s) AS nx FROM s0),
hit AS (SELECT capture_id, arg_min(struct_pack(e, nx), e) AS hit FROM s1 WHERE e - anchor >= 86400 AND (nx IS NULL OR nx - e >= 43200) GROUP BY 1),
l AS (SELECT capture_id, max(ts) AS last_ts FROM post GROUP BY 1), k AS (SELECT DISTINCT capture_id, TRUE AS sig FROM s1),
x AS (SELECT h.*, last_ts, sig, hit, least(hard_end, hit.e + 3600) AS at_ FROM h LEFT JOIN l USING (capture_id) LEFT JOIN k USING (capture_id) LEFT JOIN hit USING (capture_id)),
y AS (SELECT *, CASE WHEN last_ts IS NULL THEN 'no_post_packets' WHEN sig IS NULL THEN 'no_significant_burst' WHEN hit IS NOT NULL AND hit.nx IS NULL AND capture_end <= at_ + 43200 THEN 'capture_stop_after_last_burst'
  WHEN hit IS NOT NULL AND hit.nx IS NULL THEN 'last_burst' WHEN hit IS NOT NULL THEN 'idle_gap' WHEN capture_end <= anchor + 86400 THEN 'capture_stop_before_min_window' ELSE 'min_window' END AS reason FROM x)
SELECT capture_id, round(anchor, 6) AS start, round(CASE reason WHEN 'no_significant_burst' THEN least(hard_end, last_ts + 3600) WHEN 'last_burst' THEN at_ WHEN 'idle_gap' THEN at_ WHEN 'min_window' THEN least(hard_end, anchor + 86400) ELSE hard_end END, 6) AS "end", reason FROM y""")
def dynamic_window(spark, sf_dir):
    p = packets(spark, sf_dir)
    return rounded(windows.dynamic_window(p, windows.anchors_at_start(p), **_DYN))


@query(_ANCHOR + f""", h AS (SELECT *, least(anchor + 1209600, capture_end) AS hard_end FROM a),
post AS (SELECT p.*, anchor, hard_end FROM p JOIN h USING (capture_id) WHERE ts BETWEEN anchor AND hard_end),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id ORDER BY ts, event_id) > {GAP} THEN 1 ELSE 0 END AS fresh FROM post),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY capture_id ORDER BY ts, event_id) AS b FROM g),
s0 AS (SELECT capture_id, anchor, hard_end, b, min(ts) AS s, max(ts) AS e, count(*) AS n, sum(length) AS z, coalesce(sum(length) FILTER (role IN ('click', 'signup', 'purchase')), 0) AS i, coalesce(sum(length) FILTER (role = 'error'), 0) AS u FROM r GROUP BY ALL),
s1 AS (SELECT *, sum(n) OVER q AS cn, sum(z) OVER q AS cz, sum(i) OVER q AS ci, sum(u) OVER q AS cu, lead(s) OVER (PARTITION BY capture_id ORDER BY b) AS nx, greatest(e + 3600, anchor + 86400) AS stop FROM s0 WINDOW q AS (PARTITION BY capture_id ORDER BY b)),
s2 AS (SELECT *, max(CASE WHEN stop > hard_end THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY b) AS over_, (cz >= 300000 AND ci / cz >= 0.4 AND cu / cz < 0.8) AS filled FROM s1),
c AS (SELECT *, CASE WHEN filled THEN least(stop, hard_end) ELSE least(greatest(stop, e + 43200), hard_end) END AS at_, CASE WHEN filled THEN 'saturated' WHEN nx IS NULL THEN 'last_burst_idle' ELSE 'idle_gap' END AS why
  FROM s2 WHERE over_ = 0 AND cn >= 4 AND cz >= 50000 AND ci >= 30000 AND (filled OR nx IS NULL OR nx - e >= 43200)),
hit AS (SELECT capture_id, arg_min(at_, b) AS at_, arg_min(why, b) AS why FROM c GROUP BY 1), l AS (SELECT capture_id, max(ts) AS last_ts FROM post GROUP BY 1)
SELECT capture_id, round(anchor, 6) AS start, round(coalesce(at_, least(greatest(anchor + 86400, last_ts + 3600), hard_end)), 6) AS "end", coalesce(why, 'weak_evidence') AS reason FROM h LEFT JOIN l USING (capture_id) LEFT JOIN hit USING (capture_id)""")
def adaptive_window(spark, sf_dir):
    p = packets(spark, sf_dir)
    return rounded(windows.adaptive_window(p, windows.anchors_at_start(p), GROUPS["intent"], ["error"], 24 * HOUR, 336 * HOUR, GAP, 12 * HOUR, HOUR, 4, 50000, 30000, 300000, 0.4))


@query(""", s AS (SELECT capture_id, min(ts) AS t0 FROM p GROUP BY 1), r AS (SELECT capture_id, floor((ts - t0) / 3600) AS bin, sum(length) AS z FROM p JOIN s USING (capture_id) WHERE floor((ts - t0) / 3600) * 3600 < 864000 GROUP BY ALL),
q AS (SELECT *, sum(z) OVER (PARTITION BY capture_id ORDER BY bin) AS seen FROM r), l AS (SELECT *, lead(bin) OVER (PARTITION BY capture_id ORDER BY bin) AS nx FROM q WHERE z >= 36000),
h AS (SELECT capture_id, min(bin) AS bin FROM l WHERE (coalesce(nx, 1099511627776) - bin - 1) * 3600 >= 86400 AND seen >= 60000 GROUP BY 1)
SELECT capture_id, round(CASE WHEN bin IS NULL THEN t0 + 864000 ELSE least(t0 + (bin + 1) * 3600, t0 + 864000) END, 6) AS load_end FROM s LEFT JOIN h USING (capture_id)""")
def post_load_estimate(spark, sf_dir):
    return rounded(windows.post_load_end(packets(spark, sf_dir), HOUR, 10.0, 24 * HOUR, 240 * HOUR, 60000))


@query(" SELECT capture_id, " + ", ".join(f"round(coalesce(sum(length) FILTER (role = '{r}'), 0) / sum(length), 6) AS byte_frac_{r}, round(count(*) FILTER (role = '{r}') / count(*), 6) AS pkt_frac_{r}, round(count(DISTINCT flow_id) FILTER (role = '{r}') / count(DISTINCT flow_id), 6) AS flow_frac_{r}" for r in ROLES) + " FROM p GROUP BY 1")
def role_shares(spark, sf_dir):
    return rounded(shares.role_shares(packets(spark, sf_dir), ROLES))


@query(", br AS (" + " UNION ALL ".join(f"SELECT '{r}' AS role, '{g}' AS grp" for g, rs in GROUPS.items() for r in rs) + """), t AS (SELECT capture_id, sum(length) AS z, count(*) AS n, count(DISTINCT flow_id) AS f FROM p GROUP BY 1)
SELECT capture_id, grp, round(sum(length) / any_value(z), 6) AS byte_frac, round(count(*) / any_value(n), 6) AS pkt_frac, round(count(DISTINCT flow_id) / any_value(f), 6) AS flow_frac FROM p JOIN br USING (role) JOIN t USING (capture_id) GROUP BY 1, 2""")
def role_groups(spark, sf_dir):
    return rounded(shares.group_shares(packets(spark, sf_dir), GROUPS))


@query(", r AS (SELECT capture_id, role, sum(length) AS b FROM p GROUP BY ALL), q AS (SELECT *, b / sum(b) OVER (PARTITION BY capture_id) AS s FROM r) SELECT capture_id, round(-sum(s * ln(s + 1e-12)), 6) AS role_entropy, round(max(s), 6) AS dominant_share FROM q GROUP BY 1")
def role_entropy(spark, sf_dir):
    return rounded(shares.role_entropy(packets(spark, sf_dir)))


@query(", s AS (SELECT capture_id, " + ", ".join(f"coalesce(sum(length) FILTER (role IN ({', '.join(map(repr, rs))})), 0) / sum(length) AS s{i}" for i, rs in enumerate(STAGES.values(), 1)) + " FROM p GROUP BY 1), m AS (SELECT *, greatest(s1, s2, s3, s4) AS g FROM s) SELECT capture_id, CASE WHEN g = 0 THEN 'none' "
       + " ".join(f"WHEN s{i} = g THEN '{n}'" for i, n in enumerate(STAGES, 1)) + " END AS stage, round(g, 6) AS stage_frac, (CASE WHEN g = 0 THEN 0 " + " ".join(f"WHEN s{i} = g THEN {i}" for i in range(1, 5)) + " END)::BIGINT AS stage_code FROM m")
def dominant_stage(spark, sf_dir):
    return rounded(shares.dominant_stage(packets(spark, sf_dir), STAGES))


def _phase_sql() -> str:
    out = []
    for n, a, z in PHASES:
        w = f"rel >= {a} AND rel < {z}"
        out += [f"coalesce(sum(length) FILTER ({w}), 0)::BIGINT AS {n}_bytes", f"round(coalesce(count(*) FILTER ({w} AND length >= 1000) / nullif(count(*) FILTER ({w}), 0), 0), 6) AS {n}_large_frac"]
        for r in ROLES:
            mine = f"coalesce(sum(length) FILTER ({w} AND role = '{r}'), 0)"
            out += [f"{mine}::BIGINT AS {n}_{r}_bytes", f"round(coalesce({mine} / nullif(sum(length) FILTER ({w}), 0), 0), 6) AS {n}_{r}_frac"]
    return ", ".join(out)


@query(_ANCHOR + f", q AS (SELECT p.*, ts - anchor AS rel FROM p JOIN a USING (capture_id)) SELECT capture_id, {_phase_sql()} FROM q GROUP BY 1")
def phase_features(spark, sf_dir):
    p = packets(spark, sf_dir)
    return rounded(shares.phase_features(p, windows.anchors_at_start(p), PHASES, ROLES))


@query(""", r AS (SELECT capture_id, flow_id, role, count(*) AS n, min(struct_pack(ts, event_id)) AS f FROM p GROUP BY ALL), t AS (SELECT capture_id, flow_id, arg_min(role, struct_pack(a := -n, f)) AS main_role FROM r GROUP BY ALL)
SELECT capture_id, flow_id, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts, count(*) AS n_pkts, sum(length)::BIGINT AS bytes, coalesce(sum(length) FILTER (direction = 'up'), 0)::BIGINT AS bytes_up, any_value(main_role) AS main_role, round(max(ts) - min(ts), 6) AS duration FROM p JOIN t USING (capture_id, flow_id) GROUP BY ALL""")
def flow_records(spark, sf_dir):
    return rounded(windows.flow_records(packets(spark, sf_dir)))


@query(""", f AS (SELECT capture_id, flow_id, floor(min(ts) / 3600)::BIGINT AS a, floor(max(ts) / 3600)::BIGINT AS z FROM p GROUP BY ALL), e AS (SELECT capture_id, unnest(range(a, z + 1)) AS bin FROM f), c AS (SELECT capture_id, bin, count(*) AS n FROM e GROUP BY ALL)
SELECT capture_id, max(n) AS max_flows, round(avg(n), 6) AS mean_flows FROM c GROUP BY 1""")
def concurrent_flows(spark, sf_dir):
    return rounded(windows.concurrent_flows(packets(spark, sf_dir), HOUR))


_SHAPE = """, o AS (SELECT *, ln(1 + CASE WHEN payload_len > 0 THEN payload_len ELSE length END) AS log_len, min(ts) OVER (PARTITION BY capture_id) AS t0, max(ts) OVER (PARTITION BY capture_id) AS t1, lag(ts) OVER (PARTITION BY capture_id ORDER BY ts, event_id) AS prev FROM p),
i AS (SELECT *, greatest(0, ts - coalesce(prev, t0)) AS iat, quantile_cont(log_len, 0.5) OVER (PARTITION BY capture_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS med, coalesce(log_len - lag(log_len) OVER (PARTITION BY capture_id ORDER BY ts, event_id), 0) AS diff FROM o),
m AS (SELECT capture_id, quantile_cont(iat, 0.5) FILTER (iat > 1e-6) AS sc FROM i GROUP BY 1)"""


@query(_SHAPE + """ SELECT capture_id, event_id, round(log_len, 6) AS log_len, round(med, 6) AS running_median, round(log_len - med, 6) AS "offset", round(diff, 6) AS diff, round(iat, 6) AS iat, round(least(greatest(iat / coalesce(sc, 1.0), 0), 20), 6)::DOUBLE AS rel_iat,
round(least(greatest((ts - t0) / greatest(t1 - t0, 1e-6), 0), 1), 6)::DOUBLE AS rel_time FROM i JOIN m USING (capture_id)""")
def packet_shape(spark, sf_dir):
    return rounded(ordered.shape_rows(packets(spark, sf_dir)))


@query(""", b AS (SELECT *, lag(direction) OVER (PARTITION BY capture_id ORDER BY ts, event_id) AS bf FROM p) SELECT capture_id, count(*) FILTER (bf <> direction) AS n_switches, count(*) FILTER (bf = 'up' AND direction = 'down') AS n_up_down, round(coalesce(count(*) FILTER (bf <> direction) / nullif(count(bf), 0), 0), 6) AS switch_rate FROM b GROUP BY 1""")
def direction_switches(spark, sf_dir):
    return rounded(ordered.switches(packets(spark, sf_dir)))


@query(", n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, event_id) AS k FROM p) SELECT capture_id, " + ", ".join(f"coalesce(max(length) FILTER (k = {i + 1}), 0)::DOUBLE AS view_{i}" for i in range(40)) + " FROM n WHERE k <= 40 GROUP BY 1")
def prefix_pivot(spark, sf_dir):
    return ordered.prefix_pivot(packets(spark, sf_dir), 40)


@query(_SHAPE + """ SELECT capture_id, round(CASE WHEN count(*) >= 3 AND stddev_pop(log_len) > 1e-9 AND stddev_pop(iat) > 1e-9 THEN corr(log_len, iat) ELSE 0 END, 6) AS len_iat_corr FROM i GROUP BY 1""")
def length_gap_correlation(spark, sf_dir):
    return rounded(ordered.length_gap_correlation(packets(spark, sf_dir)))


@query(_ANCHOR + """, f AS (SELECT capture_id, flow_id, min(ts) AS first_ts FROM p GROUP BY ALL) SELECT capture_id, count(*) AS n_flows, count(*) FILTER (first_ts >= anchor + 345600) AS n_new FROM f JOIN a USING (capture_id) GROUP BY 1""")
def first_seen_novelty(spark, sf_dir):
    p = packets(spark, sf_dir)
    return ordered.first_seen(p, "flow_id").join(windows.anchors_at_start(p), "capture_id").groupBy("capture_id").agg(F.count("*").alias("n_flows"), F.count_if(F.col("first_ts") >= F.col("anchor") + 96 * HOUR).alias("n_new"))


@query(""", g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY capture_id, flow_id ORDER BY ts, event_id) AS gap FROM p) SELECT capture_id, flow_id, event_id, round(ts, 6) AS ts, gap IS NOT NULL AS again FROM g WHERE gap IS NULL OR gap >= 432000""")
def reactivation(spark, sf_dir):
    return rounded(ordered.reactivations(packets(spark, sf_dir), "flow_id", 120 * HOUR))


@query("")
def candidate_nms(spark, sf_dir):
    return rounded(ordered.suppress_near(packets(spark, sf_dir).withColumn("score", F.col("length").cast("double")), 36 * HOUR, 8))


ORACLES["candidate_nms"] = "WITH RECURSIVE " + P + """, c AS (SELECT capture_id, event_id, ts, length::DOUBLE AS score, row_number() OVER (PARTITION BY capture_id ORDER BY length DESC, ts, event_id) AS k FROM p),
f AS (SELECT capture_id, 0::BIGINT AS k, []::DOUBLE[] AS kept, FALSE AS took FROM (SELECT DISTINCT capture_id FROM c)
  UNION ALL SELECT c.capture_id, c.k, CASE WHEN len(kept) < 8 AND len(list_filter(kept, lambda x: abs(x - c.ts) <= 129600)) = 0 THEN list_append(kept, c.ts) ELSE kept END, len(kept) < 8 AND len(list_filter(kept, lambda x: abs(x - c.ts) <= 129600)) = 0
  FROM f JOIN c ON f.capture_id = c.capture_id AND c.k = f.k + 1)
SELECT c.capture_id, row_number() OVER (PARTITION BY c.capture_id ORDER BY c.k) AS rank, c.event_id, round(c.ts, 6) AS ts, c.score FROM f JOIN c ON f.capture_id = c.capture_id AND f.k = c.k WHERE f.took"""


@query(""", s AS (SELECT capture_id, flow_id, min(struct_pack(ts, event_id)) AS f FROM p GROUP BY ALL) SELECT x.capture_id, x.flow_id, count(*) AS n_within FROM s x JOIN s y ON x.capture_id = y.capture_id AND y.f >= x.f AND y.f.ts <= x.f.ts + 86400 GROUP BY ALL HAVING count(*) >= 3""")
def rpc_fanout(spark, sf_dir):
    return ordered.fanout(packets(spark, sf_dir), 24 * HOUR, 3)


@query(""" SELECT capture_id, count(*) FILTER (role IN ('error')) AS dropped_pkts, coalesce(sum(length) FILTER (role = 'error'), 0)::BIGINT AS dropped_bytes, count(DISTINCT flow_id) FILTER (role = 'error') AS dropped_flows FROM p GROUP BY 1""")
def role_suppression(spark, sf_dir):
    return shares.suppress_roles(packets(spark, sf_dir), ["error"])[1]


@query(""", f AS (SELECT DISTINCT capture_id, flow_id FROM p), h AS (SELECT *, ('0x' || substr(sha1('sni|' || flow_id || '|7'), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.3 AS hid FROM f) SELECT capture_id, count(*) FILTER (hid) AS hidden_flows, count(*) FILTER (NOT hid) AS visible_flows FROM h GROUP BY 1""")
def visibility_sampling(spark, sf_dir):
    return shares.hide_visibility(packets(spark, sf_dir), 0.3)


@query(""" SELECT capture_id, count(*) AS n_pkts, sum(payload_len)::BIGINT AS bytes FROM p WHERE CASE WHEN proto = 'TCP' THEN payload_len > 0 ELSE payload_len >= 48 END GROUP BY 1""")
def transport_norm(spark, sf_dir):
    return shares.unify_transport(packets(spark, sf_dir)).groupBy("capture_id").agg(F.count("*").alias("n_pkts"), F.sum("length").cast("long").alias("bytes"))
