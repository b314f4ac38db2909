"""Queries over boundaries, block-wise suppression, anchors and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audits, families, sites, windows
from tidemark.plans.evidence import _TOK, _counts
from tidemark.plans.mapping import HOUR, P, packets, rounded, table
from tidemark.sources.sinks import sample_key

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


@query(f"""WITH {P}, f AS (SELECT capture_id, flow_id, min(ts) AS ts FROM p GROUP BY ALL), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id ORDER BY ts, flow_id) <= 21600 THEN 0 ELSE 1 END AS nw FROM f), g AS (SELECT *, sum(nw) OVER (PARTITION BY capture_id ORDER BY ts, flow_id) AS gr FROM n),
q AS (SELECT capture_id, min(ts) AS g, count(*) AS novelty FROM g GROUP BY capture_id, gr), fl AS (SELECT q.capture_id, q.g, count(*) AS flows FROM q JOIN f ON f.capture_id = q.capture_id AND f.ts >= q.g AND f.ts <= q.g + 86400 GROUP BY ALL),
b AS (SELECT q.capture_id, q.g, coalesce(sum(length) FILTER (ts >= g), 0)::BIGINT AS bytes, coalesce(sum(length) FILTER (ts < g), 0)::BIGINT AS past FROM q JOIN p ON p.capture_id = q.capture_id AND ts >= g - 172800 AND ts < g + 86400 GROUP BY ALL)
SELECT capture_id, round(g, 6) AS ts, novelty, flows, bytes, round(least(greatest(1 - past / 100000, 0), 1), 6)::DOUBLE AS quiet FROM q JOIN fl USING (capture_id, g) JOIN b USING (capture_id, g) WHERE flows >= 2 AND bytes >= 30000""")
def site_open_boundaries(spark, sf_dir):
    return rounded(sites.site_opens(packets(spark, sf_dir), "flow_id", 6 * HOUR, 24 * HOUR, 48 * HOUR, 1, 2, 30000, 100000.0))


@query("")
def block_suppression(spark, sf_dir):
    return rounded(sites.suppress_in_blocks(packets(spark, sf_dir).withColumn("score", F.col("length").cast("double")), 12 * HOUR, 48 * HOUR, HOUR))


@query(f"WITH {P}, f AS (SELECT capture_id, min(ts) AS t0, max(ts) AS t1 FROM p GROUP BY 1), o AS (SELECT unnest([0, 901, 902, 903]) AS rank, unnest([0.0, -86400.0, 3600.0, 99999999.0]) AS d) SELECT capture_id, rank::INT AS rank, round(greatest(t0, least(t1, t0 + 43200 + d)), 6) AS ts FROM f, o")
def oracle_jitter_anchors(spark, sf_dir):
    a = packets(spark, sf_dir).groupBy("capture_id").agg(F.min("ts").alias("capture_start"), F.max("ts").alias("capture_end")).withColumn("anchor", F.col("capture_start") + 12 * HOUR)
    return rounded(sites.jitter_anchors(a, [-86400.0, 3600.0, 99999999.0]))


@query(f"WITH {P}, f AS (SELECT capture_id, max(ts) AS o, CASE WHEN capture_id % 4 = 0 THEN NULL WHEN capture_id % 4 = 1 THEN 0 WHEN capture_id % 4 = 2 THEN max(ts) + 1 ELSE max(ts) + 9 END AS d FROM p GROUP BY 1) SELECT capture_id, round(CASE WHEN d IS NOT NULL AND d <> 0 AND d >= o AND d <= o + 2 THEN d ELSE o END, 6) AS capture_end FROM f")
def capture_end_resolution(spark, sf_dir):
    o = packets(spark, sf_dir).groupBy("capture_id").agg(F.max("ts").alias("o"))
    k = F.col("capture_id") % 4
    declared = F.when(k == 1, 0.0).when(k == 2, F.col("o") + 1).when(k == 3, F.col("o") + 9)
    return rounded(o.select("capture_id", sites.capture_end(declared, F.col("o")).alias("capture_end")))


@query("")
def operation_units(spark, sf_dir):
    return rounded(sites.units(packets(spark, sf_dir), 12 * HOUR, 72 * HOUR))


@query("")
def causal_audit(spark, sf_dir):
    return sites.causal_audit(block_suppression(spark, sf_dir), 12 * HOUR - 1e-3)


@query(f"""WITH {P}, a AS (SELECT capture_id, min(ts) AS anchor, max(ts) AS e FROM p GROUP BY 1), w AS (SELECT capture_id, unnest([24.0, 48.0, 96.0]) AS h, anchor, e FROM a), x AS (SELECT capture_id, h, anchor AS s, least(anchor + h * 3600, e) AS z FROM w)
SELECT capture_id, count(*) AS n_rows, count(DISTINCT h) AS n_windows, count(*) = count(DISTINCT h) AS "unique", bool_and(z >= s) AS ordered, round(max(z) - min(s), 6) AS span FROM x GROUP BY 1""")
def mother_table_audit(spark, sf_dir):
    w = windows.fixed_windows(windows.anchors_at_start(packets(spark, sf_dir)), [24 * HOUR, 48 * HOUR, 96 * HOUR])
    return rounded(audits.table_audit(w, ["capture_id"], "window_name", "start", "end"))


@query(f"WITH {P}, s AS (SELECT capture_id, flow_id, count(*) FILTER (proto = 'TCP') / count(*) AS tcp, count(*) FILTER (proto = 'UDP') / count(*) AS udp FROM p GROUP BY ALL), m AS (SELECT capture_id, quantile_cont(tcp, 0.5) AS tcp, quantile_cont(udp, 0.5) AS udp FROM s GROUP BY 1) SELECT capture_id, CASE WHEN greatest(tcp, udp) < 0.8 THEN 'mixed' WHEN tcp >= udp THEN 'tcp' ELSE 'udp' END AS dominant FROM m")
def transport_dominance(spark, sf_dir):
    p = packets(spark, sf_dir)
    share = lambda k: F.count_if(F.col("proto") == k) / F.count("*")
    rows = p.groupBy("capture_id", "flow_id").agg(share("TCP").alias("tcp"), share("UDP").alias("udp"))
    return audits.dominance(rows, "capture_id", ["tcp", "udp"], 0.8)


@query("SELECT count(*) FILTER (w AND h) AS matched, count(*) FILTER (h IS NULL) AS missing, count(*) FILTER (w IS NULL) AS outside FROM (SELECT doc_id, TRUE AS w FROM documents) FULL JOIN (SELECT doc_id, TRUE AS h FROM labels) USING (doc_id)")
def reuse_coverage(spark, sf_dir):
    return audits.reuse_coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(_TOK + ", s AS (SELECT family, count(DISTINCT sample) AS size FROM tk GROUP BY 1), c AS (SELECT family, token, count(DISTINCT sample) / any_value(size) AS cov, any_value(size) AS size FROM tk JOIN s USING (family) GROUP BY ALL), b AS (SELECT family, max(cov) AS best FROM c WHERE size >= 4 GROUP BY 1) SELECT count(*) AS families, round(avg(best), 6) AS cohesion FROM b")
def cluster_quality(spark, sf_dir):
    counts, sizes = _counts(spark, sf_dir)
    return rounded(audits.cohesion(families.coverage(counts, sizes), sizes))


@query(_TOK + ", s AS (SELECT family, count(DISTINCT sample) AS size FROM tk GROUP BY 1), c AS (SELECT family, token, count(DISTINCT sample) AS n, any_value(size) AS size FROM tk JOIN s USING (family) GROUP BY family, token), k AS (SELECT *, count(*) OVER (PARTITION BY token) AS fams FROM c WHERE n >= greatest(2, ceil(size * 0.05))) SELECT family, count(*) AS n_core, count(*) FILTER (fams = 1) AS n_unique FROM k GROUP BY 1")
def shared_support(spark, sf_dir):
    counts, sizes = _counts(spark, sf_dir)
    return audits.shared_support(counts.join(sizes, "family"), 0.05)


@query("WITH e AS (SELECT unnest(range(0, 64)) AS d, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT 'f' || a.d AS a, 'f' || b.d AS b, round(corr(a.x, b.x), 6) AS r FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.d < b.d GROUP BY ALL")
def feature_correlations(spark, sf_dir):
    names = [f"f{i}" for i in range(64)]
    rows = table(spark, sf_dir, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return rounded(audits.correlations(rows, names))


@query("SELECT doc_id, substr(sha1(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')), 1, 24) AS key FROM documents")
def sample_key_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sample_key("doc_id", "lang", "source").alias("key"))


@query("")
def token_clusters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")), lambda x: x != "")
    return audits.cluster_by_tokens(d.select(F.concat_ws("-", "source", "lang").alias("block"), F.col("doc_id").alias("sample"), words.alias("words")), "block", 0.75)
