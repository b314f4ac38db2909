"""Queries over labels as predictions, and over events as scored candidates: metrics, thresholds, pooling and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics, weights
from tidemark.plans.mapping import PREDICTIONS, P, group_weights, packets, predictions, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str, base: str = PREDICTIONS):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = "WITH " + base + sql
        return f
    return add


def _weighted(spark, sf_dir):
    return metrics.with_weights(metrics.canonical_predictions(predictions(spark, sf_dir)), group_weights(spark, sf_dir))


_COUNTS = "count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 1 AND score < 0.5) AS fn"
_W = ", w AS (SELECT pr.*, 1.0::DOUBLE / count(*) OVER (PARTITION BY grp) AS weight FROM pr)"
_RATES = """, m AS (SELECT {key}{counts}, coalesce(sum(weight) FILTER (y = 1 AND score >= 0.5), 0) AS a, coalesce(sum(weight) FILTER (y = 0 AND score >= 0.5), 0) AS b, coalesce(sum(weight) FILTER (y = 0), 0) AS n, coalesce(sum(weight) FILTER (y = 1), 0) AS q FROM w {group}),
k AS (SELECT *, CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END AS pp, CASE WHEN q > 0 THEN a / q ELSE 0 END AS rr FROM m)
SELECT {key}tp, fp, tn, fn, round(pp, 6) AS precision, round(rr, 6) AS recall, round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS f1, round(CASE WHEN n > 0 THEN b / n ELSE 'NaN'::DOUBLE END, 6) AS fpr FROM k"""


@query(_W + _RATES.format(key="", counts=_COUNTS, group=""))
def verify_weighted_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(_weighted(spark, sf_dir), 0.5))


@query(", w AS (SELECT *, 1.0::DOUBLE AS weight FROM pr)" + _RATES.format(key="grp, ", counts=_COUNTS, group="GROUP BY grp"))
def metrics_by_group(spark, sf_dir):
    return rounded(metrics.binary_metrics(predictions(spark, sf_dir), 0.5, "grp"))


@query(_W + """, s AS (SELECT score, coalesce(sum(weight) FILTER (y = 1), 0) AS pos, coalesce(sum(weight) FILTER (y = 0), 0) AS neg FROM w GROUP BY 1), c AS (SELECT *, sum(pos) OVER q AS cp, sum(neg) OVER q AS cn, sum(pos) OVER () AS ap FROM s WINDOW q AS (ORDER BY score DESC))
SELECT round(sum(pos / ap * cp / (cp + cn)), 6) AS average_precision FROM c""")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_weighted(spark, sf_dir)))


@query(""", s AS (SELECT grp, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM pr GROUP BY ALL), c AS (SELECT *, sum(neg) OVER (PARTITION BY grp ORDER BY score) - neg / 2 AS below FROM s)
SELECT grp, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * below) / (sum(pos) * sum(neg)) ELSE 'NaN'::DOUBLE END, 6) AS auroc FROM c GROUP BY 1""")
def auroc_by_group(spark, sf_dir):
    return rounded(metrics.auroc(predictions(spark, sf_dir), "grp"))


@query(""", t AS (SELECT min(score) AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM pr WHERE y = 0) WHERE k >= ceil(round((n - 1) * 0.97, 9)) + 1),
c AS (SELECT threshold, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 0 AND score < threshold) AS tn, count(*) FILTER (y = 1 AND score < threshold) AS fn FROM pr, t GROUP BY 1)
SELECT *, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr FROM c""")
def recall_at_fpr(spark, sf_dir):
    return rounded(metrics.recall_at_fpr(predictions(spark, sf_dir), 0.03))


@query(""", b AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM pr WHERE y = 0)
SELECT round((SELECT quantile_cont(score, 0.97) FROM pr WHERE y = 0), 6) AS linear, (SELECT min(score) FROM b WHERE k >= ceil(round((n - 1) * 0.97, 9)) + 1) AS higher, (SELECT min(score) FROM b WHERE k >= floor(round((n - 1) * 0.97, 9)) + 1) AS lower,
round((SELECT quantile_cont(score, 0.1) FROM pr WHERE y = 1), 6) AS for_recall, round((SELECT max(q) FROM (SELECT quantile_cont(score, 0.97) AS q FROM pr WHERE y = 0 GROUP BY grp)), 6) AS stratified""")
def threshold_rules(spark, sf_dir):
    return rounded(metrics.thresholds(predictions(spark, sf_dir), 0.03, 0.9, "grp"))


@query(""", c AS (SELECT score FROM pr WHERE y = 0 AND capture_id % 2 = 0) SELECT capture_id, round((1 + (SELECT count(*) FROM c WHERE c.score >= pr.score)) / (1 + (SELECT count(*) FROM c)), 6) AS p_value FROM pr""")
def conformal_pvalues(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return rounded(metrics.conformal_p(rows, rows.where((F.col("y") == 0) & (F.col("capture_id") % 2 == 0))).select("capture_id", "p_value"))


_CAND = ", cd AS (SELECT capture_id AS session_id, event_id % 7 AS candidate_id, ts, ((length * 31) % 997) / 997.0::DOUBLE AS score FROM p)"


def _candidates(spark, sf_dir):
    return packets(spark, sf_dir).select(F.col("capture_id").alias("session_id"), (F.col("event_id") % 7).alias("candidate_id"), "ts", (((F.col("length") * 31) % 997) / F.lit(997.0)).alias("score"))


@query(_CAND + """, m AS (SELECT session_id, candidate_id, max(score) AS score FROM cd GROUP BY ALL), l AS (SELECT session_id, list_sort(list(score), 'DESC') AS t FROM m GROUP BY 1)
SELECT session_id, round(t[1], 6) AS max_score, round(list_avg(t[1:3]), 6) AS topk_mean, round(CASE WHEN len(t) >= 2 THEN list_avg(t[1:2]) ELSE -1 END, 6) AS top2_mean FROM l""", P)
def session_pooling(spark, sf_dir):
    return rounded(metrics.pooled_scores(_candidates(spark, sf_dir)))


@query(_CAND + """, b AS (SELECT session_id, candidate_id, min(ts) AS ts, max(score) AS score FROM cd GROUP BY ALL), t AS (SELECT session_id, avg(ts) AS true_ts FROM cd GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, candidate_id) AS k FROM b), e AS (SELECT *, abs(ts - true_ts) AS err FROM r JOIN t USING (session_id) WHERE k <= 3)
SELECT session_id, bool_or(k <= 1 AND err <= 86400) AS hit_1_86400, bool_or(k <= 1 AND err <= 864000) AS hit_1_864000, bool_or(err <= 86400) AS hit_3_86400, bool_or(err <= 864000) AS hit_3_864000, round(min(err) FILTER (k = 1), 3) AS error_1 FROM e GROUP BY 1""", P)
def hit_at_k(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    best = rows.groupBy("session_id", "candidate_id").agg(F.min("ts").alias("ts"), F.max("score").alias("score"))
    truth = rows.groupBy("session_id").agg(F.avg("ts").alias("true_ts"))
    return rounded(metrics.hit_at_k(best, truth, [1, 3], [86400, 864000]), 3).withColumnsRenamed({"hit_1_864000": "hit_1_864000"})


@query(", r AS (SELECT event_id, capture_id AS session_id, CASE WHEN role = 'error' THEN 1 ELSE 0 END AS y FROM p), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY session_id) AS u FROM r) SELECT event_id, y, round(u / sum(u) OVER (PARTITION BY y) * count(*) OVER () / 2, 6) AS weight FROM w", P)
def session_weights(spark, sf_dir):
    rows = packets(spark, sf_dir).select("event_id", F.col("capture_id").alias("session_id"), F.when(F.col("role") == "error", 1).otherwise(0).alias("y"))
    return rounded(weights.session_normalised(rows).select("event_id", "y", "weight"))


@query(" SELECT y, round(sum(count(*)) OVER () / (2 * count(*)), 6)::DOUBLE AS weight FROM pr GROUP BY 1")
def class_weights(spark, sf_dir):
    return rounded(weights.balanced_classes(predictions(spark, sf_dir)))


@query(", g AS (SELECT grp, count(*) AS n FROM pr GROUP BY 1), c AS (SELECT *, least(greatest(avg(n) OVER () / n, 1 / 3.0::DOUBLE), 3.0::DOUBLE) AS r FROM g) SELECT grp, n, round((sum(n) OVER () / count(*) OVER () / n)::DOUBLE, 6) AS equal_weight, round((r * sum(n) OVER () / sum(r * n) OVER ())::DOUBLE, 6) AS bounded_weight FROM c")
def group_weights_bounded(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    equal = weights.group_equalised(rows, "grp").withColumnRenamed("weight", "equal_weight")
    return rounded(equal.join(weights.bounded_inverse(rows, "grp", 3.0).select("grp", F.col("weight").alias("bounded_weight")), "grp"))


@query(", e AS (SELECT event_id, ts, CASE WHEN role = 'error' THEN 1 ELSE 0 END AS y FROM p), w AS (SELECT *, exp(-((SELECT max(ts) FROM e) - ts) / 604800.0::DOUBLE) AS u FROM e), s AS (SELECT *, u * count(*) OVER (PARTITION BY y) / sum(u) OVER (PARTITION BY y) AS weight FROM w) SELECT y, round(pow(sum(weight), 2) / sum(weight * weight), 4) AS ess FROM s GROUP BY 1", P)
def recency_effective_size(spark, sf_dir):
    rows = packets(spark, sf_dir).select("event_id", "ts", F.when(F.col("role") == "error", 1).otherwise(0).alias("y"))
    return rounded(weights.effective_size(weights.recency(rows, "ts", 604800.0), "y"), 4)
