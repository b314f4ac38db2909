"""Models over feature vectors on pyspark.ml: scaling, classifiers, blends and clusters. Rows-only queries: the numbers are the trainer's own."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.operators.vectors import stratified_folds
from tidemark.plans.mapping import P, packets, rounded, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _features(spark: SparkSession, sf_dir: str, n: int = 64) -> tuple[DataFrame, list[str]]:
    e = table(spark, sf_dir, "embeddings")
    names = [f"f{i}" for i in range(n)]
    rows = e.select("vec_id", (F.col("label") < 5).cast("double").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return stratified_folds(rows, "y", "vec_id", 3), names


def out_of_fold(rows: DataFrame, names: list[str], estimator, folds: int = 3) -> DataFrame:
    """(vec_id, y, score): each fold scored by the model fitted on the others; medians and scales are the training folds'."""
    out = None
    for k in range(folds):
        chain = Pipeline(stages=[Imputer(strategy="median", inputCols=names, outputCols=names), VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), estimator])
        scored = chain.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)).select("vec_id", "y", vector_to_array("probability").getItem(1).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


@query("")
def logistic_out_of_fold(spark, sf_dir):
    """Classes weigh the same: a row's weight is the number of rows over twice its class's."""
    rows, names = _features(spark, sf_dir)
    n = rows.groupBy("y").agg(F.count("*").alias("own"))
    total = n.agg(F.sum("own").alias("all"))  # two rows, and one
    weighed = rows.join(F.broadcast(n), "y").join(F.broadcast(total)).withColumn("weight", F.col("all") / (2.0 * F.col("own"))).drop("own", "all")
    return rounded(out_of_fold(weighed, names, LogisticRegression(labelCol="y", weightCol="weight", maxIter=20)))


@query("")
def gbt_out_of_fold(spark, sf_dir):
    rows, names = _features(spark, sf_dir)
    return rounded(out_of_fold(rows, names, GBTClassifier(labelCol="y", maxIter=5, maxDepth=3, seed=42)))


@query("")
def kmeans_clusters(spark, sf_dir):
    rows, names = _features(spark, sf_dir)
    vec = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    return KMeans(k=10, seed=42, maxIter=10).fit(vec).transform(vec).select("vec_id", F.col("prediction").alias("cluster"))


@query("")
def mixture_clusters(spark, sf_dir):
    """Of the four main components of the whole vectors."""
    rows, names = _features(spark, sf_dir)
    raw = VectorAssembler(inputCols=names, outputCol="raw").transform(rows)
    vec = PCA(k=4, inputCol="raw", outputCol="features").fit(raw).transform(raw)
    return GaussianMixture(k=3, seed=42, maxIter=5).fit(vec).transform(vec).select("vec_id", F.col("prediction").alias("cluster"))


_CAND = "WITH RECURSIVE " + P + ", cd AS (SELECT capture_id AS session_id, event_id AS candidate_id, ts, ((length * 31) % 997) / 997.0::DOUBLE AS score, row_number() OVER (PARTITION BY capture_id ORDER BY ts, event_id) AS k FROM p)"


def _candidates(spark, sf_dir):
    return packets(spark, sf_dir).select(F.col("capture_id").alias("session_id"), F.col("event_id").alias("candidate_id"), "ts", (((F.col("length") * 31) % 997) / F.lit(997.0)).alias("score"))


@query(_CAND + " SELECT a.session_id, a.candidate_id, (SELECT count(*) FROM cd b WHERE b.session_id = a.session_id AND b.k < a.k AND b.score >= a.score) < 8 AS admitted FROM cd a")
def ever_admitted_topk(spark, sf_dir):
    return replay.ever_admitted(_candidates(spark, sf_dir), 8)


@query(_CAND + """, x AS (SELECT a.session_id, a.ts, a.k, (SELECT list_sort(list(b.score), 'DESC')[1:2] FROM cd b WHERE b.session_id = a.session_id AND b.k <= a.k) AS t FROM cd a), q AS (SELECT session_id, ts, k, CASE WHEN len(t) = 2 THEN (t[1] + t[2]) / 2 ELSE -1 END AS pooled FROM x)
SELECT session_id, round(max(pooled), 6) AS peak, round(min(ts) FILTER (pooled >= 0.99), 6) AS alert_ts FROM q GROUP BY 1""")
def earliest_alert(spark, sf_dir):
    return rounded(replay.earliest_alert(_candidates(spark, sf_dir), 8, 0.99))


@query("")
def diverse_rank(spark, sf_dir):
    return replay.diverse_rank(_candidates(spark, sf_dir), 86400.0)


@query(_CAND + """, f AS (SELECT session_id, k, ts, ts AS kept, candidate_id FROM cd WHERE k = 1 UNION ALL SELECT c.session_id, c.k, c.ts, CASE WHEN c.ts - f.kept <= 86400 THEN f.kept ELSE c.ts END, c.candidate_id FROM f JOIN cd c ON c.session_id = f.session_id AND c.k = f.k + 1)
SELECT session_id, round(kept, 6) AS ts, count(*) AS merged FROM f GROUP BY session_id, kept""")
def alert_boundaries(spark, sf_dir):
    return rounded(replay.merge_boundaries(_candidates(spark, sf_dir), 86400.0))


@query(_CAND + ", bd AS (SELECT session_id, ts, candidate_id AS boundary FROM cd WHERE candidate_id % 10 = 0) SELECT c.session_id, round(c.ts, 6) AS ts, c.candidate_id, coalesce(b.boundary, -1) AS boundary FROM cd c ASOF LEFT JOIN bd b ON c.session_id = b.session_id AND c.ts >= b.ts")
def as_of_boundary(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    bounds = rows.where("candidate_id % 10 = 0").select("session_id", "ts", F.col("candidate_id").alias("boundary"))
    return rounded(replay.as_of(rows.select("session_id", "ts", "candidate_id"), bounds, "session_id", "boundary").withColumn("boundary", F.coalesce("boundary", F.lit(-1))))
