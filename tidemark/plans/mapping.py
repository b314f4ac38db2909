"""The driver's tables in the shapes that operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600.0
ROLES = ["view", "click", "purchase", "signup", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as packets: a capture is a user, a flow is a user's k, seconds since the epoch."""
    e = table(spark, sf_dir, "events")
    length = F.floor(F.col("value") * 100).cast("int")
    return e.select(
        "event_id", F.col("user_id").alias("capture_id"), (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / F.lit(1e6)).alias("ts"), length.alias("length"), F.col("event_type").alias("role"),
        F.when(F.col("event_type").isin("click", "signup", "purchase"), "up").otherwise("down").alias("direction"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("flow_id"),
        F.when(F.col("event_id") % 5 == 0, 0).otherwise(length).alias("payload_len"), F.when(F.col("event_id") % 3 == 0, "UDP").otherwise("TCP").alias("proto"))


P = """p AS (
  SELECT event_id, user_id AS capture_id, epoch_us(ts) / 1e6 AS ts, CAST(floor(value * 100) AS INT) AS length, event_type AS role,
    CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 'up' ELSE 'down' END AS direction,
    user_id || ':' || json_extract_string(props, '$.k') AS flow_id,
    CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(floor(value * 100) AS INT) END AS payload_len,
    CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS proto
  FROM events)"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for comparison between engines."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as predictions: y is quality, the score a fixed function of the ids, the group the document's source."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    score = F.floor((F.col("quality") * 300 + (F.col("doc_id") * 7919) % 701) / 10) / F.lit(100.0)
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("capture_id"), F.col("quality").alias("y"), score.alias("score"), F.col("source").alias("grp"))


PREDICTIONS = """pr AS (
  SELECT doc_id AS capture_id, quality AS y, floor((quality * 300 + (doc_id * 7919) % 701) / 10) / 100.0::DOUBLE AS score, source AS grp
  FROM labels JOIN documents USING (doc_id))"""


def group_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, weight): 1 over the number of labelled documents of the source."""
    rows = predictions(spark, sf_dir)
    return rows.join(rows.groupBy("grp").agg(F.count("*").alias("n")), "grp").select(F.col("capture_id").alias("id"), (1 / F.col("n")).alias("weight"))
