"""Sample weights for training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp, safe_div


def session_normalised(rows: DataFrame, session: str = "session_id", label: str = "y") -> DataFrame:
    """rows with weight: 1 over the session's rows, each class half of the mass, mean 1 over all rows.

    Counts come from aggregations, so a hot session is summed before the shuffle.
    """
    per = rows.groupBy(session).agg(F.count("*").alias("_n"))
    weighed = rows.join(per, session).withColumn("_w", 1 / F.col("_n"))
    mass = weighed.groupBy(label).agg(F.sum("_w").alias("_mass"))
    total = rows.agg(F.count("*").alias("_all"))
    classes = mass.agg(F.count("*").alias("_classes"))
    # a row a class, and single rows
    return weighed.join(F.broadcast(mass), label).join(F.broadcast(total)).join(F.broadcast(classes)).withColumn("weight", F.col("_w") / F.col("_mass") * F.col("_all") / F.col("_classes")).drop("_n", "_w", "_mass", "_all", "_classes")


def balanced_classes(rows: DataFrame, label: str = "y") -> DataFrame:
    """(label, weight): n / (2 n_c)."""
    per = rows.groupBy(label).agg(F.count("*").alias("n"))
    return per.select(label, (F.sum("n").over(Window.partitionBy()) / (2 * F.col("n"))).alias("weight"))


def group_equalised(rows: DataFrame, group: str) -> DataFrame:
    """(group, n, weight): every group has the same mass, mean 1."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    return per.select(group, "n", (F.sum("n").over(whole) / F.count("*").over(whole) / F.col("n")).alias("weight"))


def recency(rows: DataFrame, ts: str, tau: float, label: str = "y") -> DataFrame:
    """rows with weight exp(-age / tau), rescaled so that each label keeps its number of rows as mass; age from the latest ts."""
    newest = rows.agg(F.max(ts).alias("_new"))
    aged = rows.join(F.broadcast(newest)).withColumn("_w", F.exp(-(F.col("_new") - F.col(ts)) / F.lit(float(tau))))
    mass = aged.groupBy(label).agg((F.count("*") / F.sum("_w")).alias("_k"))
    return aged.join(F.broadcast(mass), label).withColumn("weight", F.col("_w") * F.col("_k")).drop("_new", "_w", "_k")


def bounded_inverse(rows: DataFrame, group: str, bound: float) -> DataFrame:
    """(group, n, weight): mean count over count, clipped to [1/bound, bound], then mean 1 over rows."""
    per = rows.groupBy(group).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    raw = clamp(F.avg("n").over(whole) / F.col("n"), 1 / bound, bound)
    per = per.withColumn("raw", raw)
    return per.select(group, "n", (F.col("raw") * F.sum("n").over(whole) / F.sum(F.col("raw") * F.col("n")).over(whole)).alias("weight"))


def effective_size(weights: DataFrame, *keys: str) -> DataFrame:
    return weights.groupBy(*keys).agg(safe_div(F.pow(F.sum("weight"), 2), F.sum(F.col("weight") * F.col("weight"))).alias("ess"))
