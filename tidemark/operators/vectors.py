"""Feature vectors in long form (id, label, dim, x): effect sizes, prototypes and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import safe_div


def long_form(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.posexplode(F.col(vector_col).cast("array<double>")).alias("dim", "x"))


def eta_squared(rows: DataFrame) -> DataFrame:
    """(dim, eta2): sum of squares between labels over the total."""
    per = rows.groupBy("dim", "label").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    agg = per.groupBy("dim").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("q").alias("q"))
    mean = F.col("s") * F.col("s") / F.col("n")
    return agg.select("dim", safe_div(F.col("b") - mean, F.col("q") - mean).alias("eta2"))


def fisher_score(rows: DataFrame) -> DataFrame:
    """(dim, fisher): weighted spread of label means over weighted variance within labels."""
    per = rows.groupBy("dim", "label").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    whole = rows.groupBy("dim").agg(F.avg("x").alias("g"))
    return per.join(whole, "dim").groupBy("dim").agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("g"), 2)) / (F.sum(F.col("n") * F.col("v")) + 1e-12)).alias("fisher"))


def prototypes(rows: DataFrame) -> DataFrame:
    """(label, dim, m): mean vectors; one row a label and dimension."""
    return rows.groupBy("label", "dim").agg(F.avg("x").alias("m"))


def nearest_prototype(vectors: DataFrame, rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, nearest, distance): the label whose mean is nearest. The means, a vector a label, meet every row; rows are not exploded."""
    means = prototypes(rows).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p["m"]).alias("m"))
    all_means = means.agg(F.collect_list(F.struct("label", "m")).alias("ms"))

    def distance(v, m):
        return F.sqrt(F.aggregate(F.zip_with(v, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    v = F.col(vector_col).cast("array<double>")
    best = F.array_min(F.transform("ms", lambda p: F.struct(distance(v, p["m"]).alias("d"), p["label"].alias("label"))))
    return vectors.join(F.broadcast(all_means)).select(F.col(id_col).alias("id"), best.alias("b")).select("id", F.col("b.label").alias("nearest"), F.col("b.d").alias("distance"))


def kth_distance(queries: DataFrame, reference: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(id, distance): distance to the k-th nearest of a reference sample whose size is a parameter of the caller."""
    ref = reference.agg(F.collect_list(F.col(vector_col).cast("array<double>")).alias("ref"))
    v = F.col(vector_col).cast("array<double>")

    def distance(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    # the reference sample is bounded
    return queries.join(F.broadcast(ref)).select(F.col(id_col).alias("id"), F.get(F.array_sort(F.transform("ref", lambda r: distance(v, r))), F.lit(k - 1)).alias("distance"))


def stratified_folds(rows: DataFrame, stratum: str, id_col: str, k: int) -> DataFrame:
    """rows with fold 0 .. k-1, dealt in turn within each stratum in the order of a hash of the id."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col)
    return rows.withColumn("fold", (F.row_number().over(w) - 1) % k)
