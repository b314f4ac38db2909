"""Verification metrics of scored predictions: (y, score, weight) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import safe_div

#: Accepted names of each field, first match wins. Fixed values.
ALIASES = {"id": ("capture_id", "sample_id"), "y": ("y", "label", "y_true", "truth"), "score": ("session_score", "score", "prob_1", "phishing_probability")}


def first_column(df: DataFrame, names) -> str:
    """The first of the names that df has; an error if none."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)} in {', '.join(df.columns)}")


def canonical_predictions(df: DataFrame) -> DataFrame:
    """(id, y, score): aliases resolved; labels are numbers or benign / phishing, anything else is an error at run time."""
    i, y, s = (first_column(df, ALIASES[k]) for k in ("id", "y", "score"))
    text = F.lower(F.trim(F.col(y).cast("string")))
    value = F.coalesce(F.try_to_number(text, F.lit("9")).cast("int"), F.expr(f"try_cast(`{y}` AS double)").cast("int"), F.when(text == "phishing", 1).when(text == "benign", 0))
    checked = F.when(value.isin(0, 1), value).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(text, F.lit("null")))).cast("int"))
    return df.select(F.col(i).alias("id"), checked.alias("y"), F.col(s).cast("double").alias("score"))


def lenient_label(col: Column) -> Column:
    """1 for phishing, phish, malicious, 1 or true in any case, else 0."""
    return F.when(F.lower(F.trim(col.cast("string"))).isin("phishing", "phish", "malicious", "1", "true"), 1).otherwise(0)


def with_weights(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """predictions with weight by id; an id without a weight, or with two, is an error at run time."""
    per = weights.groupBy("id").agg(F.first("weight").alias("weight"), F.count("*").alias("n"))
    rows = predictions.join(per, "id", "left")
    bad = F.col("weight").isNull() | (F.col("n") != 1)
    return rows.withColumn("weight", F.when(bad, F.raise_error(F.concat(F.lit("no single weight for "), F.col("id").cast("string"))).cast("double")).otherwise(F.col("weight"))).drop("n")


def binary_metrics(rows: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Confusion counts and weighted precision, recall, F1 and FPR; 0 for an empty denominator, NaN for FPR without benign weight."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    w = F.col("weight") if "weight" in rows.columns else F.lit(1.0)

    def mass(cond):
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0))

    agg = rows.groupBy(*keys).agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"),
        mass(pos & hit).alias("wtp"), mass(~pos & hit).alias("wfp"), mass(~pos).alias("wneg"), mass(pos).alias("wpos"))
    p, r = safe_div(F.col("wtp"), F.col("wtp") + F.col("wfp")), safe_div(F.col("wtp"), F.col("wpos"))
    return agg.select(*keys, "tp", "fp", "tn", "fn", p.alias("precision"), r.alias("recall"), safe_div(2 * p * r, p + r).alias("f1"), F.when(F.col("wneg") > 0, F.col("wfp") / F.col("wneg")).otherwise(float("nan")).alias("fpr"))


def running_sums(at: DataFrame, order: str, sums: dict[str, str], keys: tuple[str, ...] = (), falling: bool = False, ranges: int = 64) -> DataFrame:
    """at with running sums of columns along order, each row's own included; order has no repeats within keys.

    Values are dealt in ranges at approximate quantiles, summed within their
    range, and the totals of the ranges before, at most ``ranges`` rows a key,
    are added; no task holds more than a range.
    """
    cuts = sorted(set(at.approxQuantile(order, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    array = F.lit(cuts) if cuts else F.array().cast("array<double>")
    own = F.size(F.filter(array, lambda c: c < F.col(order)))
    rows = at.withColumn("_range", own)
    along = (lambda c: F.col(c).desc()) if falling else F.col
    within = Window.partitionBy(*keys, "_range").orderBy(along(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(along("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    # ranges times keys rows; null keys are keys
    r, t = rows.alias("r"), totals.alias("t")
    same = F.col("r._range") == F.col("t._range")
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    for n, c in sums.items():
        r = r.withColumn(f"_w_{n}", F.sum(c).over(within))
    joined = r.alias("r").join(t, same)
    return joined.select(*[F.col(f"r.{c}") for c in at.columns], *[(F.col(f"r._w_{n}") + F.col(f"t._b_{n}")).alias(n) for n in sums])


def _by_score(rows: DataFrame, *keys: str) -> DataFrame:
    """Positive and negative weight at each different score."""
    w = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    return rows.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("neg"))


def average_precision(rows: DataFrame, *keys: str) -> DataFrame:
    """Sum over falling different scores of precision times the rise in recall."""
    at = running_sums(_by_score(rows, *keys), "score", {"cp": "pos", "cn": "neg"}, keys, falling=True)
    agg = at.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("cp") / (F.col("cp") + F.col("cn"))).alias("s"), F.sum("pos").alias("p"))
    return agg.select(*keys, F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(0.0).alias("average_precision"))


def auroc(rows: DataFrame, *keys: str) -> DataFrame:
    """Area under the ROC curve with ties at half; NaN where a class is missing."""
    at = running_sums(_by_score(rows, *keys), "score", {"upto": "neg"}, keys).withColumn("below", F.col("upto") - F.col("neg") / 2)
    agg = at.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("below")).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return agg.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))).otherwise(float("nan")).alias("auroc"))


def _nth(rows: DataFrame, q: float, rule: str) -> DataFrame:
    """(value,): the q-quantile of score by the 'higher' or 'lower' rule, from counts of different scores."""
    per = rows.groupBy("score").count()
    n = per.agg(F.sum("count").alias("n"))
    place = F.round((F.col("n") - 1) * F.lit(float(q)), 9)
    k = (F.ceil(place) if rule == "higher" else F.floor(place)) + 1
    # one row meets every score
    return running_sums(per, "score", {"upto": "count"}).join(F.broadcast(n.select(k.alias("k")))).where(F.col("upto") >= F.col("k")).agg(F.min("score").alias("value"))


def recall_at_fpr(rows: DataFrame, budget: float) -> DataFrame:
    """Threshold at the benign (1 - budget) quantile, higher rule, with recall, FPR and counts at it."""
    t = _nth(rows.where("y = 0"), 1 - budget, "higher").withColumnRenamed("value", "threshold")
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    # one row meets every prediction
    agg = rows.join(F.broadcast(t)).groupBy("threshold").agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"), F.count_if(pos & ~hit).alias("fn"))
    return agg.select("threshold", "tp", "fp", "tn", "fn", safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), safe_div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def thresholds(rows: DataFrame, budget: float, recall: float, group: str) -> DataFrame:
    """One row: the benign quantile by the linear, higher and lower rules, the positive (1 - recall) quantile, and the largest of the groups' benign quantiles."""
    benign, pos = rows.where("y = 0"), rows.where("y = 1")
    linear = benign.agg(F.coalesce(F.percentile("score", F.lit(1 - budget)), F.lit(0.5)).alias("linear"))
    per = benign.groupBy(group).agg(F.percentile("score", F.lit(1 - budget)).alias("q")).agg(F.max("q").alias("stratified"))
    return (linear.join(_nth(benign, 1 - budget, "higher").withColumnRenamed("value", "higher")).join(_nth(benign, 1 - budget, "lower").withColumnRenamed("value", "lower"))
            .join(pos.agg(F.percentile("score", F.lit(1 - recall)).alias("for_recall"))).join(per))


def conformal_p(scored: DataFrame, calibration: DataFrame) -> DataFrame:
    """scored with p_value = (1 + calibration scores at or above) / (n + 1).

    Counts per different score of both, then running sums over the scores in ranges.
    """
    both = calibration.groupBy("score").agg(F.count("*").alias("n")).unionByName(scored.select("score").distinct().withColumn("n", F.lit(0).cast("long")))
    at = running_sums(both.groupBy("score").agg(F.sum("n").alias("n")), "score", {"above": "n"}, falling=True)
    at = at.join(F.broadcast(calibration.agg(F.count("*").alias("all"))))  # one row
    return scored.join(at.select("score", ((F.col("above") + 1) / (F.col("all") + 1)).alias("p_value")), "score")


def pooled_scores(candidates: DataFrame, k: int = 3) -> DataFrame:
    """Per session: largest score, mean of the k largest, and mean of the two largest per-candidate maxima, -1 with fewer than two."""
    per = candidates.groupBy("session_id", "candidate_id").agg(F.max("score").alias("score"))
    top = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, k)

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    ranked = per.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("score").desc(), "candidate_id"))).where(F.col("place") <= k)
    rows = ranked.groupBy("session_id").agg(top.alias("t"))
    return rows.select("session_id", F.get("t", F.lit(0)).alias("max_score"), mean(F.col("t")).alias("topk_mean"), F.when(F.size("t") >= 2, mean(F.slice("t", 1, 2))).otherwise(-1.0).alias("top2_mean"))


def hit_at_k(candidates: DataFrame, truth: DataFrame, ks: list[int], within: list[float]) -> DataFrame:
    """Per session: whether any of the k best candidates lies within each tolerance of the true time, and the best one's error."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("score").desc(), "candidate_id"))
    rows = candidates.withColumn("place", place).where(F.col("place") <= max(ks)).join(truth, "session_id")
    err = F.abs(F.col("ts") - F.col("true_ts"))
    return rows.groupBy("session_id").agg(*[F.bool_or((F.col("place") <= k) & (err <= d)).alias(f"hit_{k}_{d:g}") for k in ks for d in within], F.min(F.when(F.col("place") == 1, err)).alias("error_1"))
