"""Comparing groupings: pair metrics of families, ordered merge rules, agreement of two labellings, screens of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons for a merge of two families, first match wins: (name, measure, least). Fixed values are the names.
MERGE_RULES = (("same_script", "shared_scripts", 2.0), ("same_backend", "shared_backends", 1.0), ("near_dom", "dom", 0.9), ("near_text", "text", 0.8))


def pair_metrics(tokens: DataFrame, channels: list[str], most: int = 1000) -> DataFrame:
    """(a, b, shared_<channel>, <channel>...): for each pair of families that share a token, shared tokens and Jaccard overlap of each channel.

    tokens: distinct (family, channel, token). Pairs come from equi-joins on
    tokens, not from all pairs. Tokens of more than ``most`` families are left
    to a second step: they make no pair, but count in the pairs made by others.
    """
    held = tokens.where(F.col("channel").isin(*channels)).select("family", "channel", "token").distinct()
    df = held.groupBy("channel", "token").agg(F.count("*").alias("df"))
    seeds = held.join(df.where(F.col("df").between(2, most)), ["channel", "token"]).drop("df")
    x, y = seeds.select("channel", "token", F.col("family").alias("a")), seeds.select("channel", "token", F.col("family").alias("b"))
    pairs = x.join(y, ["channel", "token"]).where("a < b")
    rare = pairs.groupBy("a", "b", "channel").agg(F.count("*").alias("shared"))
    common = held.join(df.where(F.col("df") > most), ["channel", "token"]).drop("df")
    known = rare.select("a", "b").distinct()
    ca, cb = common.select("channel", "token", F.col("family").alias("a")), common.select(F.col("channel").alias("ch"), F.col("token").alias("tk"), F.col("family").alias("b"))
    more = known.join(ca, "a").join(cb.withColumnRenamed("b", "b2"), (F.col("b") == F.col("b2")) & (F.col("channel") == F.col("ch")) & (F.col("token") == F.col("tk"))).groupBy("a", "b", "channel").agg(F.count("*").alias("shared"))
    shared = rare.unionByName(more).groupBy("a", "b").agg(*[F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("shared"))), F.lit(0)).alias(f"shared_{c}") for c in channels])
    sizes = held.groupBy("family").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in channels])
    left, right = sizes.withColumnsRenamed({"family": "a", **{c: f"_a_{c}" for c in channels}}), sizes.withColumnsRenamed({"family": "b", **{c: f"_b_{c}" for c in channels}})
    rows = shared.join(left, "a").join(right, "b")
    union = lambda c: F.col(f"_a_{c}") + F.col(f"_b_{c}") - F.col(f"shared_{c}")
    return rows.select("a", "b", *[f"shared_{c}" for c in channels], *[F.when(union(c) > 0, F.col(f"shared_{c}") / union(c)).otherwise(0.0).alias(c) for c in channels])


def merge_reason(measures: dict[str, Column], rules=MERGE_RULES) -> Column:
    """The name of the first rule whose measure reaches its least value, null for none."""
    out = None
    for name, measure, least in rules:
        hit = measures[measure] >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def family_summary(rows: DataFrame, family: str, columns: list[str]) -> DataFrame:
    """Per family: rows, and for each column the number of different values and the sorted values joined by a bar."""
    aggs = [F.count("*").alias("size")]
    for c in columns:
        aggs += [F.countDistinct(c).alias(f"n_{c}"), F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c)]
    return rows.groupBy(family).agg(*aggs)


def repeated_support(tokens: DataFrame, least: int = 2) -> DataFrame:
    """(family, samples, keys, channels, covered): tokens met in ``least`` samples or more, their channels, and the samples that have one.

    tokens: distinct (family, sample, channel, token).
    """
    whole = tokens.groupBy("family").agg(F.countDistinct("sample").alias("samples"))
    keys = tokens.groupBy("family", "channel", "token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    mine = tokens.join(keys.drop("n"), ["family", "channel", "token"])
    found = mine.groupBy("family").agg(F.countDistinct("channel", "token").alias("keys"), F.countDistinct("channel").alias("channels"), F.countDistinct("sample").alias("in_samples"))
    rows = whole.join(found, "family", "left").na.fill(0, ["keys", "channels", "in_samples"])
    return rows.select("family", "samples", "keys", "channels", (F.col("in_samples") / F.col("samples")).alias("covered"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(nmi, ari) of two labellings, from their contingency table: mutual information over the mean entropy, and the adjusted Rand index.

    Null labels are a label. Both are 1 where each labelling is one group.
    """
    cells = rows.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("")).alias("b")).agg(F.count("*").alias("n"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    n = cells.agg(F.sum("n").cast("double").alias("t"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    # the totals are one row
    mi = cells.join(ra, "a").join(rb, "b").join(F.broadcast(n)).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na").cast("double") * F.col("nb")))).alias("mi"), F.sum(two("n")).alias("pairs"), F.first("t").alias("t"))
    ha = ra.join(F.broadcast(n)).agg(F.sum(-F.col("na") / F.col("t") * F.log(F.col("na") / F.col("t"))).alias("ha"), F.sum(two("na")).alias("pa"))
    hb = rb.join(F.broadcast(n)).agg(F.sum(-F.col("nb") / F.col("t") * F.log(F.col("nb") / F.col("t"))).alias("hb"), F.sum(two("nb")).alias("pb"))
    one = mi.join(F.broadcast(ha)).join(F.broadcast(hb))
    mean, want = (F.col("ha") + F.col("hb")) / 2, F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    top = (F.col("pa") + F.col("pb")) / 2 - want
    return one.select(F.when(mean > 0, F.col("mi") / mean).otherwise(1.0).alias("nmi"), F.when(top != 0, (F.col("pairs") - want) / top).otherwise(1.0).alias("ari"))


def keep_top_share(scores: DataFrame, score: str, share: float, name: str = "feature") -> DataFrame:
    """scores with kept: the ceil(share * n) features of the highest score, ties by name; a row a feature."""
    n = scores.agg(F.ceil(F.count("*") * F.lit(share)).alias("_m"))
    place = F.row_number().over(Window.orderBy(F.col(score).desc(), name))  # one row a feature
    return scores.withColumn("_p", place).join(F.broadcast(n)).withColumn("kept", F.col("_p") <= F.col("_m")).drop("_p", "_m")


def binned_information(rows: DataFrame, name: str, x: str, y: str, bins: int = 16) -> DataFrame:
    """(name, mi): mutual information, in nats, of each feature's quantile bin with a label.

    Bins are cut at exact percentiles of the feature, equal cuts as one; this
    is a histogram estimate, not one by nearest neighbours. rows are (name, x,
    y), one a feature and sample; null x are left out.
    """
    some = rows.where(F.col(x).isNotNull())
    cuts = some.groupBy(name).agg(F.percentile(x, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("cuts"))
    binned = some.join(cuts, name).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(x))))
    cells = binned.groupBy(name, "bin", y).agg(F.count("*").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy(name, *k))
    p = cells.select(name, "n", by().alias("t"), by("bin").alias("nb"), by(y).alias("ny"))
    return p.groupBy(name).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb").cast("double") * F.col("ny")))).alias("mi"))


def partition_metrics(rows: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Per key: specificity, and of the candidates' number the median and 90th percentile; rows have y, score and n_candidates."""
    neg = F.col("y") == 0
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.count_if(neg & (F.col("score") < threshold)) / F.nullif(F.count_if(neg), F.lit(0)), F.lit(0.0)).alias("specificity"), F.percentile("n_candidates", F.lit(0.5)).alias("candidates_median"), F.percentile("n_candidates", F.lit(0.9)).alias("candidates_p90"))


def blend_search(rows: DataFrame, grid: list[float], threshold: float) -> DataFrame:
    """(weight, f1) of weight * a + (1 - weight) * b against y at the threshold, for each weight of the grid.

    The grid is exploded beside each row and summed at once; its size is the
    caller's list.
    """
    w = rows.withColumn("weight", F.explode(F.array(*map(F.lit, grid))))
    hit, pos = F.col("weight") * F.col("a") + (1 - F.col("weight")) * F.col("b") >= threshold, F.col("y") == 1
    agg = w.groupBy("weight").agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    total = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return agg.select("weight", F.when(total > 0, 2 * F.col("tp") / total).otherwise(0.0).alias("f1"))


def dual_support(distance: Column, limit: Column, score: Column, threshold: float) -> Column:
    """accepted, unsupported or rejected: over the threshold and near enough, over it but far, or below it."""
    return F.when(score < threshold, "rejected").when(distance <= limit, "accepted").otherwise("unsupported")


def odds_weights(p: Column, low: float = 0.1, high: float = 10.0) -> Column:
    """Covariate-shift weight of a row from the probability that it is of the target: clipped odds."""
    return F.least(F.greatest(p / F.greatest(1 - p, F.lit(1e-6)), F.lit(low)), F.lit(high))


def metric_weights(rows: DataFrame, weight: str, name: str = "feature") -> DataFrame:
    """(name, weight): square roots of weights + 0.05 over their mean, clipped to 0.25 to 4; a row a feature."""
    root = F.sqrt(F.col(weight) + 0.05)
    mean = rows.agg(F.avg(root).alias("_m"))
    return rows.join(F.broadcast(mean)).select(name, F.least(F.greatest(root / F.col("_m"), F.lit(0.25)), F.lit(4.0)).alias("weight"))


def seconds_until_emit(emit: Column, window_end: Column) -> Column:
    """When a window's features are available: the later of its emission and its end."""
    return F.greatest(emit, window_end)
