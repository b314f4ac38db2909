"""Audits of tables and clusters: coverage, invariants, cohesion and feature selection."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.numbers import safe_div
from tidemark.operators import linkage


def reuse_coverage(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, wanted ones that are missing, and ones that are outside."""
    both = wanted.select(key).distinct().withColumn("w", F.lit(1)).join(have.select(key).distinct().withColumn("h", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("w").isNotNull() & F.col("h").isNotNull()).alias("matched"), F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("outside"))


def table_audit(rows: DataFrame, key: list[str], window: str, start: str, end: str) -> DataFrame:
    """Per key: rows, different windows, whether windows are unique, and the span from the first start to the last end."""
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.countDistinct(window).alias("n_windows"), (F.count("*") == F.countDistinct(window)).alias("unique"), F.bool_and(F.col(end) >= F.col(start)).alias("ordered"), (F.max(end) - F.min(start)).alias("span"))


def dominance(rows: DataFrame, key: str, shares: list[str], least: float) -> DataFrame:
    """(key, dominant): the share column with the largest median, if it reaches least, else mixed; the first among equals."""
    agg = rows.groupBy(key).agg(*[F.percentile(s, F.lit(0.5)).alias(s) for s in shares])
    best = F.array_max(F.array(*[F.struct(F.col(s).alias("v"), F.lit(-i).alias("o"), F.lit(s).alias("n")) for i, s in enumerate(shares)]))
    return agg.select(key, F.when(best["v"] >= least, best["n"]).otherwise("mixed").alias("dominant"))


def latency(alerts: DataFrame, start: str, alert: str) -> DataFrame:
    """One row: alerts, their median and p90 delay, and how many have none."""
    d = F.col(alert) - F.col(start)
    return alerts.agg(F.count(alert).alias("alerts"), F.count_if(F.col(alert).isNull()).alias("silent"), F.percentile(d, F.lit(0.5)).alias("p50"), F.percentile(d, F.lit(0.9)).alias("p90"))


def cohesion(coverage: DataFrame, sizes: DataFrame, least: int = 4) -> DataFrame:
    """One row: mean over families of least samples or more of their best token's coverage; rows are (family, token, coverage) and (family, size)."""
    best = coverage.groupBy("family").agg(F.max("coverage").alias("best"))
    return best.join(sizes.where(F.col("size") >= least), "family").agg(F.count("*").alias("families"), F.avg("best").alias("cohesion"))


def shared_support(coverage: DataFrame, share: float) -> DataFrame:
    """(family, n_core, n_unique): tokens that at least max(2, ceil(share * size)) samples have, and those of them that are core nowhere else; rows are (family, token, n, size)."""
    core = coverage.where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("size") * share)))
    held = core.groupBy("token").agg(F.count("*").alias("families"))
    return core.join(held, "token").groupBy("family").agg(F.count("*").alias("n_core"), F.count_if(F.col("families") == 1).alias("n_unique"))


def weighted_score(evidence: DataFrame, weights: dict[str, float], unique_bonus: float = 1.5) -> DataFrame:
    """(family, score): sum of type weight times coverage, and a bonus for each unique token; rows are (family, type, coverage, is_unique)."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("type")), F.lit(0.0))
    return evidence.groupBy("family").agg((F.sum(w * F.col("coverage")) + unique_bonus * F.count_if("is_unique")).alias("score"))


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of each pair of names, over rows without nulls in them.

    One pass sums the Gram matrix of the names; the matrix, a number a pair,
    reaches the driver. A constant column has null correlations.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    kinds = "a string, b string, r double"
    some = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).dropna()
    if len(names) < 2 or some.isEmpty():
        return rows.sparkSession.createDataFrame([], kinds)
    m = Correlation.corr(VectorAssembler(inputCols=names, outputCol="v").transform(some), "v").first()[0].toArray()
    pairs = [(a, b, None if m[i, j] != m[i, j] else float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return rows.sparkSession.createDataFrame(pairs, kinds)


def prune_correlated(rows: DataFrame, names: list[str], limit: float = 0.92) -> list[str]:
    """Names in order, but for those whose absolute correlation with an earlier kept one reaches limit; one row a pair reaches the driver."""
    high = {(r.a, r.b) for r in correlations(rows, names).collect() if r.r is not None and abs(r.r) >= limit}
    kept: list[str] = []
    for n in names:
        if not any((k, n) in high or (n, k) in high for k in kept):
            kept.append(n)
    return kept


def feature_columns(df: DataFrame, deny: list[str] = (), prefixes: list[str] = (), parts: list[str] = ()) -> list[str]:
    """Sorted numeric columns but for denied names, and names with a denied prefix or part."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return sorted(c for c, t in df.dtypes if t in numeric and c not in deny and not c.startswith(tuple(prefixes) or ("\0",)) and not any(p in c for p in parts))


def preset(columns: list[str], rule: dict) -> list[str]:
    """Columns a rule keeps: with one of its prefixes (all where there are none), with none of its dropped parts; ``base`` names a rule to start from."""
    start = preset(columns, rule["base"]) if "base" in rule else columns
    keep, drop = tuple(rule.get("prefixes", ())), rule.get("without", ())
    return [c for c in start if (not keep or c.startswith(keep)) and not any(p in c for p in drop)]


def average_linkage(distance, threshold: float) -> list[int]:
    """Cluster numbers by average linkage of a distance matrix cut at threshold, for groups of a few thousand at most."""
    import numpy as np

    d = np.array(distance, dtype=float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, member = np.ones(n), np.ones(n, dtype=bool), [[i] for i in range(n)]
    while alive.sum() > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if d[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[i] = row[j] = np.inf
        row[~alive] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        member[i] += member[j]
    out = [0] * n
    for k, i in enumerate(np.flatnonzero(alive).tolist()):
        for x in member[i]:
            out[x] = k
    return out


#: Columns of a sample looked up at once, so that memory follows the samples and not the vocabulary.
TOKENS_AT_ONCE = 4096


def cluster_by_tokens(samples: DataFrame, block: str, threshold: float) -> DataFrame:
    """(block, sample, cluster): average linkage of cosine distances of IDF vectors within each block; rows are (block, sample, words), words as an array without repeats.

    A block is a task. Its rows are streamed, first its words with their
    frequencies, those of one sample left out, then its samples, of which
    numbers of words are kept: memory follows the block's words, not its pairs.
    """
    repeated = not samples.groupBy("sample").count().where("count > 1").isEmpty()
    if repeated:
        samples = samples.groupBy(block, "sample").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    # the outer explode keeps Spark from making the words twice more, for a filter on their number
    each = samples.select(block, "sample", F.explode_outer("words").alias("token")).where("token is not null")
    samples = samples.where(F.size("words") > 0)
    total = samples.select("sample").distinct().count() if repeated else samples.count()
    counts = each.groupBy(block, "token").agg(F.count("sample").alias("n"))
    df = each.groupBy("token").agg(F.countDistinct("sample").alias("df")) if repeated else counts.groupBy("token").agg(F.sum("n").alias("df"))
    known = counts.join(df.where("df > 1"), "token")
    rows = (known.select(block, F.lit(0).alias("part"), F.lit(None).cast(samples.schema["sample"].dataType).alias("sample"), F.lit(None).cast("array<string>").alias("words"), "token", "df")
            .unionByName(samples.where("sample is not null").select(block, F.lit(1).alias("part"), "sample", "words", F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("df"))))
    schema = StructType([samples.schema[block], StructField("sample", samples.schema["sample"].dataType), StructField("cluster", IntegerType())])
    arrow, at_once = to_arrow_schema(schema), TOKENS_AT_ONCE

    def weight(df):
        import numpy as np

        return np.log((total + 1) / (df + 1)) + 1

    def finish(key, names, lengths, ids, weights):
        import numpy as np

        n, at = sum(map(len, lengths)), 0
        left_out, squares, known, col = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.int64), []
        for m, found in zip(lengths, ids):  # a batch's
            row, there = np.repeat(np.arange(at, at + len(m)), m), found >= 0
            known += np.bincount(row[there], minlength=n)
            left_out += np.bincount(row[~there], minlength=n)
            squares += np.bincount(row[there], weights[found[there]] ** 2, minlength=n)
            col.append(found[there])
            at += len(m)
        length = np.maximum(np.sqrt(squares + left_out * weight(1.0) ** 2), 1e-12)
        out = linkage.clusters(np.append(0, np.cumsum(known)), np.concatenate(col), weights, length, left_out == 0, threshold, at_once)
        columns = [pa.array([key] * len(out), arrow.field(0).type), pa.concat_arrays(names).cast(arrow.field(1).type), pa.array(out.astype("int32"))]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches):
        import numpy as np

        at, tokens, dfs, names, lengths, ids, words, weights = None, [], [], [], [], [], None, None
        for batch in batches:
            keys = batch.column(0)
            part = batch.column(1).to_numpy()
            lo = 0
            while lo < len(keys):
                key = keys[lo].as_py()
                if at is None or at[0] != key:
                    if names:
                        yield finish(at[0], names, lengths, ids, weights)
                    at, tokens, dfs, names, lengths, ids, words = (key,), [], [], [], [], [], None
                differs = pc.invert(pc.fill_null(pc.equal(keys, keys[lo]), False)) if key is not None else pc.is_valid(keys)
                ends = np.flatnonzero(differs.slice(lo).to_numpy(zero_copy_only=False))
                hi = lo + int(ends[0]) if len(ends) else len(keys)
                mid = lo + int(np.searchsorted(part[lo:hi], 1))
                if mid > lo:
                    tokens.append(batch.column(4).slice(lo, mid - lo))
                    dfs.append(batch.column(5).slice(lo, mid - lo).to_numpy())
                if hi > mid:
                    if words is None:
                        words = pa.concat_arrays(tokens) if tokens else pa.array([], batch.column(4).type)
                        weights = weight(np.concatenate(dfs)) if dfs else np.zeros(0)
                    some = batch.column(3).slice(mid, hi - mid)
                    names.append(batch.column(2).slice(mid, hi - mid))
                    lengths.append(some.value_lengths().to_numpy())
                    ids.append(pc.fill_null(pc.index_in(some.flatten(), value_set=words), -1).to_numpy())
                lo = hi
        if names:
            yield finish(at[0], names, lengths, ids, weights)

    return rows.repartition(block).sortWithinPartitions(block, "part", "sample").mapInArrow(run, schema)
