"""Manifests, labels and candidates joined by keys that are checked: each side's uniqueness is counted before a key is trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components


def canonical_path(path: Column) -> Column:
    """Lower case, forward slashes, none at the end."""
    return F.rtrim(F.lower(F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(canonical_path(path), "/", -1)


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def below(path: Column, folder: str) -> Column:
    """The part of the path after the last ``folder/``, the whole path if it is not in one."""
    p = canonical_path(path)
    return F.when(p.contains(f"{folder}/"), F.substring_index(p, f"{folder}/", -1)).otherwise(p)


def pick_key(left: DataFrame, right: DataFrame, keys: list[str]) -> str:
    """The first of the keys that both sides have, with every value present, not empty and there once; an error if none.

    One aggregation a side counts all keys.
    """
    def sound(df: DataFrame, cols: list[str]) -> set[str]:
        aggs = [F.struct(F.count("*").alias("n"), F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias("some"), F.countDistinct(c).alias("many")).alias(c) for c in cols]
        row = df.agg(*aggs).first()
        return {c for c in cols if row[c].n == row[c].some == row[c].many}

    both = [k for k in keys if k in left.columns and k in right.columns]
    good = (sound(left, both) & sound(right, both)) if both else set()
    for k in both:
        if k in good:
            return k
    raise ValueError(f"none of {', '.join(keys)} is unique and complete on both sides")


def join_labels(left: DataFrame, labels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """left with the labels' columns by pick_key's key; a column of that name on the left goes."""
    k = pick_key(left, labels, keys)
    return left.drop(*columns).join(labels.select(k, *columns), k, "left")


def matched_or_error(rows: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the mapping's value; a key without one is an error at run time."""
    out = rows.join(mapping.select(key, value), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(mapping.schema[value].dataType)
    return out.withColumn(value, F.when(F.col(value).isNull(), missing).otherwise(F.col(value)))


def unique_or_error(rows: DataFrame, *keys: str) -> DataFrame:
    """rows if no combination of keys repeats, else an error at run time."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated {', '.join(keys)}")).cast("boolean")).otherwise(True)).drop("_n")


def candidate_key(session: Column, rank: Column) -> Column:
    """Session and rank in one 64-bit number."""
    return F.shiftleft(session.cast("long"), 32).bitwiseOR(rank.cast("long"))


def align_scores(candidates: DataFrame, scores: DataFrame, session: str = "session_id", rank: str = "rank") -> DataFrame:
    """candidates with the score of their session and rank, null where there is none; scores have one row a key."""
    s = scores.select(candidate_key(F.col(session), F.col(rank)).alias("_key"), "score")
    return candidates.withColumn("_key", candidate_key(F.col(session), F.col(rank))).join(s, "_key", "left").drop("_key")


def weights_without_leak(train: DataFrame, held_out: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """train with weight by key, 1 where there is none; a weight for a held-out key is an error at run time."""
    leak = weights.join(held_out.select(key).distinct(), key, "left_semi")
    if not leak.isEmpty():
        raise ValueError(f"weights name held-out {key}s")
    return train.join(weights.select(key, "weight"), key, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def training_mask(source: Column, rank: Column, most: int) -> Column:
    """Oracle rows of rank 0, jittered oracle rows, and heuristic ones of ranks 1 to most."""
    return ((source == "oracle") & (rank == 0)) | source.startswith("oracle_jitter_") | ((source == "heuristic") & rank.between(1, most))


def candidate_mask(source: Column, rank: Column, window: Column, most: int, windows: list[str]) -> Column:
    return (source == "heuristic") & rank.between(1, most) & window.isin(*windows)


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a combination of keys, the first in order; ties by all columns."""
    every = [*order, *[c for c in rows.columns if c not in order]]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*every))).where("_k = 1").drop("_k")


def sequence_key(sample: Column, label: Column, domain: Column, row: Column) -> Column:
    """The sample's key, else its label and domain, else its row number."""
    some = F.nullif(F.trim(F.coalesce(sample, F.lit(""))), F.lit(""))
    pair = F.when((F.coalesce(label, F.lit("")) != "") & (F.coalesce(domain, F.lit("")) != ""), F.concat_ws("|", label, domain))
    return F.coalesce(some, pair, F.concat(F.lit("row:"), row.cast("string")))


def union_filled(*frames: DataFrame) -> DataFrame:
    """All rows; a column that a frame lacks is null there, and columns are in the order in which they first appear."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sample_per_stratum(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum: those with the smallest hash of seed and key, so reruns agree."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*strata).orderBy(h, key))).where(F.col("_k") <= n).drop("_k")


def parse_notes(notes: Column) -> Column:
    """A map of ``k=v;k=v``: keys trimmed and lower, the last of a repeated one; parts without ``=`` go."""
    parts = F.filter(F.split(F.coalesce(notes, F.lit("")), ";"), lambda x: x.contains("=") & (F.trim(F.substring_index(x, "=", 1)) != ""))
    pairs = F.transform(parts, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def supergroups(rows: DataFrame, id_col: str, key_cols: list[str]) -> DataFrame:
    """(id, group): rows that share a value of any of the keys, directly or through others, are one group, named by its smallest id.

    Rows meet through their keys, not each other, so a hot key adds a row each.
    """
    ids = rows.select(F.col(id_col).cast("string").alias("id"))
    edges = rows.select(F.concat(F.lit("i:"), F.col(id_col).cast("string")).alias("a"), F.explode(F.array(*[F.when(F.col(c).cast("string") != "", F.concat(F.lit(f"k:{c}:"), F.col(c).cast("string"))) for c in key_cols])).alias("b")).where("b is not null")
    found = connected_components(edges).where("node like 'i:%'").select(F.expr("substring(node, 3)").alias("id"), F.col("component"))
    named = found.groupBy("component").agg(F.min("id").alias("group"))
    return ids.join(found.join(named, "component").select("id", "group"), "id", "left").withColumn("group", F.coalesce("group", "id"))
