"""Sinks: feature tables by configuration with resume, error tables, reports and run contracts."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists") -> None:
    """Parquet with zstd, by the partition column where one is named; the commit protocol leaves no half table."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(partition) if partition else w).parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the table at path does not have yet; returns how many. A missing table is an empty one."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    n = df.count()
    if n:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return n


def with_provenance(df: DataFrame, **values: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, the errors)."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def sample_key(*columns: str):
    """24 hex digits of the SHA-1 of the columns joined by pipes, null as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 24)


def report(df: DataFrame) -> str:
    """The first row as JSON, for metric tables of one row."""
    row = df.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, sort_keys=True, default=str)


def markdown(df: DataFrame, most: int = 100) -> str:
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r) + " |" for r in rows)])


def run_contract(config: dict, tables: dict[str, DataFrame]) -> dict:
    """The configuration's hash, each table's schema and row count, and one fingerprint over all of it."""
    body = {"config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "tables": {n: {"schema": d.schema.simpleString(), "rows": d.count()} for n, d in sorted(tables.items())}}
    return body | {"fingerprint": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def merged_config(base: dict, over: dict) -> dict:
    """base with over's values, dictionaries merged level by level."""
    return {k: merged_config(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in base | over}
