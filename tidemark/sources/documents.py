"""JSON and tabular sources: flow-keyed packets, HAR entries, manifests and tolerant event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.net import host_from_url

_FLOW = """map<string, struct<packet_data: struct<timestamp: array<double>, packet_dir: array<int>, IP_packet_bytes: array<int>, L4_payload_bytes: array<int>, TCP_flags: array<string>, role: array<string>, host: array<string>, sni: array<string>>>>"""
_HAR = """struct<log: struct<entries: array<struct<startedDateTime: string, time: double, serverIPAddress: string,
request: struct<method: string, url: string, postData: struct<text: string>>,
response: struct<status: int, bodySize: long, _transferSize: long, content: struct<mimeType: string, text: string, encoding: string>>>>>>"""
#: TCP flag letters and their bits. Fixed values.
FLAGS = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by its suffix (.parquet, .pq), JSON lines by theirs, else CSV with a header."""
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".jsonl", ".ndjson", ".json")):
        return spark.read.json(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def flow_packets(rows: DataFrame, json_col: str = "json", capture_col: str = "capture_id") -> DataFrame:
    """Packets of flow-keyed JSON objects: a key is src_ip,src_port,dst_ip,dst_port,protocol; arrays shorter than timestamp give defaults; only TCP and UDP."""
    flows = rows.select(F.col(capture_col).alias("capture_id"), F.explode(F.from_json(json_col, _FLOW)).alias("key", "v")).withColumn("k", F.split("key", ","))
    d = F.col("v.packet_data")
    each = flows.select("capture_id", "key", "k", d.alias("d"), F.posexplode(d["timestamp"]).alias("i", "ts"))

    def at(name: str, default) -> Column:
        return F.coalesce(F.get(F.col("d")[name], F.col("i")), F.lit(default))

    kind = F.get("k", F.lit(4)).cast("int")
    bits = sum((F.when(F.upper(at("TCP_flags", "")).contains(c), b).otherwise(0) for c, b in FLAGS.items()), F.lit(0))
    flags = F.coalesce(F.expr("try_cast(get(d.TCP_flags, i) AS int)"), bits)
    return each.where(kind.isin(6, 17)).select(
        "capture_id", F.col("key").alias("flow_id"), F.col("i").alias("idx"), "ts", at("IP_packet_bytes", 0).alias("length"), at("L4_payload_bytes", 0).alias("payload_len"), F.when(at("packet_dir", -1) == 1, "down").when(at("packet_dir", -1) == 0, "up").otherwise("unknown").alias("direction"),
        F.when(kind == 6, "TCP").otherwise("UDP").alias("proto"), F.get("k", F.lit(0)).alias("src_ip"), F.get("k", F.lit(1)).cast("int").alias("src_port"), F.get("k", F.lit(2)).alias("dst_ip"), F.get("k", F.lit(3)).cast("int").alias("dst_port"),
        flags.alias("tcp_flags"), F.lower(at("role", "unknown")).alias("role"), at("host", "").alias("host"), at("sni", "").alias("sni"))


def har_entries(rows: DataFrame, json_col: str = "json", capture_col: str = "capture_id") -> DataFrame:
    """One row a HAR entry: host, cleaned server address, start, method, URL, status, sizes and media type; a broken file gives none."""
    clean = json_clean(F.col(json_col))
    e = rows.select(F.col(capture_col).alias("capture_id"), F.posexplode(F.from_json(clean, _HAR)["log"]["entries"]).alias("idx", "e"))
    x = F.col("e")
    ip = F.btrim(F.coalesce(x["serverIPAddress"], F.lit("")), F.lit("[] "))
    start = F.unix_micros(F.try_to_timestamp(x["startedDateTime"])) / 1e6
    return e.select("capture_id", "idx", host_from_url(x["request"]["url"]).alias("host"), ip.alias("server_ip"), start.alias("start"), (start + x["time"] / 1000).alias("end"), x["request"]["method"].alias("method"), x["request"]["url"].alias("url"), x["request"]["postData"]["text"].alias("post"),
                    x["response"]["status"].alias("status"), F.coalesce(F.nullif(x["response"]["_transferSize"], F.lit(-1).cast("long")), x["response"]["bodySize"]).alias("bytes"), x["response"]["content"]["mimeType"].alias("mime"))


def json_clean(text: Column) -> Column:
    """Without a byte-order mark."""
    return F.ltrim(text, F.lit("﻿"))


def read_manifest(spark: SparkSession, path: str, key: str = "capture_id") -> DataFrame:
    """A manifest of JSON lines or CSV with nulls as empty strings; a repeated key is an error at run time."""
    df = read_table(spark, path)
    df = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key))).cast("string")))


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def epoch(text: Column) -> Column:
    """Seconds since the epoch from a number, a numeric string or an ISO time; times without a zone are in the session's."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)
