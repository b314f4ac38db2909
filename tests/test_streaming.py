"""Streams against the batch operators, with rows out of order and a last row that moves the watermark on."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.streaming import online

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp, length long, score double"


def stream(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        data = [(k, T0 + dt.timedelta(seconds=t), n, s) for k, t, n, s in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


ROWS = [[(1, 0, 10, .1), (1, 5, 20, .9), (2, 3, 5, .2)], [(1, 2, 7, .3), (1, 11, 1, .8), (2, 40, 6, .5)], [(1, 60, 3, .1), (9, 1000, 1, 0.0)], [(9, 2000, 1, 0.0)]]


def test_exact_bursts_are_those_of_the_batch(spark, tmp_path):
    got = {(r.key, r.start, r["end"], r.n_pkts, r.bytes_total) for r in run(online.exact_bursts(stream(spark, tmp_path, ROWS), "key", 6.0, "20 seconds"), "bursts", tmp_path)}
    flat = [(i, k, float(t) + T0.replace(tzinfo=dt.timezone.utc).timestamp(), n) for i, (k, t, n, _) in enumerate(r for b in ROWS for r in b)]
    batch = ordered.bursts(spark.createDataFrame(flat, "event_id long, capture_id long, ts double, length long"), 6.0)
    want = {(r.capture_id, r.start, r["end"], r.n_pkts, r.bytes_total) for r in batch.where("capture_id < 9").collect()}
    assert {g for g in got if g[0] < 9} == want


def test_alert_is_given_once(spark, tmp_path):
    got = run(online.topk_alerts(stream(spark, tmp_path, ROWS), "key", 8, 0.8, "20 seconds"), "alerts", tmp_path)
    assert [(r.key, round(r.pooled, 3)) for r in got] == [(1, 0.85)]


def test_session_window_keeps_an_equal_gap(spark, tmp_path):
    got = run(online.session_bursts(stream(spark, tmp_path, ROWS), "ts", "key", "6 seconds", "20 seconds"), "sessions", tmp_path)
    assert sorted((r.key, r.n_pkts) for r in got if r.key == 1) == [(1, 1), (1, 4)]  # a gap of exactly 6 stays
