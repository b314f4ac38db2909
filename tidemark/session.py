"""Session factory used by tests, the bench and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "tidemark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC, AQE and one shuffle partition per core.

    On a cluster build the session yourself; operators only read settings
    from the session they are given.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(os.environ.get("TIDEMARK_MASTER", f"local[{n}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
