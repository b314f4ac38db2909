"""Registered queries over the driver's tables, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import attribution, audits, evidence, models, scoring, sessions

FLAGSHIP = "bursts_gap_islands"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**sessions.QUERIES, **scoring.QUERIES, **evidence.QUERIES, **models.QUERIES, **audits.QUERIES, **attribution.QUERIES}
ORACLES: dict[str, str] = {**sessions.ORACLES, **scoring.ORACLES, **evidence.ORACLES, **models.ORACLES, **audits.ORACLES, **attribution.ORACLES}
