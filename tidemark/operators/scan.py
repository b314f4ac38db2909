"""Scans in order: a state carried down each key's sorted rows, for steps that no window or aggregate expresses.

Rows are dealt by key, sorted within partitions (the sort spills) and streamed
to Python in Arrow batches, so neither a key's rows nor its output need fit in
memory: a task holds one batch and the state of one key. A key is still one
task; its work is one step a row. Null keys make one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


class Scan:
    """One key's state. step sees the rows' values in order and gives output rows without the key; end gives those that are left."""

    def step(self, *values) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def ordered_scan(rows: DataFrame, key: str, values: list[str], order: list[str | Column], start: Callable[[], Scan], result: str) -> DataFrame:
    """(key, result columns): the output of a fresh Scan for each key over its rows' values, ascending by order, nulls last."""
    schema = StructType([StructField(key, rows.schema[key].dataType), *_parse_datatype_string(result).fields])
    arrow = to_arrow_schema(schema)
    width = len(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scan, first = None, None, True
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for k, *v in zip(*columns):
                if first or k != at:
                    if not first:
                        out += [(at, *r) for r in scan.end()]
                    at, scan, first = k, start(), False
                out += [(k, *r) for r in scan.step(*v)]
            if out:
                yield _batch(out, arrow, width)
        if not first:
            out = [(at, *r) for r in scan.end()]
            if out:
                yield _batch(out, arrow, width)

    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    narrow = rows.select(key, *values, *[c.alias(f"_o{i}") for i, c in enumerate(keys)])
    ranged = narrow.repartition(key).sortWithinPartitions(key, *[F.asc_nulls_last(f"_o{i}") for i in range(len(keys))])
    return ranged.select(key, *values).mapInArrow(run, schema)


def _batch(out: list[tuple], schema: pa.Schema, width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(width)], schema=schema)
