"""Files of our own formats in the shared folder, by URI, from driver or executors.

Writers make a file of their own and rename it when it is whole, so a lost or
repeated task leaves no half file under the final name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


@contextmanager
def writing(uri: str):
    """A binary stream whose file takes its name only when the block ends well."""
    system, path = open_fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(own, compression=None, buffer_size=1 << 20) as out:
        yield out
    system.move(own, path)


@contextmanager
def reading(uri: str):
    """A binary file that can seek."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        yield f


def each_item(spark: SparkSession, items: list, run: Callable[[object], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run yields for each item, one task an item, dealt by index; items are small, as names of files."""
    held = spark.sparkContext.broadcast(items)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from run(held.value[i])

    n = len(items)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(tasks, schema)
