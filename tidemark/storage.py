"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. Where it is unset (local tests)
a temporary folder is made once per application, which is only right where
driver and executors are one process; with any other master it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of this application's own folder below the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(_LOCAL[app])
        root = _LOCAL[app]
    if "://" not in root:  # name the file system, for readers that are not Spark's
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/tidemark-{app}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and return a reader of it.

    Cuts lineage: a lost executor costs a re-read, not a recomputation. The
    table stays until drop() or the end of the shared folder's life.
    """
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop(df_or_path) -> None:
    """Delete a table made by materialize(); a path is taken as it is."""
    path = df_or_path if isinstance(df_or_path, str) else getattr(df_or_path, "_tidemark_path", None)
    if path is None:
        return
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
