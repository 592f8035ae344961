"""Intermediate tables in the folder that the cluster shares.

``materialize`` cuts lineage by writing a DataFrame as Parquet below
``spark.checkpoint.dir`` and reading it back.  The files survive lost executors, and the planner
knows their true size, so joins against them pick broadcast or shuffle by measured bytes and both
sides of a shuffled join can be split by adaptive execution.  The shuffle files of the job that
writes a table are deleted as soon as it is written, so a query that is cut into tables holds the
shuffles of one job at a time and not the sum of all.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a new temporary folder if the whole session is one process; executors of a
    cluster would each write to a folder of their own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="bidgraph-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/bidgraph/{label}-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Jobs that are started inside delete their shuffle files at their end, whatever the session does else."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles() if "/bidgraph/" in f}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
