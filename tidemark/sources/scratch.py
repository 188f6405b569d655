"""Scratch tables in the folder that a cluster's executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Rows of a file of a table whose size is known.
ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where it is unset a new local folder, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        base = _own[0]
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    ``rows`` it has at most, where that is known, keep small tables in few files: a file for each ROWS rows.
    """
    path = scratch(df.sparkSession, name)
    (df if rows is None else df.coalesce(rows // ROWS + 1)).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
