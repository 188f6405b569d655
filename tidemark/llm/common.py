"""Scratch tables in the cluster's shared folder, and small helpers for Arrow map tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch, shared_dir, stage  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, by their new names: other columns can't clash with those an operator makes."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def text_bytes(batch: pa.RecordBatch, col: str) -> np.ndarray:
    """Bytes of each string of a column, 0 for null."""
    return pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def stretches(sizes: np.ndarray, most: int):
    """(from, to) of consecutive stretches whose sizes sum to ``most`` at the most, or that are one item."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield at, end
        at = end


def slices(batch: pa.RecordBatch, col: str, most: int = 1 << 20):
    """The batch in slices of about ``most`` bytes of text in ``col``: memory follows them, not Spark's batches of rows."""
    for at, end in stretches(text_bytes(batch, col), most):
        yield batch.slice(at, end - at)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn``: dict of Arrow columns -> dict of arrays (or None), batch by batch."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = fn(dict(zip(b.schema.names, b.columns, strict=True)))
                if got is not None:
                    yield pa.RecordBatch.from_pydict(got)

    return df.mapInArrow(run, schema)


def is_held_out(col: str, mod: int, rest: int):
    """crc32(doc_id as text) mod ``mod`` = ``rest``, as a Column; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % mod == rest, F.lit(False))
