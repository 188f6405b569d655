"""Article exports in zip archives, gzip or plain CSV, and an append-only ledger with commits."""

from __future__ import annotations

import csv
import gzip
import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from tidemark.functions.text import unescape

#: Columns of an export that are used; any may be missing.
COLUMNS = ["DATE", "url", "domain", "V2Tone", "title", "stream", "V2Themes"]
#: Rows handed on at a time.
ROWS = 5_000


def members(name: str, content: bytes) -> Iterator[io.TextIOBase]:
    """The CSV texts of a file: of a zip its .csv and .gz members in order of name."""
    raw: io.BufferedIOBase = io.BytesIO(content)
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(raw) as z:
            for member in sorted(z.namelist()):
                if member.lower().endswith((".csv", ".gz")):
                    with z.open(member) as f:
                        yield io.TextIOWrapper(gzip.open(f) if member.lower().endswith(".gz") else f, "utf-8-sig", newline="")
    else:
        yield io.TextIOWrapper(gzip.open(raw) if name.lower().endswith(".gz") else raw, "utf-8-sig", newline="")


def read_exports(spark: SparkSession, paths: str | list[str], stream: str, pattern: str = "*.{zip,csv,gz}") -> DataFrame:
    """(ts, url, domain, tone, title, themes, stream) of article exports, whatever they are packed in.

    A file is a task's; its members are unpacked and parsed a few thousand rows at a time, each by its own header, with line
    breaks inside quotes. Files are read by Spark, so any store will do. Rows of files without a ``stream`` column belong to
    ``stream``; titles lose their HTML entities; ``tone`` is the first number of its list. A stamp that isn't one stops the
    job, as a damaged export should; rows without a URL are left out.
    """
    csv.field_size_limit(1 << 30)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for text in members(path, content):
                    rows, out = csv.DictReader(text), []
                    for r in rows:
                        out.append([r.get(c) or None for c in COLUMNS])
                        if len(out) == ROWS:
                            yield pd.DataFrame(out, columns=COLUMNS, dtype="object")
                            out = []
                    yield pd.DataFrame(out, columns=COLUMNS, dtype="object")

    raw = files.mapInPandas(run, ", ".join(f"{c} string" for c in COLUMNS))
    ts = F.to_timestamp(F.regexp_replace(F.trim("DATE"), r"\.0$", ""), "yyyyMMddHHmmss")
    return raw.where("url is not null").select(
        ts.alias("ts"), "url", "domain", F.element_at(F.split("V2Tone", ","), 1).try_cast("double").alias("tone"), unescape("title").alias("title"), F.col("V2Themes").alias("themes"),
        F.coalesce("stream", F.lit(stream)).alias("stream"),
    )


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, ledger: str) -> list[dict]:
    """The commits of a ledger in order: each names a folder of rows."""
    at, fs = _path(spark, f"{ledger}/_commits")
    if not fs.exists(at):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(at))
    lines = spark.read.text([f"{ledger}/_commits/{n}" for n in names if n.endswith(".json")]).select("value").collect() if names else []  # a line a commit
    return sorted((json.loads(r.value) for r in lines), key=lambda c: c["number"])


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The rows of all commits; None before the first."""
    found = commits(spark, ledger)
    return spark.read.parquet(*[f"{ledger}/{c['folder']}" for c in found]) if found else None


def _commit(spark: SparkSession, ledger: str, number: int, folder: str) -> bool:
    """Write commit ``number`` unless another writer has: the file system creates a name once."""
    at, fs = _path(spark, f"{ledger}/_commits/{number:012d}.json")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as taken:
        if "AlreadyExists" in str(taken.java_exception):
            return False
        raise
    out.write(bytearray(json.dumps({"number": number, "folder": folder}).encode() + b"\n"))
    out.close()
    return True


def append_once(spark: SparkSession, rows: DataFrame, ledger: str, keys: list[str], stamps: tuple[str, ...] = ()) -> DataFrame:
    """Append the ``rows`` whose ``keys`` the ledger doesn't hold and return those. Any number of writers may do so at once.

    Rows are written to a folder of their own and count once a commit names it. Commits are numbered and a number is
    given once: who comes second looks at what the first has added, leaves that out and tries the next. A key that is
    there with other values (``stamps`` apart) stops the job, in ``rows`` too; a run that fails leaves nothing that counts.
    """
    values = [c for c in rows.columns if c not in keys and c not in stamps]
    same = F.xxhash64(*values) if values else F.lit(0).cast("long")
    folder = f"rows-{uuid.uuid4().hex}"
    mine = rows.withColumn("_h", same).groupBy(*keys).agg(F.min(F.struct("_h", *[c for c in rows.columns if c not in keys])).alias("r"), F.max("_h").alias("most"))
    clash = F.when(F.col("r._h") != F.col("most"), F.raise_error(F.lit("one key with different values")).cast("long")).otherwise(F.col("r._h"))
    mine.select(*keys, clash.alias("_h"), *[f"r.{c}" for c in rows.columns if c not in keys]).write.parquet(f"{ledger}/_new/{folder}")
    mine = spark.read.parquet(f"{ledger}/_new/{folder}")
    while True:
        found = commits(spark, ledger)
        there = read_ledger(spark, ledger)
        new = mine
        if there is not None:
            both = mine.join(there.withColumn("_there", same).select(*keys, "_there"), keys, "left")
            clash = F.col("_there").isNotNull() & (F.col("_there") != F.col("_h"))
            new = both.where(F.when(clash, F.raise_error(F.lit("a key of the ledger with other values")).cast("boolean")).otherwise(F.col("_there").isNull())).drop("_there")
        name = f"{folder}-{len(found):06d}"
        new.select(*rows.columns).write.parquet(f"{ledger}/{name}")
        new = spark.read.schema(rows.schema).parquet(f"{ledger}/{name}")
        if new.isEmpty() or _commit(spark, ledger, len(found), name):
            return new
