"""Token counts of flat token files: separators found block by block, documents stitched by a prefix scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, stage
from tidemark.llm.tokens import tokenizer

#: Bytes of a block that one read takes, and of a file that the writer closes.
BLOCK, FILE = 4 << 20, 64 << 20


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE) -> DataFrame:
    """Write each text's ids and then ``end`` to flat files of little-endian unsigned 16-bit numbers below ``folder``.

    Returns (file, doc_no, id), which document is which in its file. Special tokens' strings in a text are ordinary text,
    so ``end`` never stands in a document. A null text is empty. Files get their names when whole, so tasks can run again.
    """

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, own = TaskContext.get(), tokenizer(vocabulary, plain=True)
        stop, k, held, ids = np.array([end], "<u2").tobytes(), 0, 0, []
        out = draft = name = None

        def close():
            out.close()
            fs.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name] * len(ids), "doc_no": pa.array(range(len(ids)), pa.int64()), "id": pa.array(ids, kind)})

        for b in batches:
            kind = b.schema.field("id").type
            for key, t in zip(b.column("id"), b.column("text"), strict=True):
                if out is None:
                    name, held, ids = f"part-{task.partitionId():06d}-{k:05d}.tokens", 0, []
                    draft = f"{root}/{name}.{task.taskAttemptId()}.draft"
                    out = fs.open_output_stream(draft)
                found = np.frombuffer(own.ids(t.as_py() or ""), "<u4")
                if (found >= 65_536).any() or (found == end).any():
                    raise ValueError(f"ids of 65,536 or more, or {end}, don't fit into files of 16-bit ids that end with it")
                data = found.astype("<u2").tobytes()
                out.write(data + stop)
                held += len(data) + 2
                ids.append(key.as_py())
                if held >= file_bytes:
                    yield close()
                    out, k = None, k + 1
        if out is not None:
            yield close()
        own.forget()

    kind_ = docs.schema[id_col].dataType.simpleString()
    return pick(docs, id=id_col, text=text_col).mapInArrow(run, f"file string, doc_no long, id {kind_}")


def token_counts(spark: SparkSession, path: str, end: int, width: int = 2, block: int = BLOCK, suffix: str = "*.tokens", group: int = 4096) -> DataFrame:
    """(file, doc_no, start, tokens, whole) for each document of the token files at ``path``.

    Files are flat little-endian numbers of ``width`` bytes in which ``end`` follows each document. They are cut into
    blocks of ``block`` bytes, whatever their size; a task finds the separators of a block in one vector comparison. A
    prefix scan over a file's blocks (one row each, in two levels) tells each block how many documents and tokens come before it and
    where the last separator was, so that documents across blocks are stitched without their tokens moving. Tokens after
    the last separator are a last document that isn't ``whole``; an empty file has none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path).select("path", "length")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("length") - 1) / block)))).alias("block")
    blocks = files.where("length > 0").select("path", "length", cut).repartition("path", "block")

    def run(batches):
        for b in batches:
            for name, length, k in zip(*(b.column(c).to_pylist() for c in ("path", "length", "block")), strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as f:
                    data = f.read_at(min(block, length - k * block), k * block)
                x = np.frombuffer(data, f"<u{width}", len(data) // width)
                stops = np.flatnonzero(x == end)
                yield pa.RecordBatch.from_pydict(
                    {"path": [name], "block": [k], "n": [len(x)], "docs": [len(stops)], "stops": pa.array([stops.tolist()], pa.list_(pa.int64()))}
                )

    found = stage(blocks.mapInArrow(run, "path string, block long, n long, docs long, stops array<long>"), "separators")
    small = found.select("path", "block", "n", "docs", F.element_at(F.when(F.col("docs") > 0, F.col("stops")), -1).alias("last"))
    # Two levels: within a group of blocks, and over the groups of a file.
    small = small.withColumn("group", F.floor(F.col("block") / group))
    before = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumns({"own": F.coalesce(F.sum("n").over(before), F.lit(0)), "own_docs": F.coalesce(F.sum("docs").over(before), F.lit(0))})
    small = small.withColumn("top", F.max(F.col("own") + F.col("last")).over(before))
    groups = small.groupBy("path", "group").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max(F.col("own") + F.col("last")).alias("end"))
    earlier = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumns({"g": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "g_docs": F.coalesce(F.sum("docs").over(earlier), F.lit(0))})
    groups = groups.select("path", "group", "g", "g_docs", F.max(F.col("g") + F.col("end")).over(earlier).alias("g_top"))
    scan = small.join(groups, ["path", "group"]).select(
        "path", "block", "n", "docs", "last", (F.col("g") + F.col("own")).alias("base"), (F.col("g_docs") + F.col("own_docs")).alias("doc_base"),
        F.coalesce(F.greatest("g_top", F.col("g") + F.col("top")) + 1, F.lit(0)).alias("open"),
    )
    scan = stage(scan, "scan")
    ends = found.select("path", "block", "stops").join(scan, ["path", "block"])
    ends = ends.withColumn("at", F.transform("stops", lambda x: x + F.col("base")))
    starts = F.concat(F.array("open"), F.transform("at", lambda x: x + 1))
    docs = ends.select("path", "doc_base", F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size("at")).alias("s"), F.col("at").alias("e"))).alias("i", "d"))
    whole = docs.select("path", (F.col("doc_base") + F.col("i")).alias("doc_no"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("tokens"), F.lit(True).alias("whole"))
    last = scan.groupBy("path").agg(F.sum("n").alias("n"), F.sum("docs").alias("doc_no"), F.coalesce(F.max(F.col("base") + F.col("last")) + 1, F.lit(0)).alias("start"))
    rest = last.where("n > start").select("path", "doc_no", "start", (F.col("n") - F.col("start")).alias("tokens"), F.lit(False).alias("whole"))
    return whole.unionByName(rest).select(F.element_at(F.split("path", "/"), -1).alias("file"), "doc_no", "start", "tokens", "whole")
