"""WARC archives in Zstandard: one frame for each record, the dictionary in the leading skippable frame."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick, stage

#: Fixed values of the formats: the skippable frame that holds a dictionary, a Zstandard frame, the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed beyond this many compressed bytes, so that a reader holds one of bounded size.
ARCHIVE_BYTES = 16 << 20
#: Payload bytes and records at the start of a partition that the dictionary is trained on.
SAMPLE_BYTES, SAMPLE_RECORDS, DICTIONARY_BYTES = 2 << 20, 400, 32 << 10
FEED = 1 << 16


class BadArchive(ValueError):
    """Bytes that are no such archive: a wrong frame, header, length or digest."""


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples, or raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def record(kind: str, record_id: str, target: str, payload: bytes, full: int, digest: str, refers_to: str | None) -> bytes:
    """The bytes of a response record, or of a revisit record, which has the response's HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frames(data: bytes):
    """The records of an archive, one by one: each frame has to hold one whole record and nothing else."""
    view = memoryview(data)
    if len(view) < 8 or struct.unpack("<I", view[:4])[0] != DICTIONARY_MAGIC:
        raise BadArchive("no dictionary frame leads the archive")
    size = struct.unpack("<I", view[4:8])[0]
    if 8 + size > len(view):
        raise BadArchive("the dictionary frame is cut short")
    own = bytes(view[8 : 8 + size])
    if own[:4] == FRAME_MAGIC:
        own = zstandard.ZstdDecompressor().decompressobj().decompress(own)
    reader, at = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own)), 8 + size
    while at < len(view):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise BadArchive(f"no frame at byte {at}")
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise BadArchive("the last frame is cut short")
            piece = view[at : at + FEED]
            out.append(one.decompress(piece))
            at += len(piece) - (len(one.unused_data) if one.eof else 0)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Header fields and payload of a record whose version, lengths and digest hold; else BadArchive."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BadArchive("no WARC header")
    fields = {}
    for x in lines[1:]:
        k, colon, v = x.partition(":")
        if not colon:
            raise BadArchive(f"a header line without a colon: {x[:50]}")
        fields[k.strip().lower()] = v.strip()
    if not fields.get("content-length", "").isdigit():
        raise BadArchive("no length in the header")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive(f"the block has {len(rest) - 4} bytes, the header says {n}")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    sizes = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not sizes:
        raise BadArchive("no HTTP header in the block")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "response" and (len(payload) != sizes[0] or hashlib.sha1(payload).hexdigest() != digest):
        raise BadArchive("the payload isn't that of the header's length and digest")
    return fields | {"payload": payload, "payload_bytes": sizes[0], "digest": digest}


def page_of(urn: str | None) -> int | None:
    """The page's number in a record id <urn:page:N>; none for a page without number."""
    last = (urn or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def plan_records(pages: DataFrame, id_col: str, payload_col: str, least: int = 1000) -> DataFrame:
    """``pages`` as (page_id, url, html) with refers_to: the largest page_id of an equal payload of ``least`` bytes or more.

    Digests and ids alone are grouped; a partial aggregate comes before the shuffle, so a payload that many pages share is
    no burden. Payloads meet the few ids that revisit another by an equi-join on the id.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    light = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= least)
    first = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("k")).where("k > 1")
    again = light.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    whole = pages.withColumn("digest", F.sha1(body))
    return whole.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", least=1000) -> DataFrame:
    """Write a record for each page into archives below ``folder``; returns (archive, records, bytes), one row an archive.

    A null payload is an empty one. Each task writes archives named by its partition under a temporary name and renames
    them when whole, so a task that runs again, or twice at once, leaves the same files.
    """
    rows = plan_records(pick(pages, page_id=id_col, url=url_col, html=payload_col), id_col, payload_col, least)

    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        records, held, size, done = _records(batches), [], 0, False
        for r in records:
            held.append(r)
            size += len(r)
            if size > SAMPLE_BYTES or len(held) >= SAMPLE_RECORDS:
                break
        else:
            done = True
        if not held:
            return
        content = dictionary(held)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=True)
        k = 0
        source = iter(held) if done else _chain(held, records)
        one = next(source, None)
        while one is not None:
            name = f"{root}/part-{part:06d}-{k:05d}.warc.zst"
            draft = f"{name}.{attempt}.draft"
            n = 0
            with fs.open_output_stream(draft) as out:
                out.write(skippable(content))
                total = 8 + len(content)
                while one is not None and total < ARCHIVE_BYTES:
                    frame = packer.compress(one)
                    out.write(frame)
                    total += len(frame)
                    n += 1
                    one = next(source, None)
            fs.move(draft, name)
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n], "bytes": [total]})
            k += 1

    return rows.mapInArrow(run, "archive string, records long, bytes long")


def _chain(held, rest):
    yield from held
    held.clear()
    yield from rest


def _records(batches):
    for b in batches:
        for page, url, html, digest, to in zip(*(b.column(k) for k in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
            target = " ".join((url.as_py() or "").split())
            own, to = page.as_py(), to.as_py()
            kind = "response" if to is None else "revisit"
            yield record(kind, f"urn:page:{own}", target, payload, len(payload), digest.as_py(), f"urn:page:{to}")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, target, record_type, payload_bytes, payload_digest, refers_to, payload) of all archives.

    Spark's binary source reads the files, so they can be in any store that it knows. A broken archive fails the query.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for raw in frames(content.as_buffer().to_pybytes()):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size > FEED * 64:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(
        run,
        "record_id string, page_id long, target string, record_type string, payload_bytes long, payload_digest string, "
        "refers_to long, payload binary",
    )


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "record_id": [r.get("warc-record-id", "").strip("<>") for r in rows],
            "page_id": pa.array([page_of(r.get("warc-record-id")) for r in rows], pa.int64()),
            "target": [r.get("warc-target-uri") for r in rows],
            "record_type": [r.get("warc-type") for r in rows],
            "payload_bytes": pa.array([r["payload_bytes"] for r in rows], pa.int64()),
            "payload_digest": [r["digest"] for r in rows],
            "refers_to": pa.array([page_of(r.get("warc-refers-to")) for r in rows], pa.int64()),
            "payload": pa.array([r["payload"] if r.get("warc-type") == "response" else None for r in rows], pa.binary()),
        }
    )


def round_trip(pages: DataFrame, folder: str, **names) -> DataFrame:
    """Write ``pages`` to archives below ``folder`` and read them back; the manifest's record count has to come back."""
    manifest = stage(write_archives(pages, folder, **names), "manifest")
    if manifest.isEmpty():
        return read_archives(pages.sparkSession, _empty(pages.sparkSession))
    return read_archives(pages.sparkSession, folder)


def _empty(spark: SparkSession) -> str:
    from tidemark.llm.common import scratch

    path = scratch(spark, "no-archives")
    spark.createDataFrame([], "x long").write.parquet(path)
    return path
