import hashlib

import pytest
import zstandard

from tidemark.llm import warc
from tidemark.llm.common import scratch


def test_round_trip_with_edge_cases(spark):
    big = "<p>ü" * 400
    rows = [(1, "u", None), (2, "u", ""), (3, None, big), (5, "u\r\nX: y", big), (4, "u", "x" * 999), (6, "u", "x" * 999), (None, "u", "q"), (7, "u", "a\r\n\r\nb" * 300000), (8, "u", big + " ")]
    pages = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, digest int, refers_to int")
    got = warc.round_trip(pages.repartition(3), scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, _, html in rows:
        body = (html or "").encode()
        assert by[i].payload_bytes == len(body) and by[i].payload_digest == hashlib.sha1(body).hexdigest()
        assert (by[i].record_type, by[i].refers_to) == (("revisit", 5) if i == 3 else ("response", None))
        assert by[i].payload == (None if i == 3 else body)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "t")).collect() == []


def archive(raw=None):
    d = warc.dictionary([b"abc"])
    raw = raw or warc.record("response", "urn:page:1", "t", b"hello", 5, hashlib.sha1(b"hello").hexdigest(), None)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(raw)
    return warc.skippable(d), frame, raw


def test_broken_archives_are_refused():
    lead, frame, raw = archive()
    assert [warc.parse(x)["payload"] for x in warc.frames(lead + frame + frame)] == [b"hello"] * 2
    packed = zstandard.ZstdCompressor().compress(warc.dictionary([b"abc"]))
    assert list(warc.frames(warc.skippable(packed) + frame)) == [raw]
    for bad in (frame, lead[:10], lead + frame[:-3], lead + frame + b"junk", b""):
        with pytest.raises((warc.BadArchive, zstandard.ZstdError)):
            list(warc.frames(bad))
    for old, new in ((b"Content-Length: 5\r\n\r\nh", b"Content-Length: 6\r\n\r\nh"), (b"hello", b"hullo"), (b"WARC/1.1", b"WORC/1.1"), (b"WARC-Type: ", b"WARC-Type "), (b"hello\r\n", b"hello!\r\n")):
        with pytest.raises(warc.BadArchive):
            warc.parse(raw.replace(old, new, 1))
