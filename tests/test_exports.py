import gzip
import io
import threading
import zipfile

import pytest
from pyspark.errors import PySparkException

from tidemark.sources import exports

HEAD = "DATE,url,domain,V2Tone,title\n"
ROW = '20240101000000,https://a.com/x,a.com,"-1.5,2,3","Fed &amp; ""rates""\nup"\n'


def test_zip_gzip_and_plain_give_equal_rows(spark, tmp_path):
    packed = io.BytesIO()
    with gzip.open(packed, "wt") as f:
        f.write(HEAD + ROW)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/one.csv", HEAD + ROW)
        z.writestr("two.csv.gz", packed.getvalue())
        z.writestr("read.me", "no")
    (tmp_path / "b.csv.gz").write_bytes(packed.getvalue())
    (tmp_path / "c.csv").write_text("﻿" + HEAD + ROW + "20240102000000,,b.com,1,no address\n")
    (tmp_path / "d.csv").write_text("stream,url,DATE,title\nusa500,https://d.com,20240103000000.0,\n")
    (tmp_path / "e.txt").write_text("no")
    got = [tuple(r) for r in exports.read_exports(spark, str(tmp_path), "btc").orderBy("url").collect()]
    assert [(str(r[0]), *r[1:]) for r in got[:4]] == [("2024-01-01 00:00:00", "https://a.com/x", "a.com", -1.5, 'Fed & "rates"\nup', None, "btc")] * 4
    assert [(str(r[0]), *r[1:]) for r in got[4:]] == [("2024-01-03 00:00:00", "https://d.com", None, None, None, None, "usa500")]
    (tmp_path / "f.csv").write_text(HEAD + "never,https://f.com,f.com,1,x\n")
    with pytest.raises(PySparkException):
        exports.read_exports(spark, str(tmp_path), "btc").collect()


def test_writers_at_once_add_each_key_once(spark, tmp_path):
    ledger, failed = f"file://{tmp_path}/ledger", []
    assert exports.read_ledger(spark, ledger) is None

    def write(k):
        try:
            exports.append_once(spark, spark.range(k * 10, k * 10 + 25).selectExpr("id", "id * 2 as v", f"'{k}' as who"), ledger, ["id"], stamps=("who",))
        except Exception as e:  # shown below
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    rows = exports.read_ledger(spark, ledger).collect()
    assert sorted(r.id for r in rows) == list(range(55)) and all(r.v == 2 * r.id for r in rows)
    assert [c["number"] for c in exports.commits(spark, ledger)] == list(range(len(exports.commits(spark, ledger))))


def test_again_and_conflicts(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("b", 2, "y")], "k string, v int, at string")
    assert sorted(r.k for r in exports.append_once(spark, rows, ledger, ["k"], ("at",)).collect()) == ["a", "b"]
    assert exports.append_once(spark, rows, ledger, ["k"], ("at",)).collect() == []
    for bad in ([("a", 9, "x")], [("c", 1, "x"), ("c", 2, "x")]):
        with pytest.raises(PySparkException):
            exports.append_once(spark, spark.createDataFrame(bad, rows.schema), ledger, ["k"], ("at",))
    assert exports.read_ledger(spark, ledger).count() == 2 and len(exports.commits(spark, ledger)) == 1
