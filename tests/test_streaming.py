import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import bars as batch
from tidemark.plans.base import ticks
from tidemark.streaming import twins


@pytest.fixture
def stream(spark, tmp_path):
    t = ticks(spark, SF).orderBy("ts")
    t.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))


def rows(df, mode="append"):
    name = "m" + uuid.uuid4().hex
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_bars_are_the_batch_bars(spark, stream):
    got = rows(twins.bars(stream, "1 day", "1 hour"))
    want = batch.from_ticks(ticks(spark, SF), "1 day")
    both = got.join(want, ["symbol", "ts", "open", "high", "low", "close", "n"])
    assert got.count() > 50 and both.count() == got.count() >= want.count() - 10  # the last days are still open


def test_sessions_and_counts(spark, stream):
    t = ticks(spark, SF)
    own = t.groupBy("symbol", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    got = rows(twins.sessions(stream, "6 hours", "1 hour"))
    assert got.count() > 100 and got.exceptAll(own).count() == 0
    own = t.groupBy("symbol", F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.end").alias("ts"), "n")
    got = rows(twins.trailing_counts(stream, "24 hours", "6 hours", "1 hour"))
    assert got.count() > 100 and got.exceptAll(own).count() == 0


def test_latest_available_value(spark, stream):
    slow = stream.where("symbol = 'view'").select(F.lit("click").alias("symbol"), F.col("ts").alias("available_at"), F.col("price").alias("level"))
    got = rows(twins.available(stream.where("symbol = 'click'"), slow, ["level"], "6 hours", "1 hour")).collect()
    t = ticks(spark, SF).collect()
    views = sorted((r.ts, r.price) for r in t if r.symbol == "view")
    assert len(got) > 100
    for r in got:
        near = [v for v in views if v[0] <= r.ts and (r.ts - v[0]).total_seconds() <= 6 * 3600]
        assert (r.matched_at, r.level) == (near[-1] if near else (None, None))
