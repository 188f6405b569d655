"""Streams in event-time order against the batch operators, with rows dealt to micro-batches at random."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, opportunity, stories
from tidemark.streaming import ordered

SCHEMA = "symbol string, ts timestamp, close double, up boolean, back boolean, id long"
END = 4_000_000


@pytest.fixture(scope="module")
def bars(spark):
    ordered.store(spark)
    rng, rows = random.Random(3), []
    for s in "ab":
        t = 0
        for _ in range(90):
            t += 900 * rng.choice([1, 1, 1, 2, 5])
            rows.append((s, t, rng.uniform(0, 100), rng.random() < 0.4, rng.random() < 0.05, len(rows)))
    df = spark.createDataFrame(rows, "symbol string, t long, close double, up boolean, back boolean, id long")
    yield df.select("symbol", F.timestamp_seconds("t").alias("ts"), "close", "up", "back", "id").cache()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, df, tmp_path, make, files=4, seed=0):
    """All rows of ``make(stream)`` with the rows of ``df`` in files at random; a last row lets the watermark pass them all."""
    path = str(tmp_path / uuid.uuid4().hex)
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], df.schema).coalesce(1).write.mode("append").parquet(path)
    name = "m" + uuid.uuid4().hex
    last = [(s, END, 0.0, False, False, -1) for s in "ab"]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / uuid.uuid4().hex)).start()
    q.processAllAvailable()
    end = spark.createDataFrame(last, "symbol string, t long, close double, up boolean, back boolean, id long").select("symbol", F.timestamp_seconds("t").alias("ts"), "close", "up", "back", "id")
    for _ in range(2):
        end.coalesce(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    q.stop()
    return [r for r in spark.table(name).collect() if r.ts.timestamp() < END]


LATE = "30 days"


def test_trigger_sequences_are_the_batch_ones(spark, bars, tmp_path):
    steps, reset = [F.col("close") < 30, F.col("up"), F.col("close") > 60], F.col("back")
    want = {(r.symbol, r.ts) for r in opportunity.triggers(bars, steps, reset, 3).where("fired").collect()}
    assert len(want) > 3
    for files, seed in ((1, 0), (5, 1)):
        got = streamed(spark, bars, tmp_path, lambda s: ordered.trigger_sequences(s, steps, reset, 3, LATE), files, seed)
        assert len(got) == len(want) and {(r.symbol, r.ts) for r in got} == want


def test_alerts_and_retained_stories(spark, bars, tmp_path):
    high = bars.where("close >= 40")
    want = {r.id for r in gates.spaced(high, "id", 7200).where("taken").collect()}
    got = streamed(spark, bars, tmp_path, lambda s: ordered.alerts(s, 40.0, 7200, LATE, score="close"))
    assert {(r.symbol, r.ts) for r in got} == {(r.symbol, r.ts) for r in high.collect() if r.id in want} and len(got) == len(want)
    want = {r.id for r in stories.exact_echoes(bars, "id", "symbol", 5).where("keep").collect()}
    got = streamed(spark, bars, tmp_path, lambda s: ordered.retained(s, "symbol", 5, LATE))
    assert sorted(r.id for r in got) == sorted(want)


def test_missing_and_censored_bars(spark, bars, tmp_path):
    want = []
    for s in "ab":
        t = sorted(int(r.ts.timestamp()) for r in bars.collect() if r.symbol == s)
        for i, x in enumerate(t):
            ahead = [y == x + 900 * k for k, y in enumerate(t[i + 1 : i + 4], 1)]
            if not all(ahead) or len(ahead) == 3:  # the path of others is still open
                want.append((s, x, (x - t[i - 1]) // 900 - 1 if i else 0, not all(ahead)))
    got = streamed(spark, bars, tmp_path, lambda s: ordered.gaps(s, 900, 3, LATE))
    assert sorted((r.symbol, int(r.ts.timestamp()), r.missing, r.censored) for r in got) == sorted(want)
