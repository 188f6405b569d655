"""Operators along time whose rules SQL can't state, held against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, gates, opportunity, policies, series, stories

START = dt.datetime(2024, 1, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("t")))


@pytest.mark.parametrize("bucket", [10, 1000, 10**9])
@pytest.mark.parametrize("touch", [False, True])
def test_chained_spans(spark, bucket, touch):
    r = random.Random(bucket)
    rows = [(k, i, s := r.randrange(3000), s + r.randrange(60)) for i, k in enumerate(r.choice("ab") for _ in range(400))]
    got = {x._id: x.taken for x in chains.chained_spans(spark.createDataFrame(rows, "_key string, _id long, _s long, _e long"), touch, bucket).collect()}
    want = {}
    for key in "ab":
        last = None
        for _, i, s, e in sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1])):
            want[i] = last is None or s > last or (touch and s == last)
            last = e if want[i] else last
    assert got == want


def test_neighbours_runs_and_places(spark):
    r = random.Random(1)
    rows = [(k, t, r.randrange(3)) for k in "xy" for t in sorted(r.sample(range(0, 86400 * 9, 3600), 120))]
    df = frame(spark, rows, "symbol string, t long, v int")
    back = {(x.symbol, x.t): x.p for x in series.previous(df, {"p": "v"}).collect()}
    ahead = {(x.symbol, x.t): x.p for x in series.previous(df, {"p": "v"}, ahead=True).collect()}
    runs = {(x.symbol, x.t): (x.run, x.place) for x in series.islands(series.previous(df, {"p": "v"}), F.coalesce(F.col("p") != F.col("v"), F.lit(True)), "run", place="place").collect()}
    for k in "xy":
        own = [x for x in rows if x[0] == k]
        run = place = 0
        for i, (_, t, v) in enumerate(own):
            assert back[k, t] == (own[i - 1][2] if i else None) and ahead[k, t] == (own[i + 1][2] if i + 1 < len(own) else None)
            new = not i or own[i - 1][2] != v
            run, place = run + new, 1 if new else place + 1
            assert runs[k, t] == (run, place)


def test_triggers_and_lifecycles(spark):
    r = random.Random(2)
    rows = [("s", 3600 * t, r.random() < 0.2, r.random() < 0.25, r.random() < 0.1) for t in range(300)]
    df = frame(spark, rows, "symbol string, t long, a boolean, b boolean, c boolean")
    got = {x.t for x in opportunity.triggers(df, [F.col("a"), F.col("b")], F.col("c"), 4).where("fired").collect()}
    life = {x.t: (x.fate, x.bars) for x in opportunity.lifecycles(df, F.col("a"), F.col("b"), F.col("c"), 4).withColumn("t", F.unix_timestamp("ts") - 1704067200).collect()}
    state = age = 0
    fired, fates, at = set(), {}, None
    for _, t, a, b, c in rows:
        if c:
            if state:
                fates[at] = ("cancelled", (t - at) // 3600) if t - at <= 4 * 3600 else ("expired", 5)
            state = age = 0
        elif state == 0:
            state, age, at = int(a), 0, t
        elif age + 1 > 4:
            fates[at] = ("expired", 5)
            state = age = 0
        elif b:
            fired.add(t)
            fates[at] = ("confirmed", (t - at) // 3600)
            state = age = 0
        else:
            age += 1
    assert got == fired
    assert {t: f for t, f in life.items() if t in fates} == fates


def test_observation_episodes(spark):
    r = random.Random(3)
    rows = [(i, "f" if i < 150 else "g", i * 60, r.choice([1, -1, 1])) for i in range(300)]
    got = {x.id: x.episode for x in opportunity.observation_episodes(frame(spark, rows, "id long, fold string, t long, side int"), 6, 2, 10).collect()}
    for fold in "fg":
        episode, n = 0, []
        for i, f, _, s in rows:
            if f == fold:
                assert got[i] == episode
                n.append(s)
                if len(n) >= 10 or (len(n) >= 6 and min(n.count(1), n.count(-1)) >= 2):
                    episode, n = episode + 1, []


def test_spaced_best_and_nth(spark):
    r = random.Random(4)
    rows = [(f"i{k}", r.choice("ab"), r.randrange(200) * 600, round(r.random(), 2)) for k in range(120)]
    df = frame(spark, rows, "id string, symbol string, t long, score double")
    got = [(x.id, x.score) for x in policies.spaced_best(df, 15, 3600).collect()]
    taken = []
    for i, key, t, s in sorted(rows, key=lambda x: (-x[3], x[0])):
        if all(k != key or abs(t - u) >= 3600 for k, u, _, _ in taken):
            taken.append((key, t, i, s))
    assert got == [(i, s) for _, _, i, s in sorted(taken, key=lambda x: (-x[3], x[2]))[:15]]
    values = sorted(x[3] for x in rows)
    for n in (1, 2, 60, 119, 120):
        assert gates.nth_smallest(df, "score", n, bands=4) == values[n - 1]


def test_spaced_best_of_the_given_rows(spark):
    from tests.conftest import SF
    from tidemark.plans.policies import one

    df = one(spark, SF.replace("0.001", "0.01")).withColumn("score", F.round("p2", 1))  # ties
    best, near = [], {}
    for r in sorted(df.select("id", "symbol", "score", F.unix_timestamp("ts").alias("t")).collect(), key=lambda r: (-r.score, r.id)):
        b = r.t // 7200
        if all(abs(r.t - t) >= 7200 for k in (b - 1, b, b + 1) for t in near.get((r.symbol, k), ())):
            near.setdefault((r.symbol, b), []).append(r.t)
            best.append((r.id, r.symbol, r.score))
    for k in (40, len(best) + 1):
        assert [tuple(r) for r in policies.spaced_best(df, k, 7200).collect()] == best[:k]
    assert policies.spaced_best(df, 10**6, 0).count() == df.count()


def test_title_clusters(spark):
    rows = [(1, "Oil price rises again on supply worries"), (2, "Oil price rises again on supply worries now"), (3, "Oil price rises by 5 on supply worries"), (4, ""), (5, None), (6, "Quite another thing")]
    got = {x.id: x.cluster for x in stories.title_clusters(spark.createDataFrame(rows, "id long, title string")).collect()}
    assert got[1] == got[2] != got[3] and got[6] == "quite another thing" and not got[4]


def test_conditions_refuse_other_names():
    for bad in ("x > 1", "p0 > 1; drop", "p0 > (select 1)"):
        with pytest.raises(ValueError):
            policies.condition(bad, {"p0"})
    names = list("abcde")
    turned = policies.derangement(names, 3)
    assert set(turned.values()) == set(names) and all(k != v for k, v in turned.items())
