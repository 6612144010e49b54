import math
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from conftest import SF
from emberfold.operators import timeline as TL
from emberfold.plans import catalog
from emberfold.session import new_path

EPOCH = 1_700_000_000


def events(spark, rows, name="ok"):
    return spark.createDataFrame(rows, f"k string, us long, id long, {name} boolean").withColumn(
        "ts", F.timestamp_micros("us"))


def busy(seed, n=600, span_s=4_000):
    rng = random.Random(seed)
    # One key holds most of the rows; others are sparse; some times repeat.
    return [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}",
             (EPOCH + rng.randrange(0, span_s, 2)) * 1_000_000, i, rng.random() < 0.4) for i in range(n)]


def test_bucket_example():
    states, outcomes = [None, None], []
    for now in [100.0] * 6 + [112.0, 112.0]:
        outcomes.append(TL.decide(states, now, TL.GUARD, TL.SHARED))
    assert outcomes == [("allowed", 0)] * 5 + [("shared_bucket", 12), ("allowed", 0), ("shared_bucket", 12)]
    assert TL.Bucket(5, 12.0, 10.0).take((0.0, 100.0), 110.0)[0] == (4.0, 110.0)  # expired: full again
    tight = TL.Bucket(1, 3.0)
    states = [None, None]
    assert [TL.decide(states, t, tight, TL.SHARED)[0] for t in (0.0, 1.0, 3.0)] == ["allowed", "local_guard", "allowed"]


def test_batch_decisions_equal_a_plain_walk(spark):
    rows = busy(1, span_s=600)
    states, want = {}, {}
    for k, us, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = TL.decide(states.setdefault(k, [None, None]), us / 1e6, TL.GUARD, TL.SHARED)
    got = {r.id: (r.outcome, r.retry_after) for r in TL.rate_limit(events(spark, rows), "k", "id").collect()}
    assert got == want
    assert {o for o, _ in want.values()} == {"allowed", "shared_bucket", "local_guard"}


def test_backoff_equals_a_plain_walk(spark):
    rows = busy(2, span_s=40_000)
    streak, want = {}, {}
    for k, us, i, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        streak[k] = 0 if ok else streak.get(k, 0) + 1
        if not ok:
            want[i] = (streak[k], min(60 * 2 ** min(streak[k] - 1, 30), 900))
    for parts in (None, 9):
        got = {r.id: (r.failure_count, r.delay_seconds) for r in TL.failure_backoff(
            events(spark, rows, "succeeded"), "k", "id", parts=parts).collect()}
        assert got == want
    run = [("a", (EPOCH + i) * 1_000_000, i, i == 5) for i in range(7)]
    got = TL.failure_backoff(events(spark, run, "succeeded"), "k", "id").orderBy("id").collect()
    assert [r.delay_seconds for r in got] == [60, 120, 240, 480, 900, 60]
    assert got[0].retry_at - got[0].ts == timedelta(seconds=60)
    custom = TL.failure_backoff(events(spark, run, "succeeded"), "k", "id", 10, 25).orderBy("id").collect()
    assert [r.delay_seconds for r in custom][:4] == [10, 20, 25, 25]


def test_freshness_equals_a_plain_lookup(spark):
    rows = busy(3, span_s=20_000)
    reads = events(spark, [r for r in rows if r[3]]).select("k", F.col("ts").alias("read_at"), "id")
    loads = events(spark, [r for r in rows if not r[3]]).select("k", F.col("ts").alias("succeeded_at"))
    want = {}
    for k, us, i, ok in rows:
        if ok:
            known = [u for kk, u, _, o in rows if kk == k and not o and u <= us]
            age = us - max(known) if known else None
            want[i] = (bool(known), None if age is None else age // 1_000_000,
                       None if age is None else age >= 600_000_000)
    for parts in (None, 7):
        got = {r.id: (r.available, r.data_age_seconds, r.data_stale)
               for r in TL.freshness(reads, loads, "k", ttl_s=600, parts=parts).collect()}
        assert got == want


def test_freshness_limit_is_inclusive(spark):
    at = lambda s: F.timestamp_seconds(F.lit(EPOCH + s))
    loads = spark.range(1).select(F.lit("a").alias("k"), at(0).alias("succeeded_at"))
    reads = spark.range(1).select(F.lit("a").alias("k"), F.explode(F.array(at(-1), at(0), at(3599), at(3600))).alias("read_at"))
    got = [(r.available, r.data_age_seconds, r.data_stale)
           for r in TL.freshness(reads, loads, "k").orderBy("read_at").collect()]
    assert got == [(False, None, None), (True, 0, False), (True, 3599, False), (True, 3600, True)]


def test_streams_equal_batches(spark):
    queries = catalog.queries()
    rows = lambda name: sorted(map(tuple, queries[name](spark, SF).collect()))
    assert rows("t04_token_bucket_stream") == rows("t04_token_bucket")
    dedup = rows("t02_stream_dedup")
    assert len(dedup) == len(set(dedup)) == len(rows("v11_deduplicate"))


def test_sessions_merge_at_exactly_one_gap(spark):
    from emberfold.streaming.ingest import session_stream
    rows = [(42.0, -8.6, EPOCH), (42.0, -8.6, EPOCH + 86_400), (42.0, -8.6, EPOCH + 2 * 86_400 + 60)]
    df = spark.createDataFrame(rows, "latitude double, longitude double, t long").withColumn(
        "observed_at", F.timestamp_seconds("t"))
    assert sorted(r.detections for r in TL.location_sessions(df).collect()) == [1, 2]
    assert sorted(r.detections for r in session_stream(df, ["latitude", "longitude"]).collect()) == [1, 2]
