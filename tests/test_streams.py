"""Streams in many micro-batches against their batch twins, and state under keys that come and go."""

import random
import uuid

import pytest

from orelode import streaming


def run(spark, df, path, make, parts=6):
    """The stream's rows and, for each micro-batch, its state rows: ``df`` in order of time, one file a batch."""
    rows = df.orderBy("ts").collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)
    name = f"s{uuid.uuid4().hex}"
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    return spark.table(name), [sum(o.numRowsTotal for o in p.stateOperators) for p in q.recentProgress]


@pytest.mark.parametrize("ttl", [0.0, 20.0])
def test_changes_equal_the_batch(spark, tmp_path, ttl):
    r = random.Random(3)
    rows = [(r.choice("abcd"), r.choice(["x", "y", None]), 1000 + 3 * k + (40 if k > 60 else 0)) for k in range(120)]
    df = spark.createDataFrame(rows, "key string, hash string, s long").selectExpr("key", "hash", "timestamp_seconds(s) ts")
    got, _ = run(spark, df, str(tmp_path / "c"), lambda s: streaming.change_feed(s, "5 seconds", ttl))
    same = lambda d: sorted(map(str, d.collect()))
    assert same(got) == same(streaming.change_feed_batch(df, ttl))


def test_state_stays_small_as_keys_come_and_go(spark, tmp_path):
    """Each key lives for a short time: far fewer are held than were seen."""
    df = spark.sql("select cast(id div 3 as string) key, cast(id as string) hash, timestamp_seconds(1000 + 10 * id) ts from range(600)")
    got, state = run(spark, df, str(tmp_path / "k"), lambda s: streaming.change_feed(s, "0 seconds", 60.0), 10)
    assert got.count() == 600 and max(state) < 150 and state[-1] < 80, state
    _, kept = run(spark, df.limit(300), str(tmp_path / "n"), lambda s: streaming.change_feed(s), 2)
    assert kept[-1] >= 100


def test_stale_keys_equal_the_batch(spark, tmp_path):
    df = spark.sql("select cast(id % 3 as string) key, timestamp_seconds(1000 + id) ts from range(30) union all select 'late', timestamp_seconds(5000) union all select 'last', timestamp_seconds(6000)")
    got, state = run(spark, df, str(tmp_path / "s"), streaming.stale_key_detection, 4)
    want = sorted((r.key, r.last_ts) for r in streaming.stale_key_batch(df).collect())
    assert sorted((r.key, r.last_ts) for r in got.collect()) == want
    assert {k for k, _ in want} == {"0", "1", "2", "late"} and state[-1] <= 4
