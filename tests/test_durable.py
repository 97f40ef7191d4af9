"""Runs of hits over hot keys, streams that stop and go on, the snapshot store, observed counters."""

import itertools
import random

from pyspark.sql import functions as F

from factloom.operators import snapshots as S
from factloom.operators.ordering import runs
from factloom.streaming import durable, jobs


def rows_of(n, seed):
    """(user, place, failed): one user has half of the rows and fails nearly always; some rows have no user."""
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.5 else rng.choice([None, *range(2, 9)]), i, rng.choice([True] * 30 + [False, None])) for i in range(n)]


def test_runs_of_a_hot_key(spark):
    """A run goes on over partitions, some of which hold nothing but hits."""
    rows = rows_of(4000, 2) + [(1, 10_000 + i, True) for i in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "user long, place long, failed boolean").repartition(8)
        got = {(r.user, r.place): r.n for r in runs(df, ["user"], [F.col("place").asc()], F.col("failed"), "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for user, some in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), key=lambda r: r[0]):
        n = 0
        for _, place, failed in some:
            n = n + 1 if failed else 0
            want[user, place] = n
    assert got == want and max(want.values()) > 1500


def events(spark, n):
    rows = [(u, i, f) for u, i, f in rows_of(n, 5)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, failed boolean")
    return rows, df.withColumns({"ts": F.timestamp_seconds(F.col("event_id") * 10), "failed": F.coalesce("failed", F.lit(False))})


def test_stopped_runs_give_what_an_unbroken_one_gives(spark, tmp_path):
    """Stopped after every batch, each time before the checkpoint knows of it; every batch is written twice and counted once."""
    rows, df = events(spark, 900)
    want = {}
    for user, _, failed in rows:
        want[user] = want.get(user, 0) + 1 if failed else 0
    whole = durable.in_pieces(df, f"file://{tmp_path}/a", 100_000, 4, "ts", "event_id")
    unbroken = durable.advance(whole, jobs.failures, f"file://{tmp_path}/a")
    assert {r.user_id: r.failures for r in unbroken.collect()} == want
    broken = durable.in_pieces(df, f"file://{tmp_path}/b", 100_000, 4, "ts", "event_id")
    seen = []

    def step(batch, before):
        seen.append(batch.count())
        return jobs.failures(batch, before)

    durable.advance(broken, step, f"file://{tmp_path}/b", stop_after=1)
    durable.advance(broken, step, f"file://{tmp_path}/b", stop_after=2)
    at_end = durable.advance(broken, step, f"file://{tmp_path}/b")
    assert {r.user_id: r.failures for r in at_end.collect()} == want
    assert sum(seen) > len(rows)  # batches were run again
    assert len(durable._batches(spark, f"file://{tmp_path}/b")) <= 2
    again = durable.advance(broken, step, f"file://{tmp_path}/b")
    assert {r.user_id: r.failures for r in again.collect()} == want


def test_daily_counts_over_batches(spark, tmp_path):
    _, df = events(spark, 500)
    days = df.withColumn("event_type", F.when(F.col("failed"), "error").otherwise("ok")).select("ts", "event_type", "event_id")
    stream = durable.in_pieces(days, f"file://{tmp_path}", 100_000, 3, "ts", "event_id")
    got = durable.advance(stream, jobs.daily_counts, f"file://{tmp_path}")
    want = days.groupBy(F.col("ts").cast("date").alias("day"), "event_type").count()
    assert sorted(map(tuple, got.select("day", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_snapshot_store(spark, tmp_path):
    """Texts are kept once; a run that is repeated changes nothing; pages may lack a text."""
    store = S.SnapshotStore(spark, f"file://{tmp_path}/s", ["url"])
    first = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "")], "url string, text string")
    second = spark.createDataFrame([("a", "y"), ("b", "x"), ("c", "x"), ("d", None), ("e", "z")], "url string, text string")
    store.append(1, first)
    for _ in range(2):
        store.append(2, second)
    assert sorted((r.text, r.run) for r in store.texts().collect()) == [("", 1), ("x", 1), ("y", 2), ("z", 2)]
    got = sorted((r.url, r.run, r.changed, r.text) for r in store.history().collect())
    assert got == [("a", 1, True, "x"), ("a", 2, True, "y"), ("b", 1, True, "x"), ("b", 2, False, "x"), ("c", 1, True, ""), ("c", 2, True, "x"), ("d", 1, True, ""), ("d", 2, True, ""), ("e", 2, True, "z")]


def test_observed_counters(spark, tmp_path):
    rows = spark.range(1000).withColumn("odd", F.col("id") % 2 == 1)
    told = S.observed_write(rows, f"file://{tmp_path}/o", {"n": F.count(F.lit(1)), "odd": F.count_if("odd"), "top": F.max("id")})
    assert told == {"n": 1000, "odd": 500, "top": 999} and spark.read.parquet(f"file://{tmp_path}/o").count() == 1000
