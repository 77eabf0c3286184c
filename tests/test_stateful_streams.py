"""Streams with state variables, timers and joins, against their batch forms over other borders of batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorica.streaming import replay, state, stateful

START = dt.datetime(2024, 1, 1)
EVENT = "user_id long, ts timestamp, event_id long, kind string, value double"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def made_events(seed, n=220, users=9, span=4000):
    r = random.Random(seed)
    return [(r.randrange(users), at(r.randrange(span * 4) / 4), k, r.choice(["play", "playing", "ended", "pause"]), float(r.randrange(9))) for k in range(n)]


def streamed(spark, root, rows, batches, delay, schema=EVENT):
    """The rows in the order of their times, moved about by less than the delay, in so many files one after the other."""
    r = random.Random(batches)
    rows = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=r.random() * delay * 0.9))
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_players(spark, tmp_path, batches):
    rows = made_events(1)
    stream = streamed(spark, f"{tmp_path}/in", [*rows, (99, at(50_000), 9999, "ended", 0.0)], batches, 300)
    out = replay.drained(stateful.playback_stream(stream, "user_id", 3, 60.0, "300 seconds"), f"{tmp_path}/q", "update")
    newest = out.where("user_id < 99").groupBy("user_id").agg(F.max(F.struct("events", "stalled", "part", "runs", "finished")).alias("s")).select("user_id", "s.*")
    events = spark.createDataFrame(rows, EVENT)
    want = {tuple(r) for r in state.playback(events, "user_id", 3).collect()}
    assert {(r["user_id"], r["part"], r["runs"], r["finished"]) for r in newest.collect()} == want and len(want) == 9
    waiting = {r[0] for r in stateful.stalled(events, "user_id", 60.0, F.lit(at(50_000))).collect()}
    assert {r["user_id"] for r in newest.where("stalled").collect()} == waiting and 0 < len(waiting) < 9
    assert {r["events"] for r in newest.collect()} == {sum(x[0] == u for x in rows) for u in range(9)}


def test_a_play_that_begins_in_time(spark, tmp_path):
    play = [(u, at(0), u, "play", 0.0) for u in (1, 2, 3)]
    later = [(9, at(30), 6, "ended", 0.0), (1, at(59), 7, "playing", 0.0), (9, at(60.5), 8, "ended", 0.0), (9, at(60.8), 9, "ended", 0.0), (2, at(61), 10, "playing", 0.0), (9, at(500), 11, "pause", 0.0)]
    root = f"{tmp_path}/in"
    for rows in [play, *([r] for r in later)]:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(root)
    out = replay.drained(stateful.playback_stream(stream, "user_id", 3, 60.0, "0 seconds"), f"{tmp_path}/q", "update")
    assert {(r["user_id"]) for r in out.where("stalled").collect()} == {2, 3}  # 2 began too late and is no longer stalled
    newest = {r["user_id"]: r["s"]["stalled"] for r in out.groupBy("user_id").agg(F.max(F.struct("events", "stalled")).alias("s")).collect()}
    assert newest == {1: False, 2: False, 3: True, 9: False}


@pytest.mark.parametrize("batches", [1, 4])
def test_values_that_expire(spark, tmp_path, batches):
    rows = made_events(2)
    seen = [(*x, x[1] + dt.timedelta(seconds=1)) for x in rows] + [(0, at(4100), 5000, "x", 7.0, at(100)), (42, at(4000), 5001, "x", 7.0, at(3999))]
    end = 4000
    schema = f"{EVENT}, seen timestamp"
    stream = streamed(spark, f"{tmp_path}/in", [*seen, (99, at(end + 300), 9999, "x", 0.0, at(end + 300))], batches, 300, schema)
    days = 500 / 86400
    out = replay.drained(stateful.unexpired_stream(stream, "user_id", "value", days, "300 seconds", "seen"), f"{tmp_path}/q", "update")
    events = spark.createDataFrame(rows, EVENT)
    now = F.lit(at(end))  # the last watermark
    newest = state.latest(events, ["user_id"], "value")
    batch = newest.where((F.col("ts") <= now) & (F.unix_micros("ts") + 500_000_000 >= F.unix_micros(now)))
    kept = out.where("user_id < 99").groupBy("user_id").agg(F.max_by(F.struct("value", "ts", "live"), F.struct("ts", "event_id", ~F.col("live"))).alias("s")).select("user_id", "s.*")
    assert {tuple(r) for r in kept.where("live").select("user_id", "value", "ts").collect()} == {tuple(r) for r in batch.select("user_id", "value", "ts").collect()}
    assert {tuple(r) for r in kept.select("user_id", "value", "ts").collect()} == {tuple(r) for r in newest.select("user_id", "value", "ts").collect()}
    gone = out.where("not live").groupBy("user_id", "event_id").count()
    assert gone.where("count > 1").isEmpty() and 0 < kept.where("not live").count() < 9


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_consents_in_order(spark, tmp_path, batches):
    r = random.Random(5)
    rows = [(u, t, i, r.random() < 0.6 if k in ("play", "ended") else None) for u, t, i, k, _ in made_events(3)]
    schema = "user_id long, ts timestamp, event_id long, granted boolean"
    stream = streamed(spark, f"{tmp_path}/in", [*rows, (99, at(50_000), 9999, None)], batches, 400, schema)
    out = replay.drained(stateful.consented_in_order(stream, "user_id", "400 seconds"), f"{tmp_path}/q", "append")
    every = spark.createDataFrame(rows, schema)
    batch = state.consented(every.where("granted is null"), every.where("granted is not null").select("user_id", "ts", "granted"), "user_id")
    got = sorted(x["event_id"] for x in out.collect())
    assert got == sorted(x["event_id"] for x in batch.collect()) and len(got) > 20


def test_late_events_are_dropped(spark, tmp_path):
    schema, root = "user_id long, ts timestamp, event_id long, granted boolean", f"{tmp_path}/in"
    for row in [(1, at(0), 1, True), (1, at(1000), 2, None), (1, at(2000), 3, None), (1, at(500), 4, False), (1, at(1990), 5, False), (1, at(9000), 6, None)]:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
    out = replay.drained(stateful.consented_in_order(stream, "user_id", "100 seconds"), f"{tmp_path}/q", "append")
    assert sorted(x["event_id"] for x in out.collect()) == [2]  # 4 is too late to matter, 5 comes in time and forbids 3


@pytest.mark.parametrize("batches", [1, 3, 8])
def test_suppression_by_an_interval_join(spark, tmp_path, batches):
    rows = made_events(4, 300)
    events, moves = ([x for x in rows if (x[3] == "play") != own] for own in (True, False))
    end = lambda k: (99, at(50_000 + k), 9999 + k, "end", 0.0)
    e, n = (streamed(spark, f"{tmp_path}/{k}", [*x, end(0), end(1)], batches, 200) for k, x in (("e", events), ("n", moves)))
    out = replay.drained(stateful.unsuppressed_stream(e, n, "user_id", 40.0, "200 seconds"), f"{tmp_path}/q", "append")
    batch = state.unsuppressed(spark.createDataFrame(events, EVENT), spark.createDataFrame(moves, EVENT).select("user_id", "ts"), "user_id", 40.0)
    got = sorted(x["event_id"] for x in out.where("user_id < 99").collect())
    assert got == sorted(x["event_id"] for x in batch.collect()) and 5 < len(got) < len(events) - 5


def test_a_batch_delivered_twice(spark, tmp_path):
    sink, root = replay.once(f"{tmp_path}/t"), f"{tmp_path}/t"
    one, two = (spark.createDataFrame([(k,)], "v long") for k in (1, 2))
    sink(one, 0)
    sink(two, 1)
    sink(one, 0)
    assert sorted(r["v"] for r in spark.read.parquet(root).collect()) == [1, 2]
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "run=0000000001").iterdir()}
    sink(one, 0)
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t" / "run=0000000001").iterdir()} == before


def test_a_replay_has_a_batch_for_each_slice_however_many_files(spark, tmp_path):
    events = spark.createDataFrame([(k % 7, at(k), k) for k in range(240)], "user_id long, ts timestamp, event_id long").repartition(6)
    stream = replay.replayed(events, f"{tmp_path}/in")
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 6
    out = replay.drained(stream.withWatermark("ts", replay.lateness(events)), f"{tmp_path}/q", "append")
    assert out.count() == 240 and out.select("run").distinct().count() <= 3


def test_keys_in_one_share_stay_apart(spark, tmp_path):
    large = (1 << 62) + 1
    schema = "user_id long, ts timestamp, event_id long, granted boolean"
    rows = [(None, at(0), 1, True), (large, at(0), 2, False), (large + 1, at(1), 3, True), (None, at(2), large, None), (large, at(2), 5, None), (large + 1, at(2), None, None), (large + 1, at(3), large + 2, None)]
    stream = streamed(spark, f"{tmp_path}/in", [*rows, (99, at(5000), 9, None)], 3, 1, schema)
    out = replay.drained(stateful.consented_in_order(stream, "user_id", "10 seconds", shares=1), f"{tmp_path}/q", "append")
    assert {(r["user_id"], r["event_id"]) for r in out.collect()} == {(None, large), (large + 1, None), (large + 1, large + 2)}
    stream = streamed(spark, f"{tmp_path}/in2", [(u, t, e, "play" if g is None else "ended") for u, t, e, g in rows], 3, 1, "user_id long, ts timestamp, event_id long, kind string")
    out = replay.drained(stateful.playback_stream(stream, "user_id", 1, 60.0, "10 seconds", shares=1), f"{tmp_path}/p", "update")
    newest = {r["user_id"]: tuple(r["s"]) for r in out.groupBy("user_id").agg(F.max(F.struct("events", "part", "runs")).alias("s")).collect()}
    assert newest == {None: (2, 0, 1), large: (2, 0, 1), large + 1: (3, 0, 1)}
