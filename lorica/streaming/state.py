"""Reader state from events: batch forms, and the same on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ORDER = ("ts", "event_id")


def latest(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*ORDER)).alias(value), F.max("ts").alias("ts"))


def unexpired(state: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """State that is not from the future and not older than the given days (both ends count)."""
    return state.where((F.col("ts") <= now) & (F.col("ts") >= now - F.make_dt_interval(days=F.lit(days))))


def toggled(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose number of toggles is odd."""
    return events.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).drop("n")


def first_crossing(events: DataFrame, key: str, threshold: float) -> DataFrame:
    """The first event of each key whose value reaches the threshold."""
    return events.where(F.col("value") >= threshold).groupBy(key).agg(F.min(F.struct(*ORDER)).alias("f")).select(key, F.col("f.ts").alias("ts"), F.col("f.event_id").alias("event_id"))


def engaged(events: DataFrame, key: str, tick: int, target: int) -> DataFrame:
    """The event at which each key's ticks (of so many seconds each) first make the target."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*ORDER))
    return events.withColumn("k", nth).where(F.col("k") * tick >= target).groupBy(key).agg(F.min(F.struct("k", *ORDER)).alias("f")).select(key, F.col("f.ts").alias("ts"), F.col("f.event_id").alias("event_id"))


def consented(events: DataFrame, consents: DataFrame, key: str) -> DataFrame:
    """Events for which the latest consent (key, ts, granted) at that time is a grant."""
    c = consents.select(key, "ts", F.lit(0).cast("long").alias("event_id"), F.col("granted"), F.lit(0).alias("kind"))
    e = events.select(key, "ts", "event_id", F.lit(None).cast("boolean").alias("granted"), F.lit(1).alias("kind"))
    w = Window.partitionBy(key).orderBy("ts", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ok = c.union(e).withColumn("now", F.last("granted", ignorenulls=True).over(w))
    return ok.where("kind = 1 and coalesce(now, false)").select("event_id")


def throttled(events: DataFrame, key: str, gap: float) -> DataFrame:
    """Events kept when at least ``gap`` seconds follow the last kept one of the key. Sequential within a key: its events
    pass in order, and only the time of the last kept one is held."""
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            at, kept = b.column(1).cast(pa.int64()).to_pylist(), []
            for i, k in enumerate(b.column(0).to_pylist()):
                if i == 0 and last is None or k != now:
                    now, last = k, None
                if last is None or at[i] - last >= gap * 1_000_000:
                    last = at[i]
                    kept.append(i)
            rows = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows)], [key, "event_id"])

    dealt = events.select(key, F.unix_micros("ts").alias("at"), "event_id").repartition(key).sortWithinPartitions(key, "at", "event_id")
    return dealt.mapInArrow(run, f"{key} {kind}, event_id long")


def throttled_stream(events: DataFrame, key: str, gap: float) -> DataFrame:
    """throttled() on a stream; state: the time of the last kept event of each key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(list(ORDER)).itertuples():
            at = row.ts.timestamp()
            if last is None or at - last >= gap:
                last = at
                out.append((k[0], row.event_id))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long", "last double", "append", GroupStateTimeout.NoTimeout)


def crossing_stream(events: DataFrame, key: str, threshold: float, lateness: str = "1 day") -> DataFrame:
    """One event for each key that reaches the threshold, once."""
    return events.where(F.col("value") >= threshold).withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key]).select(key, "ts", "event_id")


def latest_stream(events: DataFrame, key: str, value: str) -> DataFrame:
    """latest() on a stream, in update or complete mode."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*ORDER)).alias(value), F.max("ts").alias("ts"))


def playback(events: DataFrame, key: str, parts: int | Column) -> DataFrame:
    """Where each key's player stands. events (key, ts, event_id, kind): every 'ended' moves on by one part, behind the
    last part the article is finished and begins anew with the next 'play'; so the number of 'ended' says it all, and
    nothing is folded. Returns part (from 0), runs (times finished) and finished (nothing was played since)."""
    n = F.lit(parts) if isinstance(parts, int) else parts
    seen = events.groupBy(key).agg(F.count_if(F.col("kind") == "ended").alias("ended"), F.max_by("kind", F.struct(*ORDER)).alias("last"))
    done = (F.col("ended") > 0) & (F.col("ended") % n == 0) & (F.col("last") == "ended")
    return seen.select(key, (F.col("ended") % n).alias("part"), F.floor(F.col("ended") / n).alias("runs"), done.alias("finished"))


def unsuppressed(events: DataFrame, navigations: DataFrame, key: str, seconds: float = 8.0) -> DataFrame:
    """Events at least so many seconds after the key's latest own navigation (one at the same time counts as before)."""
    n = navigations.select(key, "ts", F.lit(None).cast("long").alias("event_id"), F.lit(0).alias("kind"))
    e = events.select(key, "ts", "event_id", F.lit(1).alias("kind"))
    w = Window.partitionBy(key).orderBy("ts", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = n.union(e).withColumn("last", F.max(F.when(F.col("kind") == 0, F.col("ts"))).over(w))
    quiet = F.col("last").isNull() | (F.col("ts").cast("double") - F.col("last").cast("double") >= seconds)
    return both.where((F.col("kind") == 1) & quiet).select("event_id")


def engaged_stream(events: DataFrame, key: str, tick: int, target: int) -> DataFrame:
    """engaged() on a stream: state is a key's number of ticks; its event goes out once."""
    needed = -(-target // tick)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(list(ORDER))
        state.update((before + len(rows),))
        at = needed - before - 1
        yield pd.DataFrame({key: [k[0]], "event_id": [rows["event_id"].iloc[at]]} if 0 <= at < len(rows) else {key: [], "event_id": []})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long", "ticks long", "append", GroupStateTimeout.NoTimeout)


def toggled_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """toggled() on a stream, in complete mode: keys that are switched on."""
    return events.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("on"))


def consented_stream(events: DataFrame, key: str) -> DataFrame:
    """consented() on one stream of both: rows (key, ts, event_id, granted), granted set for consents alone. State is the
    key's latest consent; an event that comes before its consent is dropped."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = bool(state.exists and state.get[0]), []
        rows = pd.concat(list(batches))
        rows = rows.assign(kind=rows["granted"].isna()).sort_values(["ts", "kind", "event_id"])
        for r in rows.itertuples():
            if r.kind:
                out += [(k[0], r.event_id)] if now else []
            else:
                now = bool(r.granted)
        state.update((now,))
        yield pd.DataFrame(out, columns=[key, "event_id"])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, event_id long", "granted boolean", "append", GroupStateTimeout.NoTimeout)
