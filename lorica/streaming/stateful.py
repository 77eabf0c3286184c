"""Reader state on streams with state variables and timers in event time. Each has a batch form, with which it agrees
whatever the borders of the batches are, as long as no event comes later than the watermark allows; what comes later is
dropped before it reaches any state.

Every call into Python and every access to a state variable costs milliseconds, so keys are dealt to shares by their hash,
and a share is what has state: a table of its keys, as one Arrow value, and one timer, for the key that is due first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .state import ORDER

#: The store that state variables need.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SHARES = 64
#: Stands for a missing event_id, so that whole numbers stay whole in pandas.
NO_ID = -(1 << 63)


def _prepared(events: DataFrame, key: str, lateness: str, shares: int, *columns: Column | str) -> DataFrame:
    """share, who (the key as text), micros, event_id and the columns."""
    for k, v in ROCKS.items():
        events.sparkSession.conf.set(k, v)
    share = F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share")
    return events.withWatermark("ts", lateness).select(share, F.col(key).cast("string").alias("who"), "ts", F.unix_micros("ts").alias("micros"), F.coalesce(F.col("event_id").cast("long"), F.lit(NO_ID)).alias("event_id"), *columns)


def _finished(found: DataFrame, key: str, events: DataFrame, *columns: Column | str) -> DataFrame:
    return found.select(F.col("who").cast(events.schema[key].dataType).alias(key), *columns)


def _id() -> Column:
    return F.nullif(F.col("event_id"), F.lit(NO_ID)).alias("event_id")


def _packed(rows: pd.DataFrame) -> tuple[bytes]:
    batch, sink = pa.RecordBatch.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: tuple) -> pd.DataFrame:
    return pa.ipc.open_stream(value[0]).read_pandas()


def _timer_only(handle: StatefulProcessorHandle, at: int | None) -> None:
    """The share's only timer from now on, in milliseconds."""
    at = None if at is None else int(at)
    timers = list(handle.listTimers())
    for t in timers:
        if t != at:
            handle.deleteTimer(t)
    if at is not None and at not in timers:
        handle.registerTimer(at)


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """Each key's last row by time and event_id."""
    return rows.sort_values(["micros", "event_id"], kind="stable").drop_duplicates("who", keep="last")


class Player(StatefulProcessor):
    """The readers' players: how many parts have ended, what came last, and whether a play that was asked for has not begun
    within ``patience`` microseconds (the timer)."""

    def __init__(self, parts: int, patience: int):
        self.parts, self.patience = parts, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.players = handle.getValueState("players", "rows binary")

    def _due(self, p: pd.DataFrame) -> pd.Series:
        """When each player that waits for a play has waited for too long, in milliseconds."""
        return ((p["micros"] + self.patience) // 1000 + 1)[(p["kind"] == "play") & ~p["stalled"]]

    def _keep(self, p: pd.DataFrame) -> None:
        self.players.update(_packed(p))
        due = self._due(p)
        _timer_only(self.handle, due.min() if len(due) else None)

    def _standing(self, p: pd.DataFrame) -> pd.DataFrame:
        done = (p["ended"] > 0) & (p["ended"] % self.parts == 0) & (p["kind"] == "ended")
        return pd.DataFrame({"who": p["who"], "events": p["events"], "part": p["ended"] % self.parts, "runs": p["ended"] // self.parts, "finished": done, "stalled": p["stalled"]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["who", "micros", "event_id", "kind"]].assign(events=1, stalled=False)
        new["ended"] = (new["kind"] == "ended").astype("int64")
        came = new["who"].unique()
        if self.players.exists():
            new = pd.concat([_unpacked(self.players.get()), new])
        last = new.sort_values(["micros", "event_id", "kind"], kind="stable").drop_duplicates("who", keep="last")
        sums = new.groupby("who", dropna=False)[["events", "ended"]].sum().reset_index()
        p = last.drop(columns=["events", "ended"]).merge(sums, "left", on="who").reset_index(drop=True)
        now = p["who"].isin(came)
        p["stalled"] = p["stalled"] & ~now
        self._keep(p)
        yield self._standing(p[now])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        p = _unpacked(self.players.get())
        due = self._due(p)
        late = due.index[due < timerValues.getCurrentWatermarkInMs()]
        p.loc[late, "stalled"] = True
        self._keep(p)
        yield self._standing(p.loc[late])

    def close(self) -> None:
        pass


def playback_stream(events: DataFrame, key: str, parts: int, patience: float = 12.0, lateness: str = "10 minutes", shares: int = SHARES) -> DataFrame:
    """playback() and stalled() on a stream of (key, ts, event_id, kind), in update mode: where each player stands whenever
    that may have changed; of a key's rows the one with the most events and, among these, stalled, is the newest."""
    rows = _prepared(events, key, lateness, shares, F.coalesce("kind", F.lit("")).alias("kind"))
    found = rows.groupBy("share").transformWithStateInPandas(Player(parts, round(patience * 1_000_000)), "who string, events long, part long, runs long, finished boolean, stalled boolean", "update", "eventTime")
    return _finished(found, key, events, "events", "part", "runs", "finished", "stalled")


def stalled(events: DataFrame, key: str, patience: float, now: Column) -> DataFrame:
    """Keys whose last event is a play that has waited for longer than so many seconds."""
    last = events.groupBy(key).agg(F.max_by("kind", F.struct(*ORDER)).alias("last"), F.max("ts").alias("ts"))
    return last.where((F.col("last") == "play") & (F.unix_micros("ts") + round(patience * 1_000_000) < F.unix_micros(now))).select(key)


class Latest(StatefulProcessor):
    """Each key's newest value, forgotten so many microseconds after its time."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "rows binary")

    def _due(self, rows: pd.DataFrame) -> pd.Series:
        return (rows["micros"] + self.ttl) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["who", "micros", "event_id", "value"]].iloc[::-1].assign(live=True)  # of equal rows the first
        if self.newest.exists():
            new = pd.concat([new, _unpacked(self.newest.get()).assign(live=False)])
        newest = _newest(new)
        self.newest.update(_packed(newest.drop(columns="live")))
        _timer_only(self.handle, self._due(newest).min())
        yield newest[newest["live"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = _unpacked(self.newest.get())
        gone = self._due(newest) < timerValues.getCurrentWatermarkInMs()
        rest = newest[~gone]
        if len(rest):
            self.newest.update(_packed(rest))
        else:
            self.newest.clear()
        _timer_only(self.handle, self._due(rest).min() if len(rest) else None)
        yield newest[gone].assign(live=False)

    def close(self) -> None:
        pass


def unexpired_stream(events: DataFrame, key: str, value: str, days: float = 30, lateness: str = "10 minutes", seen: str | None = None, shares: int = SHARES) -> DataFrame:
    """latest() with unexpired() on a stream of (key, ts, event_id, value), in update mode: a key's new value (live), and
    once, when the watermark is ``days`` past its time, that it is gone (not live); its state is then deleted. seen: a column
    with the time at which an event came in; an event from the future, later than that, is rejected."""
    known = events if seen is None else events.where(F.col("ts") <= F.col(seen))
    rows = _prepared(known, key, lateness, shares, F.col(value).cast("double").alias("value"))
    found = rows.groupBy("share").transformWithStateInPandas(Latest(round(days * 86_400_000_000)), "who string, micros long, event_id long, value double, live boolean", "update", "eventTime")
    return _finished(found, key, events, F.timestamp_micros("micros").alias("ts"), _id(), F.col("value").alias(value), "live")


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, so that a key's rows are looked at in order of time whichever
    way they came. State: what waits, and each key's latest consent before that."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.granted = handle.getValueState("granted", "rows binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = min(self.handle.listTimers(), default=None)
        for b in rows:
            # yes: 1 or 0 of a consent, missing for an event
            new = b[["who", "micros", "event_id"]].assign(kind=b["granted"].isna().astype("int8"), yes=b["granted"].astype("float"))
            self.waiting.appendValue(_packed(new))
            due = int(new["micros"].min()) // 1000 + 1
            first = due if first is None else min(first, due)
        _timer_only(self.handle, first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.concat([_unpacked(r) for r in self.waiting.get()])
        passed = rows["micros"] <= timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = rows[passed].sort_values(["micros", "kind", "event_id", "yes"], kind="stable"), rows[~passed]
        if self.granted.exists():
            due = pd.concat([_unpacked(self.granted.get()).assign(kind=0, event_id=0), due])
        due["yes"] = due.groupby("who", dropna=False)["yes"].ffill()
        said = due[due["yes"].notna()].drop_duplicates("who", keep="last")
        if len(said):
            self.granted.update(_packed(said[["who", "yes"]]))
        if len(rest):
            self.waiting.put([_packed(rest)])
        else:
            self.waiting.clear()
        _timer_only(self.handle, int(rest["micros"].min()) // 1000 + 1 if len(rest) else None)
        yield due[(due["kind"] == 1) & (due["yes"] == 1)][["who", "event_id"]]

    def close(self) -> None:
        pass


def consented_in_order(events: DataFrame, key: str, lateness: str = "10 minutes", shares: int = SHARES) -> DataFrame:
    """consented() on one stream of both: rows (key, ts, event_id, granted), granted set for consents alone. An event goes
    out when the watermark has passed it, so that a consent from before it that comes later still counts. Of consents of a
    key at the same time the one with the larger event_id, and at the same time a consent before an event."""
    rows = _prepared(events, key, lateness, shares, "granted")
    found = rows.groupBy("share").transformWithStateInPandas(InOrder(), "who string, event_id long", "append", "eventTime")
    return _finished(found, key, events, _id())


def unsuppressed_stream(events: DataFrame, navigations: DataFrame, key: str, seconds: float = 8.0, lateness: str = "10 minutes") -> DataFrame:
    """unsuppressed() on two streams, (key, ts, event_id) and (key, ts): a join by intervals, which keeps of either side only
    what the watermark still allows to meet. An event goes out when no navigation in the seconds up to it can come any more."""
    e = events.select(key, "ts", "event_id").withWatermark("ts", lateness)
    n = navigations.select(F.col(key).alias("_key"), F.col("ts").alias("_at")).withWatermark("_at", lateness)
    near = (F.col(key) == F.col("_key")) & (F.col("_at") <= F.col("ts")) & (F.col("_at") > F.col("ts") - F.expr(f"interval {seconds} seconds"))
    return e.join(n, near, "leftOuter").where("_at is null").select(key, "event_id")
