"""Streams run over whole tables, replayed in slices of time, each with the SQL of what they must come to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import scratch
from ..sources import tables as T
from ..streaming import replay, stateful
from . import oracle, reading
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)

#: The reader of the row that closes a replayed table.
NOBODY = -1


def _closed(events: DataFrame, root: str, ahead: float, **values) -> DataFrame:
    """The replayed events, and one of nobody behind them: at the last time and ``ahead`` times the delay."""
    stream, last = replay.replayed(events, root), events.agg(F.max("ts")).first()[0]
    delay = int(replay.lateness(events).split()[0])
    if last is not None:
        row = {"user_id": NOBODY, "ts": last + dt.timedelta(seconds=delay * ahead), "event_id": -1} | values
        replay.closed(events.sparkSession, events.schema, root, tuple(row.get(c) for c in events.columns))
    return stream


@query("""with k as (select user_id, count(*) filter (where event_type = 'purchase') as n, arg_max(event_type, (ts, event_id)) as last from events group by user_id)
  select user_id, n % 3 as part, n // 3 as runs, n > 0 and n % 3 = 0 and last = 'purchase' as finished, last = 'view' as stalled from k""")
def streamed_players(spark, d):
    """Where every player stands at the end, and which ones still wait for a play to begin."""
    e, root = T.reader_events(spark, d), scratch(spark)
    kind = F.when(F.col("event_type") == "purchase", "ended").when(F.col("event_type") == "view", "play").otherwise(F.col("event_type"))
    e = e.select("user_id", "ts", "event_id", kind.alias("kind"))
    stream = _closed(e, f"{root}/in", 9.0, kind="ended")
    out = replay.drained(stateful.playback_stream(stream, "user_id", 3, 3600.0, replay.lateness(e), shares=replay.shares(e)), root, "update")
    newest = out.groupBy("user_id").agg(F.max(F.struct("events", "stalled", "part", "runs", "finished")).alias("s"))
    return newest.where(F.col("user_id") != NOBODY).select("user_id", "s.part", "s.runs", "s.finished", "s.stalled")


@query("""with e as (select * from events where event_type = 'view'), n as (select max(ts) as n from e), r as (select user_id, max(ts) as t, arg_max(value, (ts, event_id)) as value from e group by user_id)
  select user_id, round(value, 4) as value from r, n where t >= n - interval 1 day""")
def streamed_expiry(spark, d):
    """The values that are left when the watermark has come to the last event, a day being their time."""
    e, root = T.reader_events(spark, d).where("event_type = 'view'").select("user_id", "ts", "event_id", "value"), scratch(spark)
    stream = _closed(e, f"{root}/in", 1.0, value=0.0)
    out = replay.drained(stateful.unexpired_stream(stream, "user_id", "value", 1, replay.lateness(e), shares=replay.shares(e)), root, "update")
    newest = out.groupBy("user_id").agg(F.max_by(F.struct("value", "live"), F.struct("ts", "event_id", ~F.col("live"))).alias("s"))
    return newest.where((F.col("user_id") != NOBODY) & F.col("s.live")).select("user_id", F.round("s.value", 4).alias("value"))


@query(oracle.ORACLE["consented_events"])
def streamed_consents(spark, d):
    """Events with consent, each looked at when no earlier consent can come any more."""
    e, root = T.reader_events(spark, d), scratch(spark)
    granted = F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False)
    e = e.where("event_type in ('signup', 'error', 'view', 'click')").select("user_id", "ts", "event_id", granted.alias("granted"))
    stream = _closed(e, f"{root}/in", 9.0)
    return replay.drained(stateful.consented_in_order(stream, "user_id", replay.lateness(e), replay.shares(e)), root, "append").where(F.col("user_id") != NOBODY).select("event_id")


@query(reading.ORACLE["unsuppressed_events"])
def streamed_suppression(spark, d):
    """Events without a navigation in the hour before, from two streams."""
    e, root = T.reader_events(spark, d), scratch(spark)
    views, clicks = (e.where(F.col("event_type") == k).select("user_id", "ts", "event_id") for k in ("view", "click"))
    late = max(replay.lateness(views), replay.lateness(clicks), key=lambda s: int(s.split()[0]))
    streams = [_closed(x, f"{root}/{k}", 9.0) for k, x in (("views", views), ("clicks", clicks))]
    return replay.drained(stateful.unsuppressed_stream(*streams, "user_id", 3600.0, late), root, "append").where(F.col("user_id") != NOBODY).select("event_id")
