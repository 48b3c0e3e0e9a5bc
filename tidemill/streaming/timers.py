"""Keyed state with event-time timers: orders that run out of time, and needs that add up over a session.

Both streams give the same rows as their batch twins below, however the events
are cut into batches and in whatever order they come, as long as none is later
than the watermark's delay: nothing is decided before the watermark has passed
the time that decides it.  They need the RocksDB state store
(`use_rocksdb`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOME = "order_id string, sku string, qty long, outcome string, at timestamp, released long"
NEED = "session string, start timestamp, last timestamp, needs map<string,string>, events long"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that timers ask for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _us(t) -> int:
    return pd.Timestamp(t).value // 1000


def _at(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _timer(us: int) -> int:
    """The first whole millisecond that is not before a time, as timers have it."""
    return -(-us // 1000)


class OrderTimer(StatefulProcessor):
    """One outcome an order, when its time to pay is over."""

    def __init__(self, ttl_s: int):
        self.ttl = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("order", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else {}
        for part in rows:
            for kind, at, event, sku, qty in zip(part["kind"], part["at"], part["event_id"], part["sku"], part["qty"]):
                new = [_us(at), int(event), kind, None if pd.isna(sku) else sku, 0 if pd.isna(qty) else int(qty)]
                what = "placed" if kind == "placed" else "end"
                if what not in held or new[:2] < held[what][:2]:
                    held[what] = new
        due = (held.get("placed") or held["end"])[0] + self.ttl
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # the watermark may stand behind the due time already: the next batch's check fires it then
        self.handle.registerTimer(_timer(due))
        self.state.update((json.dumps(held),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0])
        self.state.clear()
        placed, end = held.get("placed"), held.get("end")
        if placed is None:
            row = (key[0], None, 0, "unknown_order", _at(end[0]), 0)
        else:
            due = placed[0] + self.ttl
            in_time = end is not None and end[0] <= due
            outcome, at = (end[2], end[0]) if in_time else ("expired", due)
            row = (key[0], placed[3], placed[4], outcome, _at(at), 0 if outcome == "paid" else placed[4])
        yield pd.DataFrame([row], columns=["order_id", "sku", "qty", "outcome", "at", "released"])

    def close(self) -> None:
        pass


def order_timers(events: DataFrame, ttl_s: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """A stream of (order_id, event_id, at, kind, sku, qty) -> OUTCOME, once an order's time to pay is over.

    kind is `placed`, `paid` or `cancelled`.  The first placing counts and the
    first ending; one at or before the due time is the outcome, else the order is
    `expired` at that time.  Cancelled and expired orders release their stock.
    An ending without a placing within the same time is an `unknown_order`.
    Null order ids, times and kinds take no part.
    """
    e = events.where("order_id is not null and at is not null and kind is not null").select("order_id", "event_id", F.col("at").cast("timestamp").alias("at"), "kind", "sku", "qty")
    return e.withWatermark("at", delay).groupBy("order_id").transformWithStateInPandas(OrderTimer(ttl_s), OUTCOME, "Append", "EventTime")


def order_outcomes(events: DataFrame, ttl_s: int = 1800, until: Column | None = None) -> DataFrame:
    """The rows of order_timers in one batch; orders still within their time at `until` (the latest event) have none."""
    e = events.where("order_id is not null and at is not null and kind is not null").withColumn("at", F.col("at").cast("timestamp"))
    first = F.struct("at", "event_id")
    is_placed = F.col("kind") == "placed"
    g = e.groupBy("order_id").agg(F.min_by(F.struct("at", "sku", "qty"), F.when(is_placed, first)).alias("p"), F.min_by(F.struct("at", "kind"), F.when(~is_placed, first)).alias("x"))
    now = e.agg(F.max("at").alias("_now")) if until is None else e.sparkSession.range(1).select(until.alias("_now"))
    ttl = F.make_dt_interval(secs=F.lit(ttl_s))
    due = F.coalesce(F.col("p.at"), F.col("x.at")) + ttl
    g = g.withColumn("_due", due).join(F.broadcast(now), F.col("_due") <= F.col("_now"))  # one row
    qty = F.coalesce(F.col("p.qty").cast("long"), F.lit(0).cast("long"))
    outcome = F.when(F.col("p").isNull(), "unknown_order").when(F.col("x.at") <= F.col("_due"), F.col("x.kind")).otherwise("expired")
    at = F.when(outcome == "expired", F.col("_due")).otherwise(F.col("x.at"))
    return g.select("order_id", F.col("p.sku").alias("sku"), qty.alias("qty"), outcome.alias("outcome"), at.alias("at"), F.when(outcome.isin("paid", "unknown_order"), F.lit(0).cast("long")).otherwise(qty).alias("released"))


class NeedTimer(StatefulProcessor):
    """Sessions of a key that are still open; each is given out when it has been silent for `gap`."""

    def __init__(self, gap_s: int):
        self.gap = gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "sessions string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else []
        for part in rows:
            for at, event, field, value in zip(part["at"], part["event_id"], part["field"], part["value"]):
                known = {} if field is None or value is None else {field: [_us(at), int(event), value]}
                held.append({"start": _us(at), "last": _us(at), "n": 1, "needs": known})
        held.sort(key=lambda s: s["start"])
        joined: list[dict] = []
        for s in held:
            if joined and s["start"] <= joined[-1]["last"] + self.gap:
                into = joined[-1]
                into["last"] = max(into["last"], s["last"])
                into["n"] += s["n"]
                for f, v in s["needs"].items():
                    if f not in into["needs"] or v[:2] > into["needs"][f][:2]:
                        into["needs"][f] = v
            else:
                joined.append(s)
        self._keep(joined)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else []
        now = timerValues.getCurrentWatermarkInMs() * 1000
        over = [s for s in held if s["last"] + self.gap < now]
        self._keep([s for s in held if s["last"] + self.gap >= now])
        rows = [(key[0], _at(s["start"]), _at(s["last"]), {f: v[2] for f, v in sorted(s["needs"].items())}, s["n"]) for s in over]
        if rows:
            yield pd.DataFrame(rows, columns=["session", "start", "last", "needs", "events"])

    def _keep(self, sessions: list[dict]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if sessions:
            self.state.update((json.dumps(sessions),))
            for s in sessions:
                self.handle.registerTimer(_timer(s["last"] + self.gap) + 1)
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def need_sessions(events: DataFrame, gap_s: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """A stream of (session, event_id, at, field, value) -> NEED: what a customer said they need, once they fell silent.

    Events of a key no more than `gap_s` apart are one session; of a field the
    latest value counts (ties: the greater event_id), null fields and values
    count as events only.  Null sessions and times take no part.
    """
    e = events.where("session is not null and at is not null").select("session", "event_id", F.col("at").cast("timestamp").alias("at"), "field", "value")
    return e.withWatermark("at", delay).groupBy("session").transformWithStateInPandas(NeedTimer(gap_s), NEED, "Append", "EventTime")


def needs_by_session(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """The rows of need_sessions in one batch, open sessions too."""
    from pyspark.sql import Window

    e = events.where("session is not null and at is not null").withColumn("at", F.col("at").cast("timestamp"))
    w = Window.partitionBy("session").orderBy("at", "event_id")
    new = F.coalesce((F.unix_micros("at") - F.unix_micros(F.lag("at").over(w)) > gap_s * 1_000_000).cast("int"), F.lit(1))
    s = e.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    spans = s.groupBy("session", "_s").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.count("*").alias("events"))
    last = s.where("field is not null and value is not null").groupBy("session", "_s", "field").agg(F.max_by("value", F.struct("at", "event_id")).alias("value"))
    needs = last.groupBy("session", "_s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("needs"))  # an entry a field
    none = F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))")
    return spans.join(needs, ["session", "_s"], "left").select("session", "start", "last", F.coalesce("needs", none).alias("needs"), "events")
