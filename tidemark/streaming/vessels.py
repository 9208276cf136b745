"""Vessel snapshots of a stream: per-vessel state that ends by itself.

A snapshot gathers the last known state of every vessel it hears of. It ends
when none new came for a while, or at a hard bound. The clock is the messages'
own time, so a replay gives what the first run gave.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class StopRule:
    """Seconds: a snapshot ends ``stable`` after its last new vessel but not before ``least``, and ``hard`` after its start at the latest."""

    least: float
    stable: float
    hard: float


VESSEL = "snapshot string, mmsi long, first_seen timestamp, last_seen timestamp, last_message_type string, sog double, messages long"
_UTC = "UTC"


class SnapshotProcessor(StatefulProcessor):
    """State of one snapshot: its clock, and what is known of each vessel.

    The clock is ``(started, last_new, now, timer)`` in milliseconds; after the
    end a mark stays for ``keep`` seconds, so stragglers do not begin it anew.
    """

    def __init__(self, rule: StopRule, keep: float = 3600.0):
        self.rule, self.keep = rule, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "started long, last_new long, now long, timer long")
        self.ended = handle.getValueState("ended", "at long")
        self.vessels = handle.getMapState("vessels", "mmsi long", "first_seen long, last_seen long, last_message_type string, sog double, messages long")

    def _end(self, started: int, last_new: int) -> int:
        r = self.rule
        return min(started + int(r.hard * 1000), max(started + int(r.least * 1000), last_new + int(r.stable * 1000)))

    def handleInputRows(self, key, rows, timerValues):
        if self.ended.exists():
            for _ in rows:
                pass
            return
        started = last_new = now = timer = None
        if self.clock.exists():
            started, last_new, now, timer = self.clock.get()
        # of a batch in order of time; what an earlier batch overtook counts as come now
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        over = False
        for at, mmsi, kind, sog in zip(frame["at"], frame["mmsi"], frame["message_type"], frame["sog"]):
            ms = max(at.value // 1_000_000, now if now is not None else -(1 << 62))
            if started is None:
                started = last_new = ms
            if ms >= self._end(started, last_new):
                over = True
                break
            now = ms
            who = (int(mmsi),)
            old = self.vessels.getValue(who) if self.vessels.containsKey(who) else None
            if old is None:
                last_new = ms
            known = None if pd.isna(sog) else float(sog)
            self.vessels.updateValue(who, (old[0] if old else ms, ms, kind, known if known is not None else (old[3] if old else None), (old[4] if old else 0) + 1))
        end = self._end(started, last_new)
        if timer is not None and (over or timer != end):
            self.handle.deleteTimer(timer)
        if over:
            yield from self._close(key, end)
            return
        if timer != end:
            self.handle.registerTimer(end)
        self.clock.update((started, last_new, now, end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.ended.exists():
            self.ended.clear()
            return
        started, last_new, _, _ = self.clock.get()
        yield from self._close(key, self._end(started, last_new))

    def _close(self, key, end):
        rows = sorted((who[0], *v) for who, v in self.vessels.iterator())
        self.vessels.clear()
        self.clock.clear()
        self.ended.update((end,))
        self.handle.registerTimer(end + int(self.keep * 1000))
        if rows:
            frame = pd.DataFrame(rows, columns=["mmsi", "first_seen", "last_seen", "last_message_type", "sog", "messages"])
            for c in ("first_seen", "last_seen"):
                frame[c] = pd.to_datetime(frame[c], unit="ms", utc=True)
            frame.insert(0, "snapshot", key[0])
            frame["sog"] = frame["sog"].astype(float)
            yield frame

    def close(self) -> None:
        pass


def snapshot_stream(messages: DataFrame, rule: StopRule, late: str = "0 seconds") -> DataFrame:
    """VESSEL rows of each snapshot once it has ended. ``messages``, a stream: snapshot, mmsi, at (timestamp), event_id, message_type, sog.

    The session must use the RocksDB state store. Messages older than the
    watermark are dropped; without any later message a snapshot stays open.
    """
    chosen = messages.filter("mmsi IS NOT NULL AND at IS NOT NULL").select("snapshot", "mmsi", "at", "event_id", "message_type", "sog").withWatermark("at", late)
    return chosen.groupBy("snapshot").transformWithStateInPandas(SnapshotProcessor(rule), VESSEL, "Append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def snapshot_ends(messages: DataFrame, rule: StopRule) -> DataFrame:
    """``(snapshot, started, ends)`` of messages at rest, times in ``at``.

    Only each vessel's first message counts, and of those only such as come
    before the hard bound, so a window holds few narrow rows.
    """
    seconds = lambda s: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(s)).cast("decimal(18,6)"))
    firsts = messages.groupBy("snapshot", "mmsi").agg(F.min("at").alias("seen"))
    begun = firsts.groupBy("snapshot").agg(F.min("seen").alias("started"))
    near = firsts.join(begun, "snapshot").filter(F.col("seen") < F.col("started") + seconds(rule.hard))
    order = Window.partitionBy("snapshot").orderBy("seen", "mmsi")
    calm = F.greatest(F.col("started") + seconds(rule.least), F.col("seen") + seconds(rule.stable))
    following = F.lead("seen").over(order)
    quiet = near.withColumns({"calm": calm, "following": following}).filter(F.col("following").isNull() | (F.col("following") >= F.col("calm")))
    first = quiet.groupBy("snapshot", "started").agg(F.min("calm").alias("calm"))
    return first.select("snapshot", "started", F.least("calm", F.col("started") + seconds(rule.hard)).alias("ends"))


def snapshots(messages: DataFrame, rule: StopRule) -> DataFrame:
    """What ``snapshot_stream`` gives once all its snapshots have ended, of messages at rest; times as given."""
    known = messages.filter("mmsi IS NOT NULL AND at IS NOT NULL")
    within = known.join(snapshot_ends(known, rule), "snapshot").filter(F.col("at") < F.col("ends"))
    order: Column = F.struct("at", "event_id")
    return within.groupBy("snapshot", "mmsi").agg(
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("message_type", order).alias("last_message_type"),
        F.max_by("sog", F.when(F.col("sog").isNotNull(), order)).alias("sog"), F.count("*").alias("messages"),
    )
