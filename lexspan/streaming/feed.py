"""Structured Streaming: the change feed of jobs, accepted events under a rate limit, and windows of events.

The first two keep their state by key in the state store, entry by entry: a batch reads and writes the entries that its
rows touch, not a job's whole state. Both need the state store that keeps entries apart, which ``keyed_state`` sets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"

#: What a first and a later state of each kind of item is called; kinds that are sent once only; and states that end a job.
ADDED = {"individual": "individual_added", "property": "property_added", "triple": "triple_added"}
ONCE = {"document_type": "document_type", "pos": "pos_ready"}
ENDED = ("completed", "failed")


def keyed_state(spark: SparkSession) -> None:
    """State by entry, in RocksDB, for streams of this session."""
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Feed(StatefulProcessor):
    """A job's items as a map from (kind, item_id) to their state, the activities sent so far, and a timer for jobs that are left alone."""

    def __init__(self, idle_ms: int, ttl_ms: int | None) -> None:
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "kind string, item_id string", "state string", self.ttl_ms)
        self.sent = handle.getValueState("sent", "activities long, timer long")

    def _counts(self) -> str:
        n = dict.fromkeys(("annotation", *ADDED), 0)
        for kind, _ in self.items.keys():
            if kind in n:
                n[kind] += 1
        return ",".join(f"{k}={v}" for k, v in n.items())

    def _clear(self, timer: int) -> None:
        if timer:
            self.handle.deleteTimer(timer)
        self.items.clear()
        self.sent.clear()

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, ANN001, ANN201
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")  # one job's rows of one batch
        activities, timer = self.sent.get() if self.sent.exists() else (0, 0)
        out = []
        for kind, item, now in zip(pdf["kind"], pdf["item_id"], pdf["state"], strict=True):
            now = None if pd.isna(now) else now
            at = (kind, item)
            before = self.items.getValue(at)[0] if self.items.containsKey(at) else None
            if kind == "activity":
                if int(item) >= activities:
                    activities = int(item) + 1
                    out.append((key[0], "activity", item, now))
                continue
            if now is None:
                if before is not None and kind == "annotation":
                    self.items.removeKey(at)
                    out.append((key[0], "annotation_removed", item, None))
                continue
            if kind in ONCE:
                at = (kind, "")
                if self.items.containsKey(at):
                    continue
                out.append((key[0], ONCE[kind], item, now))
            elif kind in ADDED:
                if before is None:
                    out.append((key[0], ADDED[kind], item, now))
            elif kind == "annotation":
                if before is None:
                    out.append((key[0], "preliminary_annotation" if now == "preliminary" else "annotation", item, now))
                elif before != now:
                    out.append((key[0], "annotation_update", item, now))
            elif before != now:
                out.append((key[0], "status", item, now))
            if before != now:
                self.items.updateValue(at, (now,))
            if kind == "status" and now in ENDED:
                out.append((key[0], "complete", now, self._counts()))
                self._clear(timer)
                activities = timer = 0
        if activities or next(iter(self.items.keys()), None) is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
            self.sent.update((activities, timer))
        yield pd.DataFrame(out, columns=["job_id", "event", "item_id", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, ANN001, ANN201
        self._clear(0)
        yield pd.DataFrame([(key[0], "expired", None, None)], columns=["job_id", "event", "item_id", "state"])

    def close(self) -> None:
        pass


def change_feed(rows: DataFrame, idle_ms: int = 3_600_000, ttl_ms: int | None = None) -> DataFrame:
    """Events (job_id, event, item_id, state) of streamed rows (job_id, seq, kind, item_id, state), in the order of ``seq`` within a batch.

    Annotations come new, preliminary or not, change their state, or go with a null state; individuals, properties and triples come once;
    a document's type and its parts of speech are told once a job; activities, numbered from 0, are told from where the last batch
    ended; any other kind, ``status`` among them, is told when it changes. A status that ends a job is followed by ``complete`` with what
    the job has, and its state goes. A job without rows for ``idle_ms`` expires: that is told, and its state goes. With ``ttl_ms`` a single item is
    forgotten so long after it last changed.
    """
    keyed_state(rows.sparkSession)
    keyed = rows.select("job_id", F.col("seq").cast("long").alias("seq"), "kind", "item_id", "state").groupBy("job_id")
    return keyed.transformWithStateInPandas(_Feed(idle_ms, ttl_ms), "job_id string, event string, item_id string, state string", "append", "ProcessingTime")


class _Limit(StatefulProcessor):
    """Events of a key that wait for the watermark, and the times of those that were let in."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, event_id long", "n int")
        self.times = handle.getValueState("times", "us array<long>")
        self.timer = handle.getValueState("timer", "ms long")

    def _at(self, ms: int) -> None:
        """One timer a key: the next one takes the last one's place."""
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, ANN001, ANN201
        mark = timerValues.getCurrentWatermarkInMs()
        first = None
        for pdf in rows:
            for e, t in zip(pdf["event_id"], pdf["us"], strict=True):
                if t // 1000 < mark:  # too late for its place in the order
                    continue
                at = (int(t), int(e))
                n = self.waiting.getValue(at)[0] if self.waiting.containsKey(at) else 0
                self.waiting.updateValue(at, (n + 1,))
                first = int(t) if first is None else min(first, int(t))
        if first is not None:
            due = min(first, min(us for us, _ in self.waiting.keys()))
            self._at(due // 1000 + 1)
        yield pd.DataFrame([], columns=["event_id", "key", "accepted"]).astype({"event_id": "int64", "accepted": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, ANN001, ANN201
        self.timer.clear()
        mark = timerValues.getCurrentWatermarkInMs()
        times = list(self.times.get()[0]) if self.times.exists() else []
        waiting = sorted((int(us), int(e)) for us, e in self.waiting.keys())
        ready = [w for w in waiting if w[0] // 1000 < mark]
        out = []
        for us, e in ready:
            for _ in range(self.waiting.getValue((us, e))[0]):
                times = [x for x in times if x > us - self.window]
                ok = len(times) < self.limit
                if ok:
                    times.append(us)
                out.append((e, key[0], ok))
            self.waiting.removeKey((us, e))
        if len(ready) < len(waiting):
            self._at(waiting[len(ready)][0] // 1000 + 1)
            self.times.update((times,))
        elif times and (times[-1] + self.window) // 1000 >= mark:
            self._at((times[-1] + self.window) // 1000 + 1)  # only to free the key
            self.times.update((times,))
        else:
            self.times.clear()
        yield pd.DataFrame(out, columns=["event_id", "key", "accepted"]).astype({"event_id": "int64", "accepted": "bool"})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, limit: int = 200, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """Streamed events (event_id, key, ts) with whether a sliding window lets them in: what ``feedback.accepted`` says of the same rows, whatever batches they come in.

    Events wait until the watermark, ``late`` behind the newest, has passed them, and are then judged in the order of time and event_id. What comes
    later than that can't be placed any more and is left out. A key's state is its waiting events and at most ``limit`` times; it goes when the
    window has passed the last of these.
    """
    keyed_state(events.sparkSession)
    rows = events.select("event_id", F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Limit(limit, seconds), "event_id long, key string, accepted boolean", "append", "EventTime")


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events (event_type, value, ts) counted by event-time window; rows later than ``late`` behind the newest are left to the watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
