"""Feedback and jobs: counts, tops, snapshots compared, retention, and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def totals(f: DataFrame) -> DataFrame:
    """One row: entries, and those rated up, down and dismissed."""
    return f.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("rating") == r).alias(f"n_{r}") for r in ("up", "down", "dismissed")])


def by_stage(f: DataFrame) -> DataFrame:
    """Counts of ratings up and down by stage; without a stage, overall."""
    return f.groupBy(F.coalesce("stage", F.lit("overall")).alias("stage")).agg(F.count_if(F.col("rating") == "up").alias("n_up"), F.count_if(F.col("rating") == "down").alias("n_down"))


def most_rated(f: DataFrame, rating: str, top: int = 10) -> DataFrame:
    """Labels with the most of a rating, with the last iri seen; a report of ``top`` rows."""
    each = f.filter(F.col("rating") == rating).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max_by("iri", F.struct("created_at", "id")).alias("iri"))
    return each.orderBy(F.col("n").desc(), "label").limit(top)


def recent(f: DataFrame, top: int = 20) -> DataFrame:
    return f.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(top)


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, state: str) -> DataFrame:
    """(key, change): added, removed or updated rows between two snapshots."""
    a, b = before.select(key, F.col(state).alias("old"), F.lit(1).alias("was")), after.select(key, F.col(state).alias("new"), F.lit(1).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return a.join(b, key, "full").withColumn("change", change).filter("change IS NOT NULL").select(key, "change", "old", "new")


def accepted(events: DataFrame, limit: int = 200, seconds: int = 60) -> DataFrame:
    """Events (event_id, key, ts) with whether a sliding window of accepted ones lets them in; a rejected event doesn't count.

    The state of a key is the times of its accepted events within the window, at most ``limit``; rows stream through in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for pdf in batches:
            out = []
            for e, k, t in zip(pdf["event_id"], pdf["key"], pdf["us"], strict=True):
                if k != key:
                    key, times = k, []
                while times and times[0] <= t - seconds * 1_000_000:
                    times.pop(0)
                ok = len(times) < limit
                if ok:
                    times.append(t)
                out.append(ok)
            yield pdf[["event_id", "key"]].assign(accepted=out)

    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("event_id", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("key").sortWithinPartitions("key", "us", "event_id")
    return rows.mapInPandas(run, f"event_id long, key {kind}, accepted boolean")


def in_window(events: DataFrame, seconds: int) -> DataFrame:
    """Events with how many of their key there were in the last ``seconds``, themselves included."""
    w = W.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("n_window", F.count(F.lit(1)).over(w))


def stale(jobs: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Jobs that are under way and haven't changed for ``minutes``."""
    return jobs.filter(~F.col("status").isin("completed", "failed") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")))


def expired(jobs: DataFrame, now: str, days: int = 30) -> DataFrame:
    return jobs.filter(F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def by_job(f: DataFrame, job_id: int) -> DataFrame:
    return f.filter(F.col("job_id") == job_id)


def by_annotation(f: DataFrame, keys: DataFrame) -> DataFrame:
    """The newest entry of each annotation (job_id, ann_id) that is asked for."""
    w = W.partitionBy("job_id", "ann_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return f.join(keys.select("job_id", "ann_id").distinct(), ["job_id", "ann_id"], "left_semi").withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


#: The states of a job, in order; the last two end it.
STATES = ["pending", "ingesting", "normalizing", "enriching", "identifying", "resolving", "matching", "judging", "extracting_individuals", "extracting_properties", "exporting", "completed", "failed"]


def transitions(log: DataFrame) -> DataFrame:
    """(job_id, ts, status, before, forward) of a log (job_id, ts, status): a row where a job's status changes, and whether it went on.

    A job may fail at any time; nothing follows an end.
    """
    w = W.partitionBy("job_id").orderBy("ts", "status")
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in STATES]), c)
    rows = log.select("job_id", "ts", "status", F.lag("status").over(w).alias("before"))
    changed = rows.filter(~F.col("status").eqNullSafe(F.col("before")))
    on = F.when(F.col("before").isNull(), True).when(F.col("before").isin("completed", "failed"), False).otherwise((place(F.col("status")) > place(F.col("before"))))
    return changed.withColumn("forward", on)


def logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """An activity log (job_id, ts, stage, message) with more entries, each once, in order of time within a job."""
    return log.unionByName(new).distinct()


def stage_summary(annotations: DataFrame) -> DataFrame:
    """One row: matches by label type, and annotations by state."""
    return annotations.agg(F.count_if(F.col("label_type") == "preferred").alias("n_preferred"), F.count_if(F.col("label_type") == "alternative").alias("n_alternative"), F.count_if(F.col("state") == "confirmed").alias("n_confirmed"), F.count_if(F.col("state") == "rejected").alias("n_rejected"))
