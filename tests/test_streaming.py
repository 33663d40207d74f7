import random
import time

import pandas as pd
import pytest

from lexspan.operators import feedback
from lexspan.streaming import feed


def run(spark, df, name, checkpoint=None):
    w = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name).collect()


@pytest.fixture
def no_empty_batches(spark):
    """A stream with processing-time timers always has one more batch to run; for a test it ends with its data."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


FEED = "job_id string, seq long, kind string, item_id string, state string"


def fed(spark, tmp_path, batches, **options):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").json(path, ignoreNullFields=False)
        time.sleep(0.1)  # files go by their times
    stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).json(path)
    return [tuple(r) for r in run(spark, feed.change_feed(stream, **options), f"feed_{tmp_path.name.replace('-', '_')}")]


def test_change_feed(spark, tmp_path, no_empty_batches):
    """Each kind of event, over several batches and two jobs."""
    got = fed(
        spark,
        tmp_path,
        [
            [("j", 3, "annotation", "a", "preliminary"), ("j", 2, "annotation", "b", "confirmed"), ("j", 1, "status", "status", "matching"), ("k", 1, "individual", "i", "x"), ("j", 4, "activity", "0", "read")],
            [("j", 5, "annotation", "a", "confirmed"), ("j", 6, "annotation", "b", None), ("j", 7, "annotation", "b", None), ("j", 8, "document_type", "Lease", "0.8"), ("j", 9, "document_type", "Deed", "0.9"), ("j", 10, "activity", "0", "read"), ("j", 11, "activity", "1", "matched"), ("k", 2, "individual", "i", "y"), ("k", 3, "pos", "", "[]")],
            [("j", 12, "annotation", "a", "confirmed"), ("j", 13, "triple", "t", "x"), ("j", 14, "property", "p", "x"), ("j", 15, "document_type", "Deed", "0.9"), ("j", 16, "status", "status", "completed"), ("k", 4, "pos", "", "[]")],
            [("j", 17, "annotation", "a", "preliminary"), ("k", 5, "status", "status", "failed")],
        ],
    )
    of = lambda j: [x[1:] for x in got if x[0] == j]
    assert of("j") == [
        ("status", "status", "matching"),
        ("annotation", "b", "confirmed"),
        ("preliminary_annotation", "a", "preliminary"),
        ("activity", "0", "read"),
        ("annotation_update", "a", "confirmed"),
        ("annotation_removed", "b", None),
        ("document_type", "Lease", "0.8"),
        ("activity", "1", "matched"),
        ("triple_added", "t", "x"),
        ("property_added", "p", "x"),
        ("status", "status", "completed"),
        ("complete", "completed", "annotation=1,individual=0,property=1,triple=1"),
        ("preliminary_annotation", "a", "preliminary"),  # a job that has ended begins anew
    ]
    assert of("k") == [("individual_added", "i", "x"), ("pos_ready", "", "[]"), ("status", "status", "failed"), ("complete", "failed", "annotation=0,individual=1,property=0,triple=0")]


def test_change_feed_expires(spark, tmp_path, no_empty_batches):
    """A job left alone is told of once and forgotten."""
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    add = lambda *rows: spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").json(path)
    add(("j", 1, "annotation", "a", "new"))
    collected = []

    def more(name):
        def each(df, _):
            collected.extend(tuple(r) for r in df.collect())

        q = feed.change_feed(spark.readStream.schema(FEED).json(path), idle_ms=500).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination(240)

    more("first")
    time.sleep(1)
    add(("k", 1, "annotation", "b", "new"))
    more("second")
    assert ("j", "annotation", "a", "new") in collected and ("j", "expired", None, None) in collected and ("k", "annotation", "b", "new") in collected
    add(("j", 2, "annotation", "a", "new"))
    more("third")
    assert collected.count(("j", "annotation", "a", "new")) == 2


def limited(spark, tmp_path, batches, limit, seconds, late):
    path = str(tmp_path / "in")
    schema = "event_id long, key string, ts timestamp"
    for rows in batches:
        at = [(i, k, (pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=ms)).to_pydatetime()) for i, k, ms in rows]
        spark.createDataFrame(at, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run(spark, feed.rate_limited(stream, limit, seconds, late), f"limited_{tmp_path.name.replace('-', '_')}")
    batch = spark.read.schema(schema).parquet(path)
    want = feedback.accepted(batch, limit, seconds).collect()
    return sorted((r["event_id"], r["key"], r["accepted"]) for r in got), sorted((r["event_id"], r["key"], r["accepted"]) for r in want)


def test_rate_limited(spark, tmp_path):
    """Events out of order and in many batches are judged as in one."""
    rng = random.Random(3)
    rows = [(i, f"k{rng.randint(0, 2)}", rng.randint(0, 60_000)) for i in range(120)]
    rows += [(1000 + i, "k0", 30_000) for i in range(5)]  # ties go by event_id
    rows.sort(key=lambda r: r[2] + rng.randint(0, 15_000))  # late, but within the watermark's reach
    batches = [rows[i : i + 45] for i in range(0, len(rows), 45)]
    far = [(10_000 + i, f"k{i}", 10_000_000 + i) for i in range(3)]
    got, want = limited(spark, tmp_path, [*batches, far, [(20_000, "end", 20_000_000)]], 4, 5, "1 minute")
    done = {e for e, _, _ in got}
    assert {e for e, _, _ in want} - done == {20_000}  # what the watermark hasn't passed still waits
    assert got == [w for w in want if w[0] in done]
    assert {ok for _, _, ok in got} == {True, False}


def test_rate_limited_too_late(spark, tmp_path):
    got, _ = limited(spark, tmp_path, [[(1, "k", 0), (2, "k", 100_000)], [(3, "k", 200_000)], [(4, "k", 1_000)], [(5, "k", 900_000)], [(6, "k", 1_800_000)]], 1, 60, "10 seconds")
    assert [x for x in got if x[0] == 4] == [] and {x[0] for x in got} >= {1, 2, 3, 5}


def test_windowed_counts(spark, tmp_path):
    """Windows that the watermark has passed come out; a row later than it allows isn't counted."""
    path, schema = str(tmp_path / "in"), "event_id long, event_type string, value double, ts timestamp"
    at = lambda h, m: pd.Timestamp(2024, 1, 1, h, m).to_pydatetime()
    for rows in ([(1, "a", 1.0, at(0, 5)), (2, "a", 2.0, at(0, 50))], [(3, "a", 4.0, at(3, 0))], [(6, "c", 1.0, at(3, 1))], [(4, "a", 8.0, at(0, 10)), (5, "b", 1.0, at(9, 0))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r["start"].hour, r["event_type"]): (r["n"], r["total"]) for r in run(spark, feed.windowed_counts(stream), "windowed")}
    assert got[0, "a"] == (2, 3.0) and got[3, "a"] == (1, 4.0) and (9, "b") not in got
