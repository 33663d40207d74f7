"""Queries against SQL on tables that have what the small ones lack: hubs, repeated ids."""

import random

import duckdb
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from lexspan.operators import overlap
from lexspan.plans import concept_queries, stage_queries, stages  # noqa: F401
from lexspan.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture
def tables(sf, tmp_path):
    """A folder of the tables, where some are replaced by SQL over the given ones."""

    def made(**queries):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
            con.execute(f"COPY ({queries.get(t, f'SELECT * FROM {t}')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        return str(tmp_path)

    return made


@pytest.mark.parametrize("name", ["graph_nodes", "graph_edges"])
def test_graphs_of_many_nodes_are_whole(spark, tables, name):
    folder = tables(supplier="SELECT * REPLACE (CAST(s_suppkey + i * 1000 AS BIGINT) AS s_suppkey, CAST(s_nationkey % 3 AS INT) AS s_nationkey) FROM supplier, range(30) r(i)")
    con = connect(folder)
    assert con.execute(f"SELECT max(n) FROM (SELECT count(*) AS n FROM ({ORACLE_SQL['graph_nodes']}) GROUP BY start)").fetchall()[0][0] > 200
    assert_same(spark, con, folder, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("ascending", [True, False])
def test_annotations_whose_ids_repeat_are_told_apart(spark, sf, monkeypatch, ascending):
    """Of lines of one order, number and span but of several parts the least part counts, in whatever order they are read."""
    plain, seen = stage_queries.b.annotations, []
    more = lambda spark, sf: plain(spark, sf).select("doc_id", "ann_id", "start", "end", F.explode(F.array(*[F.concat("text", F.lit(f" {i}")) for i in range(3)])).alias("text")).withColumn("iri", F.col("text")).coalesce(1).sortWithinPartitions("text", ascending=ascending)
    monkeypatch.setattr(stage_queries.b, "annotations", more)
    monkeypatch.setattr(stage_queries.ann, "attach", lambda matches, single: seen.append(single) or matches.select("doc_id", "start", "end", F.lit("").alias("ann_id"), F.lit(True).alias("created")))
    QUERIES["attached_matches"](spark, sf)
    want = more(spark, sf).groupBy("doc_id", "start", "end").agg(F.min(F.struct("ann_id", "text", "iri")).alias("x")).select("doc_id", "start", "end", "x.text")
    assert sorted(map(tuple, seen[0].select("doc_id", "start", "end", "text").collect())) == sorted(map(tuple, want.collect()))


def test_absorbed_spans_of_many_groups(spark, capsys):
    """Against the rule said plainly; groups go to Python by the batch, not one by one."""
    rng = random.Random(4)
    schema = "doc_id long, ann_id string, start int, end int, iri string, confidence double, state string, lineage array<string>"
    rows = []
    for i in range(3000):
        start = rng.randrange(60)
        rows.append((rng.choice([None, *range(40)]), f"a{i}", start, start + rng.choice([0, 1, 3, 3, 9, 20]), rng.choice(["u", "v", "", None]), rng.choice([0.125, 0.5]), rng.choice(["rejected", "made", "made"]), rng.choice([None, ["x"]])))
    want, groups = [], {}
    for r in rows:
        if r[6] == "rejected" or not r[4]:
            want.append((*r[:7], tuple(r[7]) if r[7] else None))
        else:
            groups.setdefault((r[0], r[4]), []).append(list(r))
    for group in groups.values():
        kept = []
        for r in sorted(group, key=lambda r: (r[2] - r[3], -r[5], r[1])):
            into = next((k for k in kept if r[2] < k[3] and k[2] < r[3]), None)
            if into is None:
                kept.append(r)
            else:
                into[7] = [*(into[7] or []), *(r[7] or []), f"absorbed [{r[2]},{r[3]}] at {r[5]:.2f}"]
        want += [(*r[:7], tuple(r[7]) if r[7] else None) for r in kept]
    found = overlap.absorbed(spark.createDataFrame(rows, schema))
    assert sorted(map(repr, want)) == sorted(repr((*r[:7], tuple(r[7]) if r[7] else None)) for r in found.collect())
    capsys.readouterr()
    found.explain()
    assert "FlatMapGroupsInArrow" not in capsys.readouterr().out


def test_class_links_are_named_for_rows_that_repeat(spark):
    """Rows that are alike but for their links each keep their own."""
    rows = [(1, "a", 0, 1, ["Court", "Date"]), (1, "a", 0, 1, ["Person"]), (2, "b", 0, 1, None)]
    found = stages.linked(spark.createDataFrame(rows, "doc_id long, name string, start int, end int, links array<string>"), spark.createDataFrame([("court", "u:1"), ("PERSON", "u:2")], "label string, iri string"))
    got = sorted((r["doc_id"], [tuple(x) for x in r["links"] or []]) for r in found.collect())
    assert got == [(1, [("Court", "u:1"), ("Date", None)]), (1, [("Person", "u:2")]), (2, [])]


def test_rows_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    from lexspan.staging import TASK_ROWS, spread

    spark.range(40_000).selectExpr("id", "uuid() AS text").coalesce(1).write.parquet(str(tmp_path / "one"))  # one row group
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scan = spark.read.parquet(str(tmp_path / "one"))
        assert scan.rdd.getNumPartitions() > 4  # more splits than cores, all but one of them empty
        sizes = [r["count"] for r in spread(scan).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 40_000 and max(sizes) <= 11_000
        small = spark.range(0, 3 * TASK_ROWS * 4, 1, 2)
        assert spread(small).rdd.getNumPartitions() == 12
        assert spread(scan.limit(0)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
