"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; per source, the bucket at which the running sum meets the
budget is the boundary, and only its documents are summed again by the next bits of the hash. After
the last level every document below its source's threshold is in: a filter, without sorting documents.
A larger budget gives a threshold that is no lower, so mixes are nested.

Targets: sources, by code point with null last, weigh 5, 2, 1, repeating, and share a given part of
all sizes; a target stops at ``cap`` times its source's size, and the excess is shared again by weight.
A source whose target exceeds its size takes every document once, and the rest of the target a second time.

Null text has size 0 and is taken 0 times; a null source is a source. The hash is that of doc_id and
text, so reruns agree. Repeated rows share one hash: where they are the boundary, as many of them are in as come nearest
to the budget; which of them doesn't matter, as they are equal, and they are counted off in SLOTS groups, not in one task.
Hot sources are summed before the shuffle; the tables by source or by bucket are aggregates of at most sources times 1024 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexspan.llm.common import discard, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
LEVELS = (10, 10, 10, 30)  # bits of the hash; by the last level a bucket has a handful of documents, so its hashes are few
BITS = sum(LEVELS)
SLOTS = 4096


def word_count(text: str) -> Column:
    """Runs of characters other than ASCII white space."""
    norm = F.btrim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source."""
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row a source; without a source of size 0 no division by 0 can occur
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")))
    most = F.col("source_size") * F.lit(float(cap))
    by_ratio = W.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    so_far = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, W.unboundedFollowing)
    level = ((F.lit(float(share)) * F.sum("source_size").over(W.partitionBy())) - F.coalesce(F.sum("most").over(so_far), F.lit(0.0))) / F.sum("weight").over(from_here)
    each = each.withColumn("most", most).withColumn("level", level)
    # the first source, by most / weight, that its share doesn't fill sets the level for itself and all after
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    settled = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow))
    return each.select("source", "source_size", F.when(settled.isNull(), F.col("most")).otherwise(F.least("most", settled * F.col("weight"))).alias("target"))


def mix(df: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, text: str = "text") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of ``df``; taken is words, repeats counted."""
    sized = staged(df.select("doc_id", "source", word_count(text).alias("size"), _hash(F.col("doc_id"), F.col(text)).alias("h")), "sized")
    each = thresholds(sized, share, cap, weights)
    met = _met(sized.withColumnRenamed("source", "of"), each)
    return met.select("doc_id", F.col("of").alias("source"), "size", "source_size", "target", (F.col("size") * (F.col("times") + F.col("more"))).alias("taken"))


def _hash(doc_id: Column, text: Column) -> Column:
    of = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(of), 1, BITS // 4), 16, 10).cast("long")


def thresholds(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, times, budget, edge, some, copies) from (source, size, h): every document ``times``, and once more
    if h < edge, or if it is one of the first ``some`` of the ``copies`` rows whose h is ``edge``."""
    each = targets(sized, share, cap, weights)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    none = F.lit(0).cast("long")
    each = each.withColumn("times", times).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    old: list[str] = []
    each = staged(each.select("*", none.alias("edge"), none.alias("some"), none.alias("copies")), "targets", old)
    for depth in range(1, len(LEVELS) + 1):
        new: list[str] = []
        each = staged(_refine(sized, each, depth), "edges", new)
        discard(sized.sparkSession, old)
        old = new
    return each


def repeated(df: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, text: str = "text") -> DataFrame:
    """The rows of ``df`` as often as the mix takes each, with its own columns only: the filter that the thresholds make, without a shuffle of texts."""
    made: list[str] = []
    measured = df.select("source", word_count(text).alias("size"), _hash(F.col("doc_id"), F.col(text)).alias("h"))
    each = thresholds(staged(measured, "sized", made), share, cap, weights)
    discard(df.sparkSession, made)
    # the rows as one column, so that no name of theirs can clash
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col("source").alias("of"), word_count(text).alias("size"), _hash(F.col("doc_id"), F.col(text)).alias("h")])
    taken = F.when(F.col("size") > 0, F.col("times") + F.col("more")).otherwise(0).cast("int")
    return _met(rows, each).withColumn("taken", taken).filter("taken > 0").select("row", F.explode(F.sequence(F.lit(1), "taken")).alias("nth")).select("row.*")


def _met(rows: DataFrame, each: DataFrame) -> DataFrame:
    """Rows (of, h, ..) with their source's numbers and ``more``: 1 for those that are taken once more, else 0."""
    met = rows.join(each, F.col("of").eqNullSafe(F.col("source")))
    more = F.when(F.col("h") < F.col("edge"), 1).otherwise(0)
    divided = (F.col("some") > 0) & (F.col("some") < F.col("copies"))
    if each.filter(divided).isEmpty():
        return met.withColumn("more", more)
    tied = divided & (F.col("h") == F.col("edge"))
    # written, so that a row keeps its number whatever is computed again
    at = staged(met.filter(tied).withColumn("slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SLOTS)).cast("int")), "tied")
    sums = at.groupBy(F.col("of").alias("o"), F.col("slot").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("o").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(W.partitionBy("of", "slot").orderBy("h")) + F.col("before")
    counted = at.join(before, F.col("of").eqNullSafe(F.col("o")) & (F.col("slot") == F.col("s"))).withColumn("more", F.when(nth <= F.col("some"), 1).otherwise(0))
    return met.filter(~tied).withColumn("more", more).unionByName(counted.drop("slot", "o", "s", "n", "before"))


def _refine(sized: DataFrame, each: DataFrame, depth: int) -> DataFrame:
    """Thresholds with the next level's bits: ``edge`` is a hash of ``depth`` levels, all below it is in and within ``budget``."""
    bits, shift = LEVELS[depth - 1], sum(LEVELS[depth:])
    e = each.select(F.col("source").alias("of"), "edge", "budget")
    part = sized.join(e, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift + bits) == F.col("edge")) & (F.col("budget") > 0))
    sums = part.groupBy("of", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    w = W.partitionBy("of").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(w))
    # the first bucket that the budget can't hold; there is one, as a source's size exceeds its budget
    over = sums.filter(F.col("upto") > F.col("budget")).groupBy("of").agg(F.min_by(F.struct("bucket", "n", "upto", "rows"), "bucket").alias("b"))
    new = each.join(over, F.col("source").eqNullSafe(F.col("of")), "left")
    left = F.col("budget") - (F.col("b.upto") - F.col("b.n"))
    edge, some, copies = F.coalesce(F.col("b.bucket"), F.shiftleft("edge", bits)), F.col("some"), F.col("copies")
    if not shift:  # no finer: of the boundary's rows, which are equal, as many as come nearest
        some = F.coalesce(F.floor(left * F.col("b.rows") / F.col("b.n") + 0.5).cast("long"), some)
        copies = F.coalesce(F.col("b.rows"), copies)
        edge = edge + F.when((copies > 0) & (some == copies), 1).otherwise(0)
    return new.select("source", "source_size", "target", "times", F.coalesce(left, "budget").alias("budget"), edge.alias("edge"), some.alias("some"), copies.alias("copies"))


def oracle() -> str:
    """The same in DuckDB, with a running sum over all hashes in place of the levels."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * CAST({CAP} AS DOUBLE) AS most FROM by_source),
levels AS (SELECT *, (CAST({SHARE} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / CAST(sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
settled AS (SELECT *, first_value(CASE WHEN level * weight <= most THEN level END IGNORE NULLS) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lvl FROM levels),
targets AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN most ELSE least(most, lvl * weight) END AS target FROM settled),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times, target - times * source_size AS budget FROM targets),
hashes AS (SELECT source, h, sum(size) AS n, count(*) AS copies FROM sized GROUP BY source, h),
running AS (SELECT s.source, h, n, copies, budget, sum(n) OVER (PARTITION BY s.source ORDER BY h) AS upto FROM hashes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source WHERE budget > 0),
edges AS (SELECT source, min(h) AS h, min_by(upto, h) AS upto, min_by(n, h) AS n, min_by(copies, h) AS copies, any_value(budget) AS budget FROM running WHERE upto > budget GROUP BY source),
cuts AS (SELECT source, h AS edge, floor((budget - (upto - n)) * copies / n + 0.5) AS more FROM edges)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN h < edge OR (h = edge AND row_number() OVER (PARTITION BY s.source, h) <= more) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source"""
