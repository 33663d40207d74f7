"""The life of annotations: concepts promoted, annotations rejected and restored, as columns of one table.

Rows have ann_id, state, concepts array<struct<iri, label, confidence, state>> (the first is the primary), lineage array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def primary_iri() -> Column:
    return F.get("concepts", F.lit(0))["iri"]


def _promoted(k: Column) -> Column:
    """The concepts with the one at ``k`` first and confirmed, the others after it as backups, in order."""
    first = F.get("concepts", k)
    lead = F.struct(first["iri"].alias("iri"), first["label"].alias("label"), first["confidence"].alias("confidence"), F.lit("confirmed").alias("state"))
    rest = F.filter("concepts", lambda c, i: i != k)
    backups = F.transform(rest, lambda c: F.struct(c["iri"].alias("iri"), c["label"].alias("label"), c["confidence"].alias("confidence"), F.lit("backup").alias("state")))
    return F.concat(F.array(lead), backups)


def promote(df: DataFrame, k: Column) -> DataFrame:
    """The concept at ``k`` becomes the primary; 0 or a place that isn't there changes nothing."""
    hit = (k > 0) & (k < F.size("concepts"))
    return df.withColumn("lineage", F.when(hit, F.concat("lineage", F.array(F.concat(F.lit("promoted "), F.get("concepts", k)["iri"])))).otherwise(F.col("lineage"))).withColumn("concepts", F.when(hit, _promoted(k)).otherwise(F.col("concepts")))


def cascade(df: DataFrame, old: Column, new: Column) -> DataFrame:
    """Wherever ``old`` is the primary and ``new`` a backup, ``new`` is promoted."""
    at = F.array_position(F.transform("concepts", lambda c: c["iri"]), new) - 1
    return promote(df, F.when(primary_iri() == old, at).otherwise(F.lit(0)).cast("int"))


def reject(df: DataFrame, which: Column) -> DataFrame:
    """Rejected once; those that are so already stay as they are."""
    hit = F.coalesce(which, F.lit(False)) & (F.col("state") != "rejected")
    return df.withColumn("lineage", F.when(hit, F.concat("lineage", F.array(F.lit("rejected")))).otherwise(F.col("lineage"))).withColumn("state", F.when(hit, "rejected").otherwise(F.col("state")))


def restore(df: DataFrame, which: Column) -> DataFrame:
    """Rejected ones become confirmed; others stay."""
    hit = F.coalesce(which, F.lit(False)) & (F.col("state") == "rejected")
    return df.withColumn("lineage", F.when(hit, F.concat("lineage", F.array(F.lit("restored")))).otherwise(F.col("lineage"))).withColumn("state", F.when(hit, "confirmed").otherwise(F.col("state")))


def live_by_primary(df: DataFrame) -> DataFrame:
    return df.groupBy(primary_iri().alias("iri")).agg(F.count_if(F.col("state") != "rejected").alias("n_live"), F.count(F.lit(1)).alias("n_all"))


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with their keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def attach(matches: DataFrame, existing: DataFrame) -> DataFrame:
    """Matches (doc_id, start, end, text, iri) with the existing annotation's ann_id: of the same span and iri, else of the same span and text."""
    exact = existing.groupBy("doc_id", "start", "end", "iri").agg(F.min("ann_id").alias("exact"))
    loose = existing.groupBy("doc_id", "start", "end", F.lower("text").alias("low")).agg(F.min("ann_id").alias("loose"))
    found = matches.withColumn("low", F.lower("text")).join(exact, ["doc_id", "start", "end", "iri"], "left").join(loose, ["doc_id", "start", "end", "low"], "left")
    return found.withColumn("ann_id", F.coalesce("exact", "loose")).withColumn("created", F.col("ann_id").isNull()).drop("low", "exact", "loose")


def without(old: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``old`` but for those with a key of ``gone``."""
    return old.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def rejected_with_feedback(df: DataFrame, feedback: DataFrame, which: Column, note: str) -> tuple[DataFrame, DataFrame]:
    """Annotations (job_id, ann_id, ...) rejected, and the feedback (job_id, ann_id, rating, note) with an entry for each that now is and wasn't."""
    hit = df.filter(F.coalesce(which, F.lit(False)) & (F.col("state") != "rejected")).select("job_id", "ann_id", F.lit("dismissed").alias("rating"), F.lit(note).alias("note"))
    return reject(df, which), upserted(feedback, hit, "job_id", "ann_id")


def lineage_rows(df: DataFrame) -> DataFrame:
    """(ann_id, place, event): what has happened to each annotation, in order."""
    return df.select("ann_id", F.posexplode("lineage").alias("place", "event"))


def migrated(df: DataFrame) -> DataFrame:
    """Rows of an older form, with one ``branch``, in the present one: an array of ``branches``, the old one's branch if it is missing or empty."""
    old = F.when(F.coalesce("branch", F.lit("")) != "", F.array("branch")).otherwise(F.array().cast("array<string>"))
    return df.withColumn("branches", F.when(F.size(F.coalesce("branches", F.array().cast("array<string>"))) > 0, F.col("branches")).otherwise(old)).drop("branch")
