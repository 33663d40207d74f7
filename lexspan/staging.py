"""Tables written once to the shared folder and read back, where a plan would grow without end or be run twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which the shuffle files of a query go when it has ended; by itself it leaves them until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a temporary one, on one machine only: elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str, made: list[str] | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and a lost executor costs no rerun.

    The path is added to ``made``, so that whoever reads the table last can give it to ``discard``. What a
    returned DataFrame still reads stays, in a folder named after the application. The shuffle files of the write
    are deleted when it is done: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made.clear()


#: Rows of a task that works on them in Python, where a scan is dealt anew.
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt over all cores, and into tasks of about TASK_ROWS, for work that is heavy for its bytes; one whose splits are about as small stays as it is.

    Rows are counted by split: a file has a split for so many bytes, but its row groups, each read by one of them, may be few.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    each = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(cores, -(-rows // TASK_ROWS))
    return df if largest * tasks <= 2 * rows and df.rdd.getNumPartitions() >= cores else df.repartition(tasks)
