"""Intermediate tables in the folder that the cluster shares, and size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.arrays import give_back

#: Rows of a batch of texts for Python workers.
BATCH_ROWS = 2_000
#: Characters of a plan's text that the driver keeps.
PLAN_LENGTH = 20_000
#: Rows of ids, and bytes of longer rows, that a broadcast may carry; a larger side is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole texts go to Python workers in batches of so many rows at most: a batch is held several times over on its way. And texts of
    plans, which the driver keeps for each job, are cut: with large literals they are megabytes."""
    plan = "spark.sql.maxPlanStringLength"
    if int("".join(filter(str.isdigit, spark.conf.get(plan)))) > PLAN_LENGTH:
        spark.conf.set(plan, str(PLAN_LENGTH))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def drop(df: DataFrame) -> None:
    """Deletes the files of a table that keep() wrote."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_rows_of(big: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """big joined with ids. ids goes to all executors if it has at most BROADCAST_ROWS rows, else both sides are shuffled."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(ids) if small else ids.hint("merge"), on)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more; else they stay until a collection happens. The
    driver's Python gives back what it does not need."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()


def release_executors(spark: SparkSession) -> None:
    """Executors give memory back that an earlier job's garbage holds: their heaps grow with it and shrink only when they are collected
    as a whole. As many tasks as there are cores, so that each executor of an idle cluster gets some."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("append").save()
