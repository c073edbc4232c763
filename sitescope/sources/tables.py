"""Intermediate tables in the folder that driver and executors share, and inputs of few bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: An input of fewer bytes a core than this may be one task's work; dealing it out costs less than leaving cores idle.
SMALL = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; local sessions without one get a temporary folder, others an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; what is still there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage, and survives lost executors. Later steps read
    the files lazily, so they stay until dropped() or the application's end."""
    path = f"{temporary(df.sparkSession, 'table')}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_counting(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """The settled rows, and for how many of them the condition holds, counted as they are written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, seen.get["n"]


def dropped(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    for path in {f.rsplit("/rows/", 1)[0] for f in df.inputFiles()}:
        removed(df.sparkSession, path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by the keys: joins on these shuffle the other side alone."""
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{temporary(spark, 'table')}/rows").saveAsTable(name)
    return spark.table(name)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The rows, to be broadcast if they are few; beyond that Spark chooses how to join them."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt over all cores, for work that costs much a row; larger inputs have splits enough and stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
