"""The latest state of each project and key, kept up to date from a stream of finished audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.operators.workspace import upsert_latest
from sitescope.sources.tables import dropped, removed, settled

SCHEMA = "project_id long, state_key string, id long, title string, value double, created_at timestamp"
COLUMNS = tuple(c.split()[0] for c in SCHEMA.split(", "))


def latest_of(events: DataFrame) -> DataFrame:
    rows = events.select(*COLUMNS)
    return upsert_latest(rows, rows.limit(0)).select(*COLUMNS)


#: The state lies in so many parts by key; a batch rewrites only the parts that it touches.
PARTS = 64


def _part() -> Column:
    return F.pmod(F.xxhash64("project_id", "state_key"), F.lit(PARTS)).cast("int")


def start(events: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, keep: int = 2):
    """Run the query: each batch is merged into the parts of the state that it touches.

    A replayed event changes nothing, as a key's latest event is the latest however often it comes; so the stream keeps no
    state of its own, and no late event is dropped.
    A part's versions are folders part=P/version=B of the batch that wrote them. A batch that runs again reads the versions
    before its own and writes the same ones again, so nothing counts twice. Of each part the last ``keep`` versions stay.

    Spark's keyed state would keep each key's latest event in a state store besides the table, for ever, as keys never end;
    and as a stream's output in update mode it would still have to be merged into the table. So the table is the state.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = own = settled(latest_of(batch).withColumn("part", _part()))
        touched = [r[0] for r in fresh.select("part").distinct().collect()]  # at most PARTS rows
        versions = {p: [v for v in _versions(spark, folder, p) if v < batch_id] for p in touched}
        old = [f"{folder}/part={p}/version={v[-1]}" for p, v in versions.items() if v]
        if old:
            fresh = upsert_latest(spark.read.parquet(*old).select(*COLUMNS), fresh.select(*COLUMNS)).select(*COLUMNS).withColumn("part", _part())
        fresh = fresh.withColumn("version", F.lit(batch_id))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(folder)
        for p, v in versions.items():
            for gone in v[: -(keep - 1) or None]:
                removed(spark, f"{folder}/part={p}/version={gone}")
        dropped(own)

    return events.withColumn("created_at", F.col("created_at").cast("timestamp")).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _versions(spark: SparkSession, folder: str, part: int) -> list[int]:
    """Versions of a part, oldest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part={part}")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(where)) if files.exists(where) else []


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of each part of the state; no rows before the first event."""
    newest = [f"{folder}/part={p}/version={v[-1]}" for p in range(PARTS) if (v := _versions(spark, folder, p))]
    return spark.read.parquet(*newest).select(*COLUMNS) if newest else spark.createDataFrame([], SCHEMA)
