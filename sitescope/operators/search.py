"""Search over the texts of several kinds of records, through an index of three-letter runs.

Rows are (kind, id, title, text). The index holds, for each run of three characters of the lower-cased text, the records that
hold it, in parts by the run's first character and sorted by run; a text's end counts as two further characters, so that one
or two letters are a beginning of some run. A search reads the lists of its own runs alone, of those the shortest, and
verifies the records that are in all of them. Records are stored by kind in order of their ids; of the candidates, in the
order wanted, so many are verified at a time until enough are found.

Null texts hold nothing; an empty search finds nothing. Records need ids that are unique within their kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitescope.functions import grams as G

RUN = 3
#: Parts of the index, by the first character of a run.
PARTS = 64
#: Lists that a search reads at most, the shortest first, and candidates that it verifies at a time.
LISTS, VERIFIED = 3, 1000
END = "\x00"


def _part(run: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(run, F.lit(1))), F.lit(PARTS)).cast("int")


def write_index(rows: DataFrame, folder: str) -> None:
    """Write the records, the lists, and the lists' lengths."""
    rows = rows.where("text is not null and id is not null")
    rows.repartitionByRange("kind", "id").sortWithinPartitions("id").write.partitionBy("kind").parquet(f"{folder}/records")
    runs = G.runs_of(F.concat(F.lower("text"), F.lit(END * (RUN - 1))), RUN)
    lists = rows.select("kind", "id", F.explode(runs).alias("run")).withColumn("part", _part(F.col("run")))
    lists.repartitionByRange("part", "run", "kind", "id").sortWithinPartitions("part", "run", "kind", "id").write.partitionBy("part").parquet(f"{folder}/lists")
    counted = lists.groupBy("part", "run").agg(F.count(F.lit(1)).alias("n"))
    counted.repartitionByRange("part", "run").sortWithinPartitions("part", "run").write.partitionBy("part").parquet(f"{folder}/lengths")


def _parts_of(spark: SparkSession, runs: list[str]) -> list[int]:
    return sorted({r[0] for r in spark.createDataFrame([(x,) for x in runs], "run string").select(_part(F.col("run"))).collect()})


def candidates(spark: SparkSession, folder: str, q: str) -> DataFrame:
    """(kind, id) of the records that are in every list read: all that hold the text, and few others."""
    lists = spark.read.parquet(f"{folder}/lists")
    if len(q) < RUN:
        return lists.where(F.col("part").isin(_parts_of(spark, [q])) & F.startswith("run", F.lit(q))).select("kind", "id").distinct()
    runs = sorted({q[k : k + RUN] for k in range(len(q) - RUN + 1)})
    lengths = spark.read.parquet(f"{folder}/lengths").where(F.col("part").isin(_parts_of(spark, runs)) & F.col("run").isin(runs))
    found = sorted((r["n"], r["run"]) for r in lengths.collect())  # one row for each run of the search at most
    if len(found) < len(runs):
        return lists.limit(0).select("kind", "id")
    chosen = [run for _, run in found[:LISTS]]
    own = lists.where(F.col("part").isin(_parts_of(spark, chosen)) & F.col("run").isin(chosen))
    return own.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select("kind", "id")


def search(spark: SparkSession, folder: str, q: str, limits: dict[str, tuple[int, bool]], total: int = 30) -> DataFrame:
    """(kind, id, title) of records whose text contains ``q`` in any case: kinds in the order of ``limits``, each with its
    (limit, whether the last ids come first), ``total`` rows at most."""
    q = q.strip().lower()
    out: list[tuple] = []
    if q:
        records = spark.read.parquet(f"{folder}/records")
        near = candidates(spark, folder, q)
        for kind, (limit, last_first) in limits.items():
            own, found, after = near.where(F.col("kind") == kind), [], None
            while len(found) < limit:
                further = own if after is None else own.where(F.col("id") < after if last_first else F.col("id") > after)
                ids = [r["id"] for r in further.orderBy(F.desc("id") if last_first else F.asc("id")).limit(VERIFIED).collect()]
                if not ids:
                    break
                held = records.where((F.col("kind") == kind) & F.col("id").between(min(ids), max(ids)) & F.col("id").isin(ids) & F.contains(F.lower("text"), F.lit(q)))
                found += [(kind, r["id"], r["title"]) for r in held.orderBy(F.desc("id") if last_first else F.asc("id")).limit(limit - len(found)).collect()]
                after = ids[-1]
                if len(ids) < VERIFIED:
                    break
            out += found
    return spark.createDataFrame(out[:total], "kind string, id long, title string")
