"""The memory table kept for merges: in buckets by external_uuid for upserts, by day for changes by id.

A bucketed table joins incoming rows on its key where it lies: the large side is not shuffled, and new rows are
appended as files of their own. Changes by id read the ids of all days, and then read and write only the days of the rows
that they alter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators.writes import apply_memory_changes, new_memory_rows
from memloom.sources.shared import fresh_path, written
from memloom.sources.transcripts import merge_memory, read_memory


def save_keyed(df: DataFrame, name: str, key: str = "external_uuid", buckets: int | None = None, path: str | None = None) -> None:
    """A table of the catalog in buckets by key. buckets: twice the shuffle partitions if None; fewer than these would not be used by joins."""
    spark = df.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key)  # a file a bucket
    dealt.write.format("parquet").option("path", path or fresh_path(spark)).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def upsert_keyed(spark: SparkSession, name: str, incoming: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The outcome of upsert_memory (external_uuid, id, inserted) on a table of save_keyed: new rows are appended, files that are there stay as they are."""
    memory = spark.table(name)
    rows, known = new_memory_rows(memory, incoming, order)
    rows, known = written(rows), written(known)
    held = {r["col_name"].strip(): r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    buckets = int(held["Num Buckets"])
    keys = [c.strip(" `") for c in held["Bucket Columns"].strip("[]").split(",")]
    rows.repartition(buckets, *keys).write.format("parquet").mode("append").bucketBy(buckets, keys).sortBy(keys).saveAsTable(name)
    return rows.select("external_uuid", "id", F.lit(True).alias("inserted")).union(known)


def change_stored(spark: SparkSession, path: str, changes: DataFrame, as_of: Column, **more: bool) -> DataFrame:
    """The statuses of apply_memory_changes on the table of write_memory; only days with rows that changed, or were added, are written."""
    memory = read_memory(spark, path)
    ids = changes.where("memory_id is not null").select(F.col("memory_id").alias("id")).distinct()
    own = written(memory.join(ids, "id", "left_semi"))  # what the log names
    top = memory.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    after, status = apply_memory_changes(own, changes, as_of, top=top, **more)
    status = written(status)
    altered = status.where("status in ('updated', 'removed')").join(changes.select("seq", F.col("memory_id").alias("id")), "seq").select("id").distinct()
    merge_memory(spark, after.join(altered, "id", "left_semi").union(after.where(F.col("id") > top)), path)
    return status
