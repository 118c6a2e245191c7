"""Transcript files: lines with byte offsets, session documents, cursors, and the memory table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import session_id_of
from memloom.sources.appended import SPLIT_BYTES, file_ranges, read_ranges
from memloom.sources.shared import written

SESSION = "struct<sessionId:string,messages:array<string>>"


def split_lines(files: DataFrame) -> DataFrame:
    """(path, pos, byte_offset, line) of each complete line of (path, text) rows.

    The text behind the last line feed is held back. Blank lines count in offsets and are not returned.
    A line's offset is a running sum over its file: a window by path, so a shuffle of the lines.
    """
    lines = F.split(F.col("text"), "\n", -1)
    whole = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    cut = files.where("text is not null").select("path", F.posexplode(whole).alias("pos", "line"))
    cut = cut.selectExpr("*", "sum(octet_length(line) + 1) over (partition by path order by pos) - octet_length(line) - 1 as byte_offset")
    return cut.where(F.regexp_replace("line", r"^[\s\p{Z}\x{FEFF}]+", "") != "").select("path", "pos", F.col("byte_offset").cast("long").alias("byte_offset"), "line")


def read_whole(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """(path, text): each file whole, from all folders below."""
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return read.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_jsonl_lines(spark: SparkSession, path: str, kind: str = "claude", cursors: DataFrame | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, session_id, pos, byte_offset, line) of append-only transcripts, behind the cursors if any; files without a session id are left out."""
    lines = read_new_lines(spark, path, cursors, split_bytes=split_bytes)[0].withColumn("session_id", session_id_of(F.col("path"), kind))
    return lines.where("session_id is not null").select("path", "session_id", "pos", "byte_offset", "line")


def read_new_lines(
    spark: SparkSession, path: str, cursors: DataFrame | None = None, pattern: str = "*.jsonl", split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """((path, pos, byte_offset, line), (path, cursor, lines)): complete lines behind each file's cursor, and the next cursors of all files.

    Files are read in ranges of split_bytes, so one long file is spread over tasks; a file at its cursor is not opened. `lines`,
    how many lines lie before the cursor, is carried in cursors so that line numbers go on.
    """
    files = list_files(spark, path, pattern)
    lines, after = read_ranges(file_ranges(files, cursors, split_bytes), split_bytes)
    if cursors is not None:
        held = cursors.select("path", "cursor", *(["lines"] if "lines" in cursors.columns else [F.lit(0).cast("long").alias("lines")]))
        after = after.unionByName(held).groupBy("path").agg(F.max("cursor").alias("cursor"), F.max("lines").alias("lines"))
    return lines, after


def explode_sessions(files: DataFrame) -> DataFrame:
    """(path, session_id, idx, message): messages of single-document sessions; a malformed file gives no rows."""
    doc = files.select("path", F.from_json("text", SESSION).alias("doc"))
    named = doc.select("path", session_id_of(F.col("path"), "gemini", F.col("doc.sessionId")).alias("session_id"), "doc.messages")
    return named.select("path", "session_id", F.posexplode("messages").alias("idx", "message"))


def read_session_json(spark: SparkSession, path: str) -> DataFrame:
    return explode_sessions(read_whole(spark, path, "*.json"))


def delta_lines(lines: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new lines, next cursors): lines at or past each file's cursor; a file without one starts at 0.

    Cursors are a row a file; whether to broadcast them is left to the optimiser, which knows their size.
    """
    known = cursors.select("path", F.col("cursor").alias("_from"))
    fresh = lines.join(known, "path", "left").where(F.col("byte_offset") >= F.coalesce("_from", F.lit(0))).drop("_from")
    ends = lines.groupBy("path").agg(F.max(F.col("byte_offset") + F.octet_length("line") + 1).alias("end"))
    after = ends.join(known, "path", "full").select("path", F.greatest(F.coalesce("end", "_from"), F.coalesce("_from", F.lit(0))).alias("cursor"))
    return fresh, after


def initial_cursors(files: DataFrame, start: dt.datetime, slack_seconds: int = 5) -> DataFrame:
    """(path, cursor): files born more than slack before the start are taken as read, younger ones as new."""
    old = F.col("modificationTime") < F.lit(start - dt.timedelta(seconds=slack_seconds)).cast(files.schema["modificationTime"].dataType)
    return files.select("path", F.when(old, F.col("length")).otherwise(F.lit(0)).cast("long").alias("cursor"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """(path, length, modificationTime) without reading contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", "modificationTime")


def write_memory(memory: DataFrame, path: str, mode: str = "append") -> None:
    """Store by day of creation, so that filters on dates prune. Days are gathered and large ones split by the size that a shuffle has (a rebalance), however busy they are."""
    memory.withColumn("day", F.to_date("created_at")).hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def merge_memory(spark: SparkSession, changed: DataFrame, path: str, key: str = "id") -> None:
    """Rows of the stored table are replaced by those with the same key in changed, or added. Only days of changed rows are read and written; a row keeps its day."""
    dated = written(changed.withColumn("day", F.to_date("created_at")))
    days = [r["day"] for r in dated.select("day").distinct().collect()]  # a row a day
    if not days:
        return
    held = spark.read.parquet(path).where(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False)))
    whole = written(held.join(dated.select(key), key, "left_anti").unionByName(dated.select(*held.columns)))
    whole.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_memory(spark: SparkSession, path: str, since: dt.datetime | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    if since is not None:
        stored = stored.where((F.col("day") >= F.lit(since.date())) & (F.col("created_at") >= F.lit(since).cast("timestamp_ntz")))
    return stored.drop("day")
