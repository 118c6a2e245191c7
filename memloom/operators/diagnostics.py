"""Looking at the memory table: activity of a platform, and signs of concurrent capture."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def platform_activity(memory: DataFrame, platform: str, as_of: dt.datetime, hours: int = 2, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """(the newest n messages with previews, counts by role) of a platform in the last hours."""
    recent = memory.where((F.col("agent_platform") == platform) & (F.col("created_at") >= F.lit(as_of - dt.timedelta(hours=hours)).cast("timestamp_ntz")))
    newest = recent.orderBy(F.desc("created_at"), "id").limit(n).select("id", "role", "device_name", F.substring("message", 1, 70).alias("preview"), "created_at")
    return newest, recent.groupBy("role").agg(F.count("*").alias("cnt"))


def double_write_report(memory: DataFrame) -> DataFrame:
    """(role, hash, at, n, first_id): rows of the same role and text within one millisecond."""
    keyed = memory.select("id", "role", F.sha2("message", 256).alias("hash"), F.date_trunc("millisecond", "created_at").alias("at"))
    return keyed.groupBy("role", "hash", "at").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
