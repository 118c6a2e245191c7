"""Paths and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-memloom-")


def fresh_path(spark: SparkSession) -> str:
    """An unused path below spark.checkpoint.dir; below a local folder only where that is unset and all runs in one process, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _own_dir()
    return f"{top.rstrip('/')}/memloom/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, whatever is lost or planned anew later."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
