"""Tags: alias closure, frequencies of keywords, promotion to project tags, and filling them in."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import slug, trim_all
from memloom.operators.writes import get_or_create_dim
from memloom.sources.shared import written


def resolve_aliases(tags: DataFrame) -> DataFrame:
    """(name, id, root_id): pointer doubling along alias_of, until nothing moves; a cycle has no root, nor has a chain that ends outside.

    A chain is at most as long as there are tags, so more doublings than that only go round cycles.
    """
    links = tags.select("name", "id", F.coalesce("alias_of", "id").alias("at"))
    for _ in range(tags.count().bit_length()):
        step = links.select(F.col("id").alias("_id"), F.col("at").alias("_next"))
        moved = links.join(step, F.col("at") == F.col("_id"), "left")
        moved = written(moved.select("name", "id", F.col("_next").alias("at"), (~F.col("at").eqNullSafe(F.col("_next"))).alias("_moved")))
        links = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    roots = tags.where("alias_of is null").select(F.col("id").alias("root_id"))
    return links.join(roots, F.col("at") == F.col("root_id"), "left").select("name", "id", "root_id")


def since(as_of: dt.datetime, days: float) -> F.Column:
    return F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")


def dtag_frequency(memory: DataFrame, as_of: dt.datetime, days: int = 30, least: int = 2, top: int = 50) -> DataFrame:
    """(user_id, tag, cnt) for each user: keywords of tagged, active rows in the window, the most frequent first."""
    rows = memory.where((F.col("tag_processed")) & F.col("is_active") & (F.col("created_at") >= since(as_of, days)))
    counts = rows.select("user_id", F.explode("d_tag").alias("tag")).select("user_id", slug(F.col("tag")).alias("tag")).where("tag <> ''")
    counts = counts.groupBy("user_id", "tag").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("cnt"), "tag"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def cluster_totals(freq: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(user_id, canonical, members, total): counts summed over each cluster's members, or a cluster for each keyword."""
    if clusters is None:
        return freq.select("user_id", F.col("tag").alias("canonical"), F.array("tag").alias("members"), F.col("cnt").alias("total"))
    named = clusters.select(
        F.regexp_replace(slug(F.col("canonical")), r"\s+", "-").alias("canonical"), F.filter(F.transform("members", slug), lambda m: m != "").alias("members")
    )
    flat = named.select("canonical", "members", F.explode("members").alias("tag"))
    sums = freq.join(flat, "tag").groupBy("user_id", "canonical").agg(F.sum("cnt").alias("total"), F.first("members").alias("members"))
    return sums.select("user_id", "canonical", "members", "total")


def promote_tags(tags: DataFrame, totals: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(tags, promoted): clusters of enough mentions become project tags where absent. promoted: (user_id, canonical, members, total, p_tag_id)."""
    enough = written(totals.where((F.col("total") >= least) & (trim_all(F.col("canonical")) != "")))
    whole, ids = get_or_create_dim(tags, enough.select(F.col("canonical").alias("name")))
    promoted = enough.join(ids.select(F.col("name").alias("canonical"), F.col("id").alias("p_tag_id")), "canonical").select("user_id", "canonical", "members", "total", "p_tag_id")
    return whole, written(promoted)


def retrotag(memory: DataFrame, promoted: DataFrame) -> DataFrame:
    """memory with p_tag_id filled in for tagged rows that have none and hold a member of one of their user's promoted clusters.

    The cluster of the largest total wins, ties by name. promoted holds a few rows a user; the optimiser may broadcast it.
    """
    rank = F.struct(-F.col("total"), F.col("canonical"))
    members = promoted.select(F.col("user_id").alias("_u"), F.explode("members").alias("_tag"), rank.alias("_rank"), F.col("p_tag_id").alias("_p"))
    open_ = memory.where("tag_processed and p_tag_id is null").select("id", "user_id", F.explode(F.array_distinct("d_tag")).alias("_d"))
    found = open_.join(members, (F.col("user_id") == F.col("_u")) & (slug(F.col("_d")) == F.col("_tag")))
    found = found.groupBy("id").agg(F.min_by("_p", "_rank").alias("_found"))
    return memory.join(found, "id", "left").withColumn("p_tag_id", F.coalesce("p_tag_id", "_found")).select(*memory.columns)
