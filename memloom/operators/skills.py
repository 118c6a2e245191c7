"""Skills: which to inject, exposures, routing of candidates, and merging of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.search import nearest_in_blocks


def _keys(listed: Column, value: Column | None = None) -> Column:
    """What a skill's list, or a context's value, is joined by: a value, `*` for a missing list, `?` for a null value."""
    if value is not None:
        return F.when(value.isNull(), F.array(F.lit("?"))).otherwise(F.array(F.concat(F.lit("="), value), F.lit("*")))
    own = F.transform(F.array_distinct(F.filter(listed, lambda x: x.isNotNull())), lambda x: F.concat(F.lit("="), x))
    return F.concat(F.coalesce(own, F.array(F.lit("*"))), F.array(F.lit("?")))


def injectable_skills(skills: DataFrame, contexts: DataFrame, n: int = 5) -> DataFrame:
    """(ctx_id, id, rank): active skills that apply to a context's model, platform and project; a missing list applies to all, a null value asks for nothing.

    An equi-join: of the keys of a skill and of a context exactly one is the same where they fit. The best n of
    each key are found first, so a context meets at most eight times n skills.
    """
    dims = {"model": "models", "platform": "platforms", "project_key": "projects"}
    best = skills.where("status = 'active'").select("id", "use_count", *(_keys(F.col(f"applicable_to.{v}")).alias(k) for k, v in dims.items()))
    asked = contexts.select("ctx_id", *(_keys(F.lit(None), F.col(k)).alias(k) for k in dims))
    for k in dims:
        best, asked = best.withColumn(k, F.explode(k)), asked.withColumn(k, F.explode(k))
    order = [F.desc("use_count"), F.asc("id")]
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*dims).orderBy(*order))).where(F.col("rank") <= n).drop("rank")
    rank = F.row_number().over(Window.partitionBy("ctx_id").orderBy(*order))
    return asked.join(best, list(dims)).withColumn("rank", rank).where(F.col("rank") <= n).select("ctx_id", "id", "rank")


def mark_exposed(skills: DataFrame, exposures: DataFrame) -> DataFrame:
    """skills with last_used_at moved to their latest exposure (skill_id, ts); use_count stays."""
    last = exposures.groupBy(F.col("skill_id").alias("id")).agg(F.max("ts").alias("_ts"))
    return skills.join(last, "id", "left").withColumn("last_used_at", F.greatest("_ts", "last_used_at")).select(*skills.columns)


def route_skill_candidates(skills: DataFrame, candidates: DataFrame, same: float = 0.9, near: float = 0.7) -> DataFrame:
    """(candidate_id, skill_id, similarity, action, parent_skill_id): the nearest active skill decides: accumulate, branch (it becomes inactive and the parent) or create.

    Candidates are queries to all skills, in blocks (see nearest_in_blocks).
    """
    rows = skills.where("status = 'active'").select(F.col("id").cast("long").alias("id"), "embedding")
    best = nearest_in_blocks(rows, candidates.select(F.col("candidate_id").cast("long").alias("query_id"), F.col("embedding").alias("vector")))
    best = best.select(F.col("query_id").alias("candidate_id"), F.col("id").alias("_skill"), "similarity")
    j = candidates.select("candidate_id").join(best, "candidate_id", "left")
    action = F.when(F.col("similarity") >= same, "accumulate").when(F.col("similarity") >= near, "branch").otherwise("create")
    j = j.withColumn("action", action)
    used = F.when(F.col("action") != "create", F.col("_skill"))
    return j.select("candidate_id", used.alias("skill_id"), "similarity", "action", F.when(F.col("action") == "branch", F.col("_skill")).alias("parent_skill_id"))


def merge_projects(skills: DataFrame, additions: DataFrame) -> DataFrame:
    """skills whose project list gained the keys of (skill_id, project_key): null adds nothing, and a skill that applies to all projects is not narrowed."""
    keys = additions.where("project_key is not null").groupBy(F.col("skill_id").alias("id")).agg(F.sort_array(F.collect_set("project_key")).alias("_keys"))
    j = skills.join(keys, "id", "left")
    merged = F.when(F.col("_keys").isNotNull() & F.col("applicable_to.projects").isNotNull(), F.array_union("applicable_to.projects", "_keys")).otherwise(F.col("applicable_to.projects"))
    return j.withColumn("applicable_to", F.col("applicable_to").withField("projects", merged)).select(*skills.columns)
