"""Sources and prompts for profiles, and merging their replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import without_fences

#: The wording of a profile prompt.
EXISTING = "EXISTING PROFILE (subject to update):\ncore_profile:\n"
SUB, EMPTY = "\n\nsub_profile:\n", "(empty)"
RECENT, ROLE = "\n\nRECENT USER MESSAGES (most recent ", ", role='user'):\n"
TASK = "\n\nTask: produce updated core_profile and sub_profile JSON per the system prompt."


def profile_sources(memory: DataFrame, n: int = 30) -> DataFrame:
    """(user_id, id, message, created_at, rank): each user's newest active messages of their own; rank 1 is the newest."""
    rows = memory.where("is_active and role = 'user'").select("user_id", "id", "message", "created_at")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def build_profile_prompts(users: DataFrame, sources: DataFrame) -> DataFrame:
    """(user_id, prompt) of users with messages: both profiles, then the messages, numbered from the oldest."""
    row = F.struct((-F.col("rank")).alias("place"), "created_at", "message")
    lists = sources.groupBy("user_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    line = lambda m, i: F.concat(F.lit("[#"), (i + 1).cast("string"), F.lit(" @ "), F.date_format(m["created_at"], "yyyy-MM-dd'T'HH:mm:ss"), F.lit("] "), m["message"])
    told = lambda c: F.coalesce(F.col(c), F.lit(EMPTY))
    text = F.concat(
        F.lit(EXISTING), told("core_profile"), F.lit(SUB), told("sub_profile"),
        F.lit(RECENT), F.size("rows").cast("string"), F.lit(ROLE), F.array_join(F.transform("rows", line), "\n\n"),
        F.lit(TASK),
    )
    return users.join(lists, "user_id").select("user_id", text.alias("prompt"))


def apply_profile_output(users: DataFrame, responses: DataFrame) -> DataFrame:
    """users with both profiles replaced by parsed replies (user_id, raw), `changed` (null and empty are the same) and `error`."""
    reply = without_fences(F.col("raw"))
    ok = F.try_parse_json(reply).isNotNull() & reply.startswith("{")
    r = responses.select("user_id", F.when(ok, F.from_json(reply, "core_profile string, sub_profile string")).alias("_r"), "raw", F.lit(True).alias("_asked"))
    j = users.join(r, "user_id", "left")
    same = lambda a, b: F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    has = F.col("_r").isNotNull()
    changed = has & ~(same(F.col("_r.core_profile"), F.col("core_profile")) & same(F.col("_r.sub_profile"), F.col("sub_profile")))
    error = F.when(F.col("_asked") & ~has, F.concat(F.lit("invalid JSON: "), F.substring(F.coalesce("raw", F.lit("")), 1, 200)))
    j = j.withColumns({"changed": changed, "error": error})
    put = {c: F.when(F.col("changed"), F.col(f"_r.{c}")).otherwise(F.col(c)) for c in ("core_profile", "sub_profile")}
    return j.withColumns(put).select(*users.columns, "changed", "error")
