"""Startup briefs of all users at once."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.tags import since

#: How many messages and tags a brief shows, the length of a preview, and characters a token.
CURRENT, OTHERS, PREVIEW, TAGS = 8, 4, 100, 5
CHARS_PER_TOKEN = 1.7
#: The wording of a brief.
TITLE, PLATFORM = "# Memory Briefing (user: ", "Current platform: `"
CORE, SUB = "## Core Profile", "## Sub Profile"
PROJECTS, MEMORIES = "## Active Projects (last ", " memories (last: "
RECENT, RECENT_ON, ORDER = "## Recent Memory (last ", "## Recent on ", ", oldest → newest)"
WHISPERS = "## Cross-platform Whispers (other agents, last "
MORE = "Use `search_memory({ query, p_tag, date_range, role, agent_platform, include_archived })` to retrieve more."
ACROSS = 'Cross-platform search: `search_memory({ query, agent_platform: "*" })`.'
REFRESH = "Use `memory_startup` tool for a refreshed brief mid-session."


def active_tags(memory: DataFrame, tags: DataFrame, as_of: dt.datetime, days: int = 3, n: int = TAGS) -> DataFrame:
    """(user_id, name, count, last_used, rank) of the tags that each user used last, by the stored tag."""
    rows = memory.where(F.col("is_active") & (F.col("created_at") >= since(as_of, days)))
    used = rows.groupBy("user_id", "p_tag_id").agg(F.count("*").alias("count"), F.max("created_at").alias("last_used"))
    named = used.join(tags.select(F.col("id").alias("p_tag_id"), "name"), "p_tag_id")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_used"), "name"))
    return named.withColumn("rank", rank).where(F.col("rank") <= n).select("user_id", "name", "count", "last_used", "rank")


def recent_messages(memory: DataFrame, as_of: dt.datetime, current_platform: str | None = None, days: int = 3) -> DataFrame:
    """(user_id, is_current, rank, id, role, agent_platform, device_name, preview, created_at); rank 1 is the newest.

    The newest on the current platform and a few on others, or the newest of all without a platform.
    """
    own = F.lit(True) if current_platform is None else F.col("agent_platform") == current_platform
    rows = memory.where(F.col("is_active") & (F.col("created_at") >= since(as_of, days))).withColumn("is_current", own).where("is_current is not null")
    rows = rows.select("user_id", "is_current", "id", "role", "agent_platform", "device_name", F.substring("message", 1, PREVIEW).alias("preview"), "created_at")
    rank = F.row_number().over(Window.partitionBy("user_id", "is_current").orderBy(F.desc("created_at"), F.desc("id")))
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= max(CURRENT, OTHERS))  # a literal bound cuts groups before the exchange
    return ranked.where(F.col("rank") <= F.when(F.col("is_current"), CURRENT).otherwise(OTHERS))


def collect_brief(users: DataFrame, memory: DataFrame, tags: DataFrame, as_of: dt.datetime, current_platform: str | None = None, days: int = 3) -> DataFrame:
    """One row a user: profiles, tags, and messages of this platform and of others, oldest first. users: (user_id, user_name, core_profile, sub_profile)."""
    t = active_tags(memory, tags, as_of, days).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "count", "last_used"))).alias("tags"))
    m = recent_messages(memory, as_of, current_platform, days)
    row = F.struct((-F.col("rank")).alias("place"), "role", "agent_platform", "device_name", "preview", "created_at")
    m = m.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_current"), row))).alias("current"), F.sort_array(F.collect_list(F.when(~F.col("is_current"), row))).alias("others")
    )
    known = ["user_id", "user_name", "core_profile", "sub_profile"]
    return users.select(*known).join(t, "user_id", "left").join(m, "user_id", "left").select(
        *known, "tags", "current", "others", F.lit(current_platform).cast("string").alias("current_platform"), F.lit(days).alias("days")
    )


def _message_line(m: Column, show_platform: Column) -> Column:
    device = F.when(m["device_name"].isNotNull() & (m["device_name"] != ""), F.concat(F.lit("@"), m["device_name"], F.lit(" "))).otherwise("")
    where = F.when(show_platform, F.concat(m["agent_platform"], F.lit(" "), device)).otherwise(device)
    more = F.when(F.length(m["preview"]) >= PREVIEW, "…").otherwise("")
    return F.concat(F.lit("- ["), F.date_format(m["created_at"], "HH:mm"), F.lit(" "), where, m["role"], F.lit("] "), m["preview"], more)


def render_brief(briefs: DataFrame, device_name: str = "local", hints: tuple[str, str, str] = (MORE, ACROSS, REFRESH)) -> DataFrame:
    """(user_id, brief): the text of each user's brief. hints: how to find more, how to search across platforms (shown where there is one), how to refresh; these name an agent's tools."""
    platform, none = F.col("current_platform"), F.lit(None).cast("array<string>")
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.lit(head), c, F.lit("")))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    n = lambda c: F.size(c).cast("string")
    block = lambda c, head, lines: F.when(some(c), F.concat(F.array(head), lines, F.array(F.lit("")))).otherwise(none)
    tag_line = lambda t: F.concat(
        F.lit("- **"), t["name"], F.lit("** — "), t["count"].cast("string"), F.lit(MEMORIES), F.coalesce(F.date_format(t["last_used"], "yyyy-MM-dd"), F.lit("?")), F.lit(")")
    )
    heading = F.when(platform.isNull(), F.concat(F.lit(RECENT), n("current"))).otherwise(F.concat(F.lit(RECENT_ON), platform, F.lit(" (last "), n("current")))
    parts = [
        F.array(F.concat(F.lit(TITLE), F.col("user_name"), F.lit(")"))),
        F.when(platform.isNotNull(), F.array(F.concat(F.lit(PLATFORM), platform, F.lit(f" @ {device_name}`")))),
        F.array(F.lit("")),
        part(CORE, F.col("core_profile")),
        part(SUB, F.col("sub_profile")),
        block("tags", F.concat(F.lit(PROJECTS), F.col("days").cast("string"), F.lit(" days)")), F.transform("tags", tag_line)),
        block("current", F.concat(heading, F.lit(ORDER)), F.transform("current", lambda m: _message_line(m, platform.isNull()))),
        block("others", F.concat(F.lit(WHISPERS), n("others"), F.lit(")")), F.transform("others", lambda m: _message_line(m, F.lit(True)))),
        F.array(F.lit("---"), F.lit(hints[0])),
        F.when(platform.isNotNull(), F.array(F.lit(hints[1]))),
        F.array(F.lit(hints[2])),
    ]
    empty = F.array().cast("array<string>")
    return briefs.select("user_id", F.array_join(F.concat(*(F.coalesce(p, empty) for p in parts)), "\n").alias("brief"))


def short_term_window(memory: DataFrame, as_of: dt.datetime, days: int = 3, budget: float = 8000, steps: tuple[int, ...] = (3600, 60, 1)) -> DataFrame:
    """The newest messages of each user within the days and the token budget, whichever is reached first; with `tokens` so far.

    A scan in two passes over segments of so many seconds, for each of the steps: each segment gives the length of its messages by an aggregation that
    combines before the shuffle, sums run over them from the newest, and those that begin beyond the budget are
    dropped. So of a user's messages only what is near the budget's end is sorted, in segments of a second.
    """
    chars = F.length("message")
    number = F.unix_seconds("created_at") if memory.schema["created_at"].dataType.typeName() == "timestamp" else (
        ((F.unix_date(F.to_date("created_at")).cast("long") * 24 + F.hour("created_at")) * 60 + F.minute("created_at")) * 60 + F.second("created_at")
    )  # of seconds, in the order of time whatever the session's zone
    rows = memory.where(F.col("is_active") & (F.col("created_at") >= since(as_of, days))).withColumn("_before", F.lit(None).cast("long"))
    keys = ["user_id"]
    for step in steps:
        rows = rows.withColumn("_at", F.floor(number / step))
        total = rows.groupBy(*keys, "_at").agg(F.sum(chars).alias("_n"), F.first("_before").alias("_base"))
        newer = Window.partitionBy(*keys).orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
        total = total.withColumn("_n", F.sum("_n").over(newer)).withColumn("_sum", F.coalesce(F.col("_base") + F.col("_n"), "_base", "_n"))
        total = total.where(F.coalesce("_sum", F.lit(0)) / CHARS_PER_TOKEN <= budget).select(*(F.col(k).alias(f"{k}_") for k in (*keys, "_at")), "_sum")
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in (*keys, "_at")]
        rows = rows.drop("_before").join(total, reduce(lambda a, b: a & b, same)).withColumn("_before", F.col("_sum")).drop("_sum", *(f"{k}_" for k in (*keys, "_at")))
        rows, keys = rows.withColumnRenamed("_at", f"_{step}"), [*keys, f"_{step}"]
    so_far = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.asc("id")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(chars).over(so_far)
    tokens = F.coalesce(F.col("_before") + own, "_before", own) / CHARS_PER_TOKEN
    return rows.withColumn("tokens", tokens).where(F.col("tokens") <= budget).select(*memory.columns, "tokens")


def scope_memories(memory: DataFrame, platform: str, model: str, p_tag_id: int | None = None) -> DataFrame:
    """What an agent may see: its own platform and model, or anyone's on the same project tag."""
    own = (F.col("agent_platform") == platform) & (F.col("agent_model") == model)
    return memory.where(own if p_tag_id is None else own | (F.col("p_tag_id") == p_tag_id))
