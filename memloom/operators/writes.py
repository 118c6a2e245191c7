"""Dedup, validation and merges into the memory table and its dimensions.

New ids are the largest id plus a number. Numbers are dealt in parts: rows are written in ranges, each with
its place in its range, and the ranges' sizes are summed up (a row a range), so no task sees all new rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import infer_provider, slug, trim_all
from memloom.sources.shared import written


def numbered(df: DataFrame, order: list[str], start: Column | int, name: str = "id") -> DataFrame:
    """Consecutive numbers from start + 1 in the given order.

    The sorted ranges are written with the range in the upper bits of _at and the place in it in the lower 33:
    ranges are cut anew by each plan that is run, so sizes and places must come from one run.
    """
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    begin = start if isinstance(start, Column) else F.lit(start)
    return dealt.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, begin + F.col("_before") + place + 1).drop("_part", "_at", "_before")


def dedup_content(df: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """The first of equal (role, message) within the scope's columns (none: over all rows); texts are compared by SHA-256.

    min_by combines before the shuffle, so a short text that a third of all rows share costs a row a task.
    """
    keys = [*scope, "role", "_hash"]
    hashed = df.withColumn("_hash", F.sha2("message", 256))
    first = hashed.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def new_memory_rows(memory: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, known): rows that are new to memory, with ids and defaults; known: (external_uuid, id, false) of those that it has."""
    order = order or ["external_uuid"]
    keyed = incoming.where("external_uuid is not null").groupBy("external_uuid").agg(F.min_by(F.struct(*incoming.columns), F.struct(*order)).alias("_r")).select("_r.*")
    have = memory.where("external_uuid is not null").select("external_uuid", F.col("id").alias("_have"))
    joined = keyed.join(have, "external_uuid", "left")
    new = joined.where("_have is null").drop("_have").unionByName(incoming.where("external_uuid is null"))
    top = memory.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(new, order, top)
    defaults = {"subagent": F.lit(False), "d_tag": F.array().cast("array<string>"), "is_active": F.lit(True), "is_pinned": F.lit(False)}
    cols = []
    for f in memory.schema.fields:
        c = F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, defaults[f.name])
        if f.name == "tag_processed":
            c = F.col("p_tag_id").isNotNull() if "p_tag_id" in new.columns else F.lit(False)
        cols.append(c.cast(f.dataType).alias(f.name))
    return new.select(*cols), joined.where("_have is not null").select("external_uuid", F.col("_have").alias("id"), F.lit(False).alias("inserted"))


def upsert_memory(memory: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, outcome): rows whose external_uuid is new (or null) are added; outcome: (external_uuid, id, inserted).

    Of incoming rows with one uuid the first in `order` counts. Null uuids never meet in the join.
    """
    rows, known = new_memory_rows(memory, incoming, order)
    return memory.unionByName(rows), rows.select("external_uuid", "id", F.lit(True).alias("inserted")).union(known)


def resolve_identity(df: DataFrame) -> DataFrame:
    """Platform given, else the client's name, else `unknown`; model likewise; subagent fields only of subagents."""
    sub = F.coalesce(F.col("subagent"), F.lit(False))
    return df.withColumns({
        "agent_platform": F.coalesce("agent_platform", "client_name", F.lit("unknown")), "agent_model": F.coalesce("agent_model", F.lit("unknown")),
        "subagent": sub, "subagent_model": F.when(sub, F.col("subagent_model")), "subagent_role": F.when(sub, F.col("subagent_role")),
    })


def validate_memory(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with `reasons`)."""
    role = F.nullif(F.lower(F.trim("subagent_role")), F.lit(""))
    d = df.withColumn("subagent_role", role).withColumn("subagent", F.coalesce("subagent", F.lit(False)))
    rules = {
        "user_id is null": F.col("user_id").isNull(),
        "agent_platform is null": F.col("agent_platform").isNull(),
        "message is null": F.col("message").isNull(),
        "role": ~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)),
        "subagent": ~F.col("subagent") & (F.col("subagent_model").isNotNull() | F.col("subagent_role").isNotNull()),
        "pinned and archived": F.coalesce("is_pinned", F.lit(False)) & F.col("archived_at").isNotNull(),
    }
    reasons = F.filter(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())), lambda x: x.isNotNull())
    d = d.withColumn("reasons", reasons)
    return d.where("size(reasons) = 0").drop("reasons"), d.where("size(reasons) > 0")


def apply_memory_changes(memory: DataFrame, changes: DataFrame, as_of: Column, keep_tag_processed: bool = False, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, statuses by seq) for an ordered log of (seq, user_id, action, memory_id, content).

    add: a pinned row of the user. update: new text, tag, vector and error cleared. remove: a soft delete that
    pinned rows are exempt from; it may be repeated. No change alters what decides another's status (owner and
    pin), so each status follows from the row as it was; an added row has no id that the log could name. Its id
    follows on top, memory's largest if None.
    """
    as_of = as_of.cast(memory.schema["created_at"].dataType)
    old = memory.select(F.col("id").alias("memory_id"), F.col("user_id").alias("_owner"), F.col("is_pinned").alias("_pinned"))
    c = changes.join(old, "memory_id", "left")
    empty = F.coalesce(F.col("content"), F.lit("")) == ""
    status = (
        F.when(F.col("action").isin("remove", "update") & F.col("memory_id").isNull(), "memory_id required")
        .when(F.col("action").isin("add", "update") & empty, "content required")
        .when(F.col("action") == "add", "added")
        .when(F.col("_owner").isNull(), "not found")
        .when(F.col("_owner") != F.col("user_id"), "another user")
        .when((F.col("action") == "remove") & F.col("_pinned"), "pinned")
        .when(F.col("action") == "remove", "removed")
        .when(F.col("action") == "update", "updated")
        .otherwise("unknown action")
    )
    judged = c.withColumn("status", status)
    last = judged.where("status in ('updated', 'removed')").groupBy(F.col("memory_id").alias("id")).agg(
        F.max_by("content", F.when(F.col("status") == "updated", F.col("seq"))).alias("_text"), F.count_if(F.col("status") == "updated").alias("_updates"),
        F.count_if(F.col("status") == "removed").alias("_removes"),
    )
    up, gone = F.coalesce(F.col("_updates") > 0, F.lit(False)), F.coalesce(F.col("_removes") > 0, F.lit(False))
    kind = {f.name: f.dataType for f in memory.schema.fields}
    out = memory.join(last, "id", "left").withColumns({
        "message": F.when(up, F.col("_text")).otherwise(F.col("message")),
        "embedding": F.when(~up, F.col("embedding")), "p_tag_id": F.when(~up, F.col("p_tag_id")), "cold_error": F.when(~up, F.col("cold_error")),
        "d_tag": F.when(up, F.array().cast(kind["d_tag"])).otherwise(F.col("d_tag")),
        "tag_processed": F.col("tag_processed") if keep_tag_processed else F.when(up, F.lit(False)).otherwise(F.col("tag_processed")),
        "is_active": F.when(gone, F.lit(False)).otherwise(F.col("is_active")), "archived_at": F.when(gone, as_of).otherwise(F.col("archived_at")),
        "updated_at": F.when(up | gone, as_of).otherwise(F.col("updated_at")),
    }).select(*memory.columns)
    top = memory.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top
    added = numbered(judged.where("status = 'added'").select("seq", "user_id", "content"), ["seq"], top)
    given = {
        "id": F.col("id"), "user_id": F.col("user_id"), "message": F.col("content"), "role": F.lit("user"), "is_pinned": F.lit(True), "is_active": F.lit(True),
        "agent_platform": F.lit("unknown"), "agent_model": F.lit("unknown"), "tag_processed": F.lit(False), "d_tag": F.array(), "created_at": as_of, "updated_at": as_of,
    }
    rows = added.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kind.items()))
    return out.unionByName(rows), judged.select("seq", "status")


def apply_profile_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """users with sub_profile after an ordered log of (seq, user_id, action, content): what was added since the last update or remove."""
    ok = changes.where("action = 'remove' or coalesce(content, '') <> ''")
    reset = ok.groupBy("user_id").agg(F.max(F.when(F.col("action").isin("update", "remove"), F.col("seq"))).alias("_reset"))
    since = ok.join(reset, "user_id").where("_reset is null or seq >= _reset")
    lines = since.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("action") != "remove", F.struct("seq", "content")))), lambda x: x["content"]).alias("_lines"), F.max("_reset").alias("_reset")
    )
    told = F.array_join("_lines", "\n")
    kept = F.when(F.col("_lines").isNull(), F.col("sub_profile")).when(
        F.col("_reset").isNull(), F.concat_ws("\n", F.nullif("sub_profile", F.lit("")), told)
    ).otherwise(F.nullif(told, F.lit("")))
    return users.join(lines, "user_id", "left").withColumn("sub_profile", kept).select(*users.columns)


def get_or_create_dim(dim: DataFrame, names: DataFrame, aliases: DataFrame | None = None, lower: bool = False) -> tuple[DataFrame, DataFrame]:
    """(dim, (name, id)): ids of names by unique name, created where absent. With `aliases` (name, root_id) an alias gives its root. Empty names are left out."""
    name = slug(F.col("name")) if lower else trim_all(F.col("name"))
    asked = names.select(name.alias("name")).where("name <> ''").distinct()
    new = asked.join(dim.select("name"), "name", "left_anti")
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = numbered(new, ["name"], top).select("id", "name")
    whole = dim.unionByName(made.select(*(F.col(c) if c in ("id", "name") else F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in dim.columns)))
    ids = whole.select("name", "id")
    if aliases is not None:
        roots = aliases.select("name", "root_id")
        ids = ids.join(roots, "name", "left").select("name", F.coalesce("root_id", "id").alias("id"))
    return whole, asked.join(ids, "name")


def upsert_models(models: DataFrame, incoming: DataFrame, deprecated: DataFrame) -> DataFrame:
    """(model_name, provider, metadata): inserted or updated by name; deprecated ones are stamped, never deleted."""
    fresh = incoming.select("model_name", F.col("provider").alias("_p"), F.col("metadata").alias("_m"))
    stamped = deprecated.select("model_name", F.lit(True).alias("_old")).distinct()
    joined = models.join(fresh, "model_name", "full").join(stamped, "model_name", "left")
    empty = F.create_map().cast("map<string,string>")
    keep = F.map_filter(F.coalesce("metadata", empty), lambda k, v: ~F.map_contains_key(F.coalesce(F.col("_m"), empty), k))
    merged = F.map_concat(keep, F.coalesce("_m", empty))
    done = F.map_concat(F.map_filter(merged, lambda k, v: k != "status"), F.create_map(F.lit("status"), F.lit("deprecated")))
    return joined.select("model_name", F.coalesce("_p", "provider", infer_provider(F.col("model_name"))).alias("provider"), F.when(F.col("_old"), done).otherwise(merged).alias("metadata"))


def backfill_memory(df: DataFrame) -> DataFrame:
    """tag_processed where a tag is set; platform and model from their older columns where null."""
    done = F.coalesce("tag_processed", F.lit(False)) | F.col("p_tag_id").isNotNull()
    return df.withColumns({"tag_processed": done, "agent_platform": F.coalesce("agent_platform", "platform"), "agent_model": F.coalesce("agent_model", "author_model")})
