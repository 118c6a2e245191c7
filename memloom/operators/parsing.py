"""Transcript lines to raw messages: one schema for three formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import TOOL_LOGS, external_uuid, filled, strip_noise, trim_all

RAW = ["path", "session_id", "pos", "role", "message", "agent_platform", "agent_model", "external_uuid"]


def _joined_text(content: Column, kind: str | None) -> Column:
    """A text, or the texts of a JSON array's blocks (of one kind) joined by line feeds."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.filter(blocks, lambda b: b["text"].isNotNull() & ((b["type"] == kind) if kind else F.lit(True)))
    joined = F.array_join(F.transform(texts, lambda b: b["text"]), "\n")
    return F.when(F.ltrim(content).startswith("[") & blocks.isNotNull(), joined).otherwise(content)


def parse_claude(lines: DataFrame) -> DataFrame:
    """RAW rows of (path, session_id, pos, byte_offset, line). A line without a uuid gets one from its place."""
    schema = "type string, isMeta boolean, uuid string, message struct<model:string,content:string>"
    e = lines.select("*", F.from_json("line", schema).alias("e")).where("e.type in ('user', 'assistant') and not coalesce(e.isMeta, false)")
    text = strip_noise(_joined_text(F.col("e.message.content"), "text"))
    made = F.sha2(F.concat_ws(":", "path", F.col("byte_offset").cast("string")), 256)
    rows = e.select(
        "path", "session_id", "pos", F.col("e.type").alias("role"), text.alias("message"), F.lit("claude-code").alias("agent_platform"),
        filled(F.col("e.message.model")).alias("agent_model"), external_uuid("claude-code", F.col("session_id"), F.coalesce("e.uuid", made)).alias("external_uuid"),
    )
    return rows.where("message is not null")


def _codex(lines: DataFrame) -> DataFrame:
    schema = "type string, payload struct<type:string,message:string,model:string>"
    return lines.select("*", F.from_json("line", schema).alias("e"))


def carry_forward_model(lines: DataFrame, segment: int = 8 << 20) -> DataFrame:
    """Codex lines with `carried`: the model named last at or before the line in its file, null if none was.

    A scan in two passes over segments of so many bytes: each gives the model that it names last, what a segment
    begins with is the last of those before it, and within segments a window fills in. So one long file is spread over tasks.
    """
    named = F.when(F.col("e.type") == "turn_context", F.col("e.payload.model"))
    rows = _codex(lines).select(*lines.columns, named.alias("_named"), F.expr(f"byte_offset div {segment}").alias("_segment"))
    ends = rows.groupBy("path", "_segment").agg(F.max_by("_named", F.when(F.col("_named").isNotNull(), F.col("byte_offset"))).alias("_named"))
    earlier = Window.partitionBy("path").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("path", "_segment", F.last("_named", ignorenulls=True).over(earlier).alias("_before"))
    upto = Window.partitionBy("path", "_segment").orderBy("byte_offset").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(ends, ["path", "_segment"], "left")
    return met.select(*lines.columns, F.coalesce(F.last("_named", ignorenulls=True).over(upto), "_before").alias("carried"))


def parse_codex(lines: DataFrame) -> DataFrame:
    """RAW rows; assistant messages take the model that carry_forward_model gives."""
    given = lines if "carried" in lines.columns else carry_forward_model(lines)
    kind = F.col("e.payload.type")
    role = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant")
    text = trim_all(F.col("e.payload.message"))
    log = reduce(lambda a, b: a | b, (F.col("message").startswith(p) for p in TOOL_LOGS))
    rows = _codex(given).where("e.type = 'event_msg'").select(
        "path", "session_id", "pos", role.alias("role"), filled(text).alias("message"), F.lit("codex-mcp-client").alias("agent_platform"),
        F.col("carried").alias("agent_model"), external_uuid("codex", F.col("session_id"), F.col("byte_offset")).alias("external_uuid"),
    )
    return rows.where(F.col("role").isNotNull() & F.col("message").isNotNull() & ~log)


def parse_gemini(messages: DataFrame) -> DataFrame:
    """RAW rows of (path, session_id, idx, message JSON); messages of other types, headers and updates fall out."""
    schema = "id string, type string, content string, model string"
    e = messages.select("path", "session_id", "idx", F.from_json("message", schema).alias("e"))
    role = F.when(F.col("e.type") == "user", "user").when(F.col("e.type") == "gemini", "assistant")
    key = F.coalesce(filled(F.col("e.id")), F.concat_ws("-", "session_id", F.col("idx").cast("string")))
    rows = e.select(
        "path", "session_id", F.col("idx").alias("pos"), role.alias("role"), filled(trim_all(_joined_text(F.col("e.content"), None))).alias("message"),
        F.lit("gemini-cli-mcp-client").alias("agent_platform"), F.when(role == "assistant", F.col("e.model")).alias("agent_model"),
        external_uuid("gemini", F.col("session_id"), key).alias("external_uuid"),
    )
    return rows.where("role is not null and message is not null and not startswith(message, 'System:') and message <> 'Please continue.'")


def gemini_lines(lines: DataFrame) -> DataFrame:
    """Messages of the line-by-line session form, numbered by line, without header and `$set` lines."""
    own = F.from_json("line", "sessionId string, type string")
    skip = ((F.col("pos") == 0) & F.coalesce(own["sessionId"] != "", F.lit(False))) | F.get_json_object("line", "$['$set']").isNotNull()
    return lines.where(~skip).select("path", "session_id", F.col("pos").alias("idx"), F.col("line").alias("message"))


def platform_of_session(sessions: DataFrame, threads: DataFrame) -> DataFrame:
    """sessions with agent_platform by the thread's source; threads: (id, source)."""
    #: Platforms by source.
    names = {"cli": "codex-cli", "vscode": "codex-desktop", "mcp": "codex-mcp", "exec": "codex-exec"}
    found = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.trim("source")]
    one = threads.groupBy("id").agg(F.min("source").alias("source")).select(F.col("id").alias("session_id"), found.alias("_platform"))
    joined = sessions.drop("agent_platform").join(one, "session_id", "left")
    return joined.select(*[c for c in sessions.columns if c != "agent_platform"], F.coalesce("_platform", F.lit("codex-mcp-client")).alias("agent_platform"))


def normalize_messages(*parsed: DataFrame, device_name: str | None = None) -> DataFrame:
    """One table of raw messages: users have no model, assistants one or `unknown`."""
    rows = reduce(DataFrame.unionByName, (p.select(*RAW) for p in parsed))
    model = F.when(F.col("role") == "assistant", F.coalesce("agent_model", F.lit("unknown")))
    return rows.withColumn("agent_model", model).withColumn("device_name", F.lit(device_name).cast("string"))


def capture_report(lines: DataFrame, parsed: DataFrame, written: DataFrame) -> DataFrame:
    """(path, inserted, skipped, dedup) by file.

    lines: (path, line) of the pass, of which lines with a model, headers and updates count as none;
    parsed: (path, ...) messages before dedup; written: (path, ...) rows that were new.
    """
    own = F.from_json("line", "type string, sessionId string, payload struct<model:string>")
    none = ((own["type"] == "turn_context") & own["payload"]["model"].isNotNull()) | F.get_json_object("line", "$['$set']").isNotNull() | (own["sessionId"].isNotNull() & own["type"].isNull())
    # All three are tagged and counted in one aggregation: one shuffle of partial counts.
    tag = lambda df, name: df.select("path", F.lit(name).alias("what"))
    every = tag(lines.where(~F.coalesce(none, F.lit(False))), "line").union(tag(parsed, "parsed")).union(tag(written, "written"))
    n = lambda name: F.count_if(F.col("what") == name)
    return every.groupBy("path").agg(n("written").alias("inserted"), (n("line") - n("parsed")).alias("skipped"), (n("parsed") - n("written")).alias("dedup"))
