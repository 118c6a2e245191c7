"""All registered queries of the library's own operators, and their SQL.

Each applies one operator to the whole of the given tables, or of views over them, and returns columns of
plain values: lists are joined by commas, long texts are given by their MD5.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import brief, diagnostics, enrich, evaluate, lifecycle, parsing, profile, search, skills, tags, trigrams, writes
from memloom.plans.fixtures import AS_OF, FACTS_AS_OF, Data, oracle
from memloom.sources import keyed
from memloom.sources import transcripts as tr
from memloom.sources.appended import write_files
from memloom.sources.shared import fresh_path, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}
UUID36 = "concat('00000000-0000-0000-0000-', lpad(CAST(session_no AS STRING), 12, '0'))"


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        name = f.__name__.removeprefix("q_")
        _QUERIES[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            _ORACLE[name] = oracle(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def md5(c: str) -> Column:
    return F.md5(F.col(c)).alias(c)


# ---- sources ----------------------------------------------------------------


def whole_files(lines: DataFrame, path: str, ends: str = "\n") -> DataFrame:
    """(path, text): one transcript a session."""
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("session_no").agg(F.concat(listed, F.lit(ends)).alias("text")).select(F.expr(path).alias("path"), "text")


CLAUDE_PATH = "concat('/t/', CAST(session_no AS STRING), '.jsonl')"
CODEX_PATH = f"concat('/t/rollout-2024-01-01-', {UUID36}, '.jsonl')"


def claude(d: Data) -> DataFrame:
    return tr.split_lines(whole_files(d.claude_lines, CLAUDE_PATH)).withColumn("session_id", tx.session_id_of(F.col("path"), "claude"))


def codex(d: Data) -> DataFrame:
    return tr.split_lines(whole_files(d.codex_lines, CODEX_PATH)).withColumn("session_id", tx.session_id_of(F.col("path"), "codex"))


def gemini_files(d: Data) -> DataFrame:
    row = F.struct(F.when(F.col("role") == "user", "user").otherwise("gemini").alias("type"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("g"), F.col("turn"))).alias("id"), F.col("message").alias("content"))
    rows = d.turns.withColumn("line", F.to_json(row)).groupBy("session_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), ",").alias("l"))
    text = F.concat(F.lit('{"sessionId":"g'), F.col("session_no").cast("string"), F.lit('","messages":['), F.col("l"), F.lit("]}"))
    return rows.select(F.concat(F.lit("/g/session-x-"), F.hex("session_no"), F.lit(".json")).alias("path"), text.alias("text"))


_OFFSETS = """SELECT {path} AS path, session_no, turn, line, row_number() OVER w - 1 AS pos, CAST(sum(strlen(line) + 1) OVER w - strlen(line) - 1 AS BIGINT) AS byte_offset
FROM {lines} WINDOW w AS (PARTITION BY session_no ORDER BY turn)"""
CLAUDE_AT = _OFFSETS.format(path=CLAUDE_PATH, lines="claude_lines")
CODEX_AT = _OFFSETS.format(path=CODEX_PATH, lines="codex_lines")


@_query(f"SELECT path, CAST(session_no AS VARCHAR) AS session_id, pos, byte_offset, md5(line) AS line FROM ({CLAUDE_AT})")
def q_read_jsonl_lines(d: Data) -> DataFrame:
    """Lines of transcripts that end in a half-written one, which is held back."""
    lines = tr.split_lines(whole_files(d.claude_lines, CLAUDE_PATH, '\n\n{"type":"us').select("path", "text"))
    return lines.select("path", tx.session_id_of(F.col("path"), "claude").alias("session_id"), F.col("pos").cast("long").alias("pos"), "byte_offset", md5("line"))


@_query("SELECT concat('g', CAST(session_no AS VARCHAR)) AS session_id, row_number() OVER (PARTITION BY session_no ORDER BY turn) - 1 AS idx, md5(message) AS content FROM turns")
def q_read_session_json(d: Data) -> DataFrame:
    rows = tr.explode_sessions(gemini_files(d))
    return rows.select("session_id", F.col("idx").cast("long").alias("idx"), F.md5(F.get_json_object("message", "$.content")).alias("content"))


@_query(f"SELECT DISTINCT session_no, CAST(session_no AS VARCHAR) AS claude, {UUID36} AS codex, concat('g', CAST(session_no AS VARCHAR)) AS gemini, lower(hex(session_no)) AS short FROM turns")
def q_session_id_of(d: Data) -> DataFrame:
    s = d.turns.select("session_no").distinct()
    short = F.concat(F.lit("/g/session-x-"), F.lower(F.hex("session_no")), F.lit(".jsonl"))
    return s.select(
        "session_no", tx.session_id_of(F.expr(CLAUDE_PATH), "claude").alias("claude"), tx.session_id_of(F.expr(CODEX_PATH), "codex").alias("codex"),
        tx.session_id_of(short, "gemini", F.concat(F.lit("g"), F.col("session_no").cast("string"))).alias("gemini"), tx.session_id_of(short, "gemini").alias("short"),
    )


@_query(f"""WITH l AS ({CLAUDE_AT}), c AS (SELECT path, byte_offset AS cursor FROM l WHERE pos = 3 AND session_no % 2 = 0)
SELECT l.path, count(*) FILTER (byte_offset >= coalesce(c.cursor, 0)) AS n_new, max(byte_offset + strlen(line) + 1) AS cursor FROM l LEFT JOIN c ON c.path = l.path GROUP BY l.path""")
def q_delta_lines(d: Data) -> DataFrame:
    lines = claude(d)
    cursors = lines.where("pos = 3 and cast(session_id as long) % 2 = 0").select("path", F.col("byte_offset").alias("cursor"))
    new, after = tr.delta_lines(lines, cursors)
    return after.join(new.groupBy("path").agg(F.count("*").alias("n_new")), "path", "left").select("path", F.coalesce("n_new", F.lit(0)).alias("n_new"), "cursor")


@_query(f"""SELECT {CLAUDE_PATH} AS path, CASE WHEN session_no >= 11 THEN CAST(0 AS BIGINT) ELSE CAST(sum(strlen(line) + 1) AS BIGINT) END AS cursor FROM claude_lines GROUP BY session_no""")
def q_initial_cursors(d: Data) -> DataFrame:
    """Files born a second apart; capture starts 15 seconds after the first, so those of its last 5 seconds are new."""
    files = whole_files(d.claude_lines, CLAUDE_PATH)
    born = F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), tx.session_id_of(F.col("path"), "claude").cast("int"))
    return tr.initial_cursors(files.select("path", F.octet_length("text").alias("length"), born.alias("modificationTime")), AS_OF + dt.timedelta(seconds=16))


@_query("SELECT id, user_id, role, message, created_at FROM mem WHERE created_at >= TIMESTAMP '2024-01-20 12:00:00'")
def q_memory_table(d: Data) -> DataFrame:
    """Written by day and read back from a date on."""
    path = fresh_path(d.spark)
    tr.write_memory(d.mem.select("id", "user_id", "role", "message", "created_at"), path)
    return tr.read_memory(d.spark, path, dt.datetime(2024, 1, 20, 12))


# ---- parsing ----------------------------------------------------------------

_CLAUDE_OUT = """SELECT CAST(session_no AS VARCHAR) AS session_id, role, md5(trim(message, chr(32) || chr(9) || chr(10) || chr(13))) AS message, concat('m', CAST(session_no % 3 AS VARCHAR)) AS agent_model,
 concat('claude-code:', CAST(session_no AS VARCHAR), ':u', CAST(turn AS VARCHAR)) AS external_uuid FROM turns WHERE turn % 7 <> 5 AND trim(message) <> ''"""


@_query(_CLAUDE_OUT)
def q_parse_claude(d: Data) -> DataFrame:
    return parsing.parse_claude(claude(d)).select("session_id", "role", md5("message"), "agent_model", "external_uuid")


_NOISE = ["system-reminder", "command-name", "hook-left-alone", "session-end-hook"]


@_query("""SELECT id, md5(CASE WHEN id % 4 = 2 THEN concat(trim(message), ' <hook-left-alone>x', chr(10), 'y</hook-left-alone>') WHEN id % 9 = 0 THEN NULL ELSE trim(message) END) AS message FROM turns""")
def q_strip_noise(d: Data) -> DataFrame:
    tag = F.element_at(F.array(*map(F.lit, _NOISE)), (F.col("id") % 4 + 1).cast("int"))
    wrapped = F.concat(F.trim("message"), F.lit(" <"), tag, F.lit(">x\ny</"), tag, F.lit(">"))
    given = F.when((F.col("id") % 9 == 0) & (F.col("id") % 4 != 2), F.lit(tx.INTERRUPTED[1])).otherwise(wrapped)
    return d.turns.select("id", F.md5(tx.strip_noise(given)).alias("message"))


_CODEX_OUT = f"""SELECT {UUID36} AS session_id, CASE WHEN line LIKE '%"user_message"%' THEN 'user' ELSE 'assistant' END AS role, byte_offset, turn FROM ({CODEX_AT}) WHERE turn % 2 = 0"""


@_query(f"SELECT session_id, role, concat('codex:', session_id, ':', CAST(byte_offset AS VARCHAR)) AS external_uuid FROM ({_CODEX_OUT})")
def q_parse_codex(d: Data) -> DataFrame:
    return parsing.parse_codex(codex(d)).select("session_id", "role", "external_uuid")


@_query(f"""SELECT {UUID36} AS session_id, byte_offset,
 last_value(CASE WHEN turn % 2 = 1 THEN concat('m', CAST((turn + 1) // 2 AS VARCHAR)) END IGNORE NULLS) OVER (PARTITION BY session_no ORDER BY turn) AS carried FROM ({CODEX_AT})""")
def q_carry_forward_model(d: Data) -> DataFrame:
    return parsing.carry_forward_model(codex(d)).select("session_id", "byte_offset", "carried")


@_query("""SELECT concat('g', CAST(session_no AS VARCHAR)) AS session_id, role, md5(trim(message, chr(32) || chr(9) || chr(10) || chr(13))) AS message,
 concat('gemini:g', CAST(session_no AS VARCHAR), ':', CASE WHEN turn % 2 = 1 THEN concat('g', CAST(turn AS VARCHAR)) ELSE concat('g', CAST(session_no AS VARCHAR), '-', CAST(n AS VARCHAR)) END) AS external_uuid
FROM (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY turn) - 1 AS n FROM turns)""")
def q_parse_gemini(d: Data) -> DataFrame:
    return parsing.parse_gemini(tr.explode_sessions(gemini_files(d))).select("session_id", "role", md5("message"), "external_uuid")


@_query("""SELECT DISTINCT session_no, CASE session_no % 6 WHEN 0 THEN 'codex-cli' WHEN 1 THEN 'codex-desktop' WHEN 2 THEN 'codex-mcp' WHEN 3 THEN 'codex-exec' ELSE 'codex-mcp-client' END AS agent_platform FROM turns""")
def q_platform_of_session(d: Data) -> DataFrame:
    s = d.turns.select("session_no", F.col("session_no").cast("string").alias("session_id")).distinct()
    source = F.element_at(F.array(*map(F.lit, ["cli", "vscode", "mcp", "exec", "other"])), (F.col("session_no") % 6 + 1).cast("int"))
    threads = s.where("session_no % 6 <> 5").select(F.col("session_id").alias("id"), source.alias("source"))
    return parsing.platform_of_session(s, threads).select("session_no", "agent_platform")


@_query("SELECT id, concat('gemini:', CAST(session_no AS VARCHAR), ':', CASE WHEN id % 3 <> 0 THEN CAST(id AS VARCHAR) END) AS joined, CASE WHEN id % 3 <> 0 THEN concat('gemini:', CAST(session_no AS VARCHAR), ':', CAST(id AS VARCHAR)) END AS uuid FROM turns")
def q_external_uuid(d: Data) -> DataFrame:
    key = F.when(F.col("id") % 3 != 0, F.col("id"))
    sid = F.col("session_no").cast("string")
    return d.turns.select("id", F.concat_ws("", F.lit("gemini:"), sid, F.lit(":"), key.cast("string")).alias("joined"), tx.external_uuid("gemini", sid, key).alias("uuid"))


_TRIMMED = "trim({0}, chr(32) || chr(9) || chr(10) || chr(13))"
_CARRIED = "last_value(CASE WHEN turn % 2 = 1 THEN concat('m', CAST((turn + 1) // 2 AS VARCHAR)) END IGNORE NULLS) OVER (PARTITION BY session_no ORDER BY turn)"
_GEMINI_OUT = f"""SELECT *, row_number() OVER (PARTITION BY role, message ORDER BY concat('session-x-', hex(session_no), '.json/'), n) AS said FROM (
  SELECT session_no, turn, role, {_TRIMMED.format("message")} AS message, row_number() OVER (PARTITION BY session_no ORDER BY turn) - 1 AS n FROM turns) WHERE message <> ''"""


def _parsed(codex_platform: str, gemini: str) -> str:
    """SQL of all messages in the three formats; gemini: which of equal texts count."""
    return f"""SELECT session_id, role, message, CASE WHEN role = 'assistant' THEN agent_model END AS agent_model, 'claude-code' AS agent_platform, external_uuid FROM ({_CLAUDE_OUT})
UNION ALL SELECT session_id, role, md5(message), CASE WHEN role = 'assistant' THEN coalesce(carried, 'unknown') END, {codex_platform}, concat('codex:', session_id, ':', CAST(byte_offset AS VARCHAR)) FROM (
 SELECT *, {UUID36} AS session_id, CASE WHEN line LIKE '%"user_message"%' THEN 'user' ELSE 'assistant' END AS role, {_TRIMMED.format("json_extract_string(line, '$.payload.message')")} AS message, {_CARRIED} AS carried FROM ({CODEX_AT})) WHERE turn % 2 = 0 AND message <> ''
UNION ALL SELECT concat('g', CAST(session_no AS VARCHAR)), role, md5(message), CASE WHEN role = 'assistant' THEN 'unknown' END, 'gemini-cli-mcp-client',
 concat('gemini:g', CAST(session_no AS VARCHAR), ':', CASE WHEN turn % 2 = 1 THEN concat('g', CAST(turn AS VARCHAR)) ELSE concat('g', CAST(session_no AS VARCHAR), '-', CAST(n AS VARCHAR)) END) FROM ({_GEMINI_OUT}) WHERE {gemini}"""


@_query(f"SELECT *, 'box' AS device_name FROM ({_parsed(chr(39) + 'codex-mcp-client' + chr(39), 'TRUE')})")
def q_normalize_messages(d: Data) -> DataFrame:
    rows = parsing.normalize_messages(parsing.parse_claude(claude(d)), parsing.parse_codex(codex(d)), parsing.parse_gemini(tr.explode_sessions(gemini_files(d))), device_name="box")
    return rows.select("session_id", "role", md5("message"), "agent_model", "agent_platform", "external_uuid", "device_name")


@_query(f"""SELECT {CLAUDE_PATH} AS path, count(*) FILTER (turn % 7 <> 5 AND turn % 4 <> 3) AS inserted, count(*) FILTER (turn % 7 = 5) AS skipped,
 count(*) FILTER (turn % 7 <> 5 AND turn % 4 = 3) AS dedup FROM claude_lines GROUP BY session_no""")
def q_capture_report(d: Data) -> DataFrame:
    """Every fourth message of a session counts as known already."""
    lines = claude(d)
    parsed = parsing.parse_claude(lines)
    return parsing.capture_report(lines, parsed, parsed.where("cast(substring(substring_index(external_uuid, ':', -1), 2) as int) % 4 <> 3"))


# ---- dedup, validation, writes ----------------------------------------------

_AGAIN = "SELECT *, 0 AS again FROM turns UNION ALL SELECT *, 1 FROM turns WHERE id % 7 = 0"


def again(d: Data) -> DataFrame:
    return d.turns.withColumn("again", F.lit(0)).union(d.turns.where("id % 7 = 0").withColumn("again", F.lit(1)))


@_query(f"SELECT session_no, id, again FROM (SELECT *, row_number() OVER (PARTITION BY session_no, role, message ORDER BY again, turn) AS r FROM ({_AGAIN})) WHERE r = 1")
def q_dedup_content(d: Data) -> DataFrame:
    return writes.dedup_content(again(d), ["session_no"], ["again", "turn"]).select("session_no", "id", "again")


_INCOMING = """SELECT id AS src, CASE WHEN id % 4 <> 3 THEN concat('ext:', CAST(id % (SELECT max(event_id) * 2 FROM events) AS VARCHAR)) END AS external_uuid FROM turns"""


_UPSERTED = f"""WITH i AS ({_INCOMING}), one AS (SELECT external_uuid, min(src) AS src FROM i WHERE external_uuid IS NOT NULL GROUP BY 1),
 new AS (SELECT src, external_uuid FROM one WHERE external_uuid NOT IN (SELECT external_uuid FROM mem WHERE external_uuid IS NOT NULL) UNION ALL SELECT src, NULL FROM i WHERE external_uuid IS NULL)
SELECT external_uuid, (SELECT max(id) FROM mem) + row_number() OVER (ORDER BY src) AS id, TRUE AS inserted FROM new
UNION ALL SELECT one.external_uuid, mem.id, FALSE FROM one JOIN mem USING (external_uuid)"""


def incoming(d: Data) -> DataFrame:
    top = d.events.agg(F.max("event_id") * 2).first()[0]
    uuid = F.when(F.col("id") % 4 != 3, F.concat(F.lit("ext:"), (F.col("id") % top).cast("string")))
    return d.turns.select(F.col("id").alias("src"), "user_id", "role", "message", "created_at", uuid.alias("external_uuid"))


@_query(_UPSERTED)
def q_upsert_memory(d: Data) -> DataFrame:
    return writes.upsert_memory(d.mem, incoming(d), ["src"])[1]


@_query(_UPSERTED)
def q_upsert_keyed(d: Data) -> DataFrame:
    """On the stored table in buckets by uuid."""
    name = f"memory_{fresh_path(d.spark)[-32:]}"
    keyed.save_keyed(d.mem, name)
    outcome = keyed.upsert_keyed(d.spark, name, incoming(d), ["src"])
    d.spark.sql(f"DROP TABLE {name}")  # of the catalog; what was written stays
    return outcome


@_query("""SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN agent_platform END, CASE WHEN id % 5 < 3 THEN 'client' END, 'unknown') AS agent_platform, coalesce(agent_model, 'unknown') AS agent_model,
 id % 4 = 0 AS subagent, CASE WHEN id % 4 = 0 THEN 'sm' END AS subagent_model, CASE WHEN id % 4 = 0 AND id % 3 = 1 THEN 'helper' END AS subagent_role FROM mem""")
def q_resolve_identity(d: Data) -> DataFrame:
    given = d.mem.select(
        "id", F.expr("case when id % 3 = 0 then agent_platform end as agent_platform"), F.expr("case when id % 5 < 3 then 'client' end as client_name"), "agent_model",
        F.expr("case when id % 2 = 0 then id % 4 = 0 end as subagent"), F.lit("sm").alias("subagent_model"), F.expr("case when id % 3 = 1 then 'helper' end as subagent_role"),
    )
    return writes.resolve_identity(given).drop("client_name")


@_query("""SELECT id, coalesce(array_to_string(list_filter([CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN id % 3 = 0 THEN 'subagent' END, CASE WHEN id % 10 = 0 THEN 'pinned and archived' END], lambda x: x IS NOT NULL), ','), '') AS reasons
FROM (SELECT conv_id * 1000 + turn AS id, role FROM conversations)""")
def q_validate_memory(d: Data) -> DataFrame:
    rows = d.conversations.selectExpr(
        "conv_id * 1000 + turn as id", "conv_id as user_id", "'x' as agent_platform", "role", "text as message", "false as subagent", "cast(null as string) as subagent_model",
        "case when (conv_id * 1000 + turn) % 3 = 0 then ' Helper ' else '  ' end as subagent_role", "(conv_id * 1000 + turn) % 5 = 0 as is_pinned",
        "case when (conv_id * 1000 + turn) % 2 = 0 then timestamp_ntz '2024-01-01 00:00:00' end as archived_at",
    )
    valid, rejected = writes.validate_memory(rows)
    return rejected.select("id", F.array_join("reasons", ",").alias("reasons")).union(valid.select("id", F.lit("")))


_CHANGES = """SELECT event_id AS seq, CASE WHEN event_id % 5 = 4 THEN user_id + 1 ELSE user_id END AS user_id, CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'remove' ELSE 'update' END AS action,
 CASE WHEN event_id % 4 = 0 OR event_id % 19 = 0 THEN NULL WHEN event_id % 29 = 0 THEN -event_id ELSE event_id - event_id % 3 END AS memory_id, CASE WHEN event_id % 31 <> 0 THEN concat('text ', CAST(event_id AS STRING)) END AS content FROM events"""
_STATUS = f"""SELECT c.*, CASE WHEN action IN ('remove', 'update') AND memory_id IS NULL THEN 'memory_id required' WHEN action IN ('add', 'update') AND content IS NULL THEN 'content required'
 WHEN action = 'add' THEN 'added' WHEN m.id IS NULL THEN 'not found' WHEN m.user_id <> c.user_id THEN 'another user' WHEN action = 'remove' AND m.is_pinned THEN 'pinned' WHEN action = 'remove' THEN 'removed' ELSE 'updated' END AS status
FROM ({_CHANGES}) c LEFT JOIN mem m ON m.id = c.memory_id"""


def changes(d: Data) -> DataFrame:
    return d.spark.sql(_CHANGES.replace("FROM events", "FROM {events}"), events=d.events)


@_query(f"SELECT seq, status FROM ({_STATUS})")
def q_memory_change_status(d: Data) -> DataFrame:
    return writes.apply_memory_changes(d.mem, changes(d), now())[1]


_CHANGED = f"""WITH s AS ({_STATUS}), u AS (SELECT memory_id, arg_max(content, seq) FILTER (status = 'updated') AS t, count(*) FILTER (status = 'updated') AS up, count(*) FILTER (status = 'removed') AS gone FROM s WHERE status IN ('updated', 'removed') GROUP BY 1)
SELECT mem.id, mem.user_id, coalesce(t, message) AS message, CASE WHEN coalesce(up, 0) = 0 THEN p_tag_id END AS p_tag_id, CASE WHEN coalesce(up, 0) = 0 THEN cold_error END AS cold_error,
 CASE WHEN up > 0 THEN FALSE ELSE tag_processed END AS tag_processed, CASE WHEN gone > 0 THEN FALSE ELSE is_active END AS is_active, is_pinned FROM mem LEFT JOIN u ON u.memory_id = mem.id
UNION ALL SELECT (SELECT max(id) FROM mem) + row_number() OVER (ORDER BY seq), user_id, content, NULL, NULL, FALSE, TRUE, TRUE FROM s WHERE status = 'added'"""


@_query(_CHANGED)
def q_apply_memory_changes(d: Data) -> DataFrame:
    return writes.apply_memory_changes(d.mem, changes(d), now())[0].select("id", "user_id", "message", "p_tag_id", "cold_error", "tag_processed", "is_active", "is_pinned")


@_query(_CHANGED)
def q_change_stored(d: Data) -> DataFrame:
    """On the table stored by day, of which the days that changed are written; the days of added rows come new."""
    path = fresh_path(d.spark)
    tr.write_memory(d.mem, path)
    keyed.change_stored(d.spark, path, changes(d), now())
    return tr.read_memory(d.spark, path).select("id", "user_id", "message", "p_tag_id", "cold_error", "tag_processed", "is_active", "is_pinned")


_PROFILE = "SELECT event_id AS seq, user_id, CASE WHEN event_id % 97 = 0 THEN 'update' WHEN event_id % 151 = 0 THEN 'remove' ELSE 'add' END AS action, CASE WHEN event_id % 11 <> 0 THEN concat('line ', CAST(event_id AS STRING)) END AS content FROM events"


@_query(f"""WITH c AS (SELECT * FROM ({_PROFILE}) WHERE action = 'remove' OR content IS NOT NULL), r AS (SELECT user_id, max(seq) FILTER (action <> 'add') AS reset FROM c GROUP BY 1),
 l AS (SELECT c.user_id, string_agg(content, chr(10) ORDER BY seq) FILTER (action <> 'remove') AS told, any_value(reset) AS reset FROM c JOIN r USING (user_id) WHERE reset IS NULL OR seq >= reset GROUP BY 1)
SELECT p.user_id, CASE WHEN l.user_id IS NULL THEN p.sub_profile WHEN l.reset IS NULL THEN concat_ws(chr(10), p.sub_profile, told) ELSE told END AS sub_profile FROM people p LEFT JOIN l ON l.user_id = p.user_id""")
def q_apply_profile_changes(d: Data) -> DataFrame:
    log = d.spark.sql(_PROFILE.replace("FROM events", "FROM {events}"), events=d.events)
    return writes.apply_profile_changes(d.people, log).select("user_id", "sub_profile")


@_query("""WITH wanted AS (SELECT DISTINCT lower(trim(c_name)) AS name FROM (SELECT concat(' TAG-', CAST(c_custkey + 20 AS STRING), ' ') AS c_name FROM customer)), new AS (SELECT name FROM wanted WHERE name NOT IN (SELECT name FROM forest))
SELECT name, coalesce(f.id, n.id) AS id FROM wanted LEFT JOIN forest f USING (name) LEFT JOIN (SELECT name, (SELECT max(id) FROM forest) + row_number() OVER (ORDER BY name) AS id FROM new) n USING (name)""")
def q_get_or_create_dim(d: Data) -> DataFrame:
    names = d.customer.select(F.concat(F.lit(" TAG-"), (F.col("c_custkey") + 20).cast("string"), F.lit(" ")).alias("name"))
    return writes.get_or_create_dim(d.forest, names, lower=True)[1]


_MODEL = "concat(CASE id % 4 WHEN 0 THEN 'gpt-' WHEN 1 THEN 'gemini-' WHEN 2 THEN 'grok-' ELSE 'other-' END, CAST(id AS STRING))"


@_query(f"""WITH m AS (SELECT {_MODEL} AS model_name, id FROM forest)
SELECT model_name, CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN 'given' WHEN id % 4 = 0 THEN 'openai' WHEN id % 4 = 1 THEN 'google' WHEN id % 4 = 2 THEN 'xai' END AS provider,
 CASE WHEN id % 5 = 0 THEN 'deprecated' END AS status, CASE WHEN id % 3 <> 0 THEN 'new' WHEN id % 3 = 0 THEN 'old' END AS note FROM m""")
def q_upsert_models(d: Data) -> DataFrame:
    name = F.expr(_MODEL).alias("model_name")
    old = d.forest.where("id % 3 <= 1").select(name, F.lit(None).cast("string").alias("provider"), F.create_map(F.lit("note"), F.lit("old")).alias("metadata"))
    new = d.forest.where("id % 3 <> 0").select(name, F.expr("case when id % 2 = 0 then 'given' end").alias("provider"), F.create_map(F.lit("note"), F.lit("new")).alias("metadata"))
    out = writes.upsert_models(old, new, d.forest.where("id % 5 = 0").select(name))
    return out.select("model_name", "provider", F.col("metadata")["status"].alias("status"), F.col("metadata")["note"].alias("note"))


@_query("SELECT id, tag_processed OR p_tag_id IS NOT NULL AS tag_processed, CASE WHEN id % 2 = 0 THEN 'old' ELSE agent_platform END AS agent_platform, coalesce(agent_model, 'author') AS agent_model FROM mem")
def q_backfill_memory(d: Data) -> DataFrame:
    rows = d.mem.withColumn("agent_platform", F.expr("case when id % 2 = 1 then agent_platform end")).withColumns({"platform": F.lit("old"), "author_model": F.lit("author")})
    return writes.backfill_memory(rows).select("id", "tag_processed", "agent_platform", "agent_model")


# ---- enrichment -------------------------------------------------------------

_PENDING = """SELECT *, NOT tag_processed AS needs_tag, embedding IS NULL AS needs_embed FROM mem WHERE (embedding IS NULL OR NOT tag_processed) AND
 (cold_error IS NULL OR updated_at < TIMESTAMP '2024-01-20 00:00:00' - CASE WHEN is_active THEN INTERVAL 5 MINUTE ELSE INTERVAL 1 HOUR END)"""


@_query(f"SELECT id, needs_tag, needs_embed, is_active FROM ({_PENDING}) ORDER BY is_active DESC, created_at, id LIMIT 200")
def q_claim_pending(d: Data) -> DataFrame:
    return enrich.claim_pending(d.mem, F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz"), 200).select("id", "needs_tag", "needs_embed", "is_active")


@_query("SELECT id, name FROM forest WHERE alias_of IS NULL ORDER BY id LIMIT 20")
def q_tag_candidates(d: Data) -> DataFrame:
    return enrich.tag_candidates(d.forest)


@_query("""SELECT id, concat('candidates: ', (SELECT string_agg(name, ', ' ORDER BY id) FROM tags WHERE alias_of IS NULL), chr(10), 'role=', role, chr(10), 'message: ', message) AS prompt FROM mem WHERE NOT tag_processed""")
def q_build_tag_prompts(d: Data) -> DataFrame:
    return enrich.build_tag_prompts(d.mem.where("not tag_processed"), enrich.tag_candidates(d.tags))


_PARSED = """WITH new AS (SELECT name, 8 + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT concat('proj-', CAST(session_no % 9 AS STRING)) AS name FROM turns WHERE id % 5 = 1)),
 parsed AS (SELECT t.id, CASE t.id % 5 WHEN 0 THEN 1 WHEN 1 THEN new.id WHEN 3 THEN 2 END AS p_tag_id, CASE t.id % 5 WHEN 0 THEN 'k1,two' WHEN 2 THEN 'x' WHEN 3 THEN 'y' ELSE '' END AS d_tag, CASE WHEN t.id % 5 = 4 THEN 'invalid JSON: {"p_tag": ' END AS error
 FROM turns t LEFT JOIN new ON new.name = concat('proj-', CAST(session_no % 9 AS STRING)))"""


@_query(_PARSED + " SELECT id, p_tag_id, d_tag, error FROM parsed")
def q_parse_tag_output(d: Data) -> DataFrame:
    out, _ = enrich.parse_tag_output(d.replies.select("id", "raw"), d.tags, tags.resolve_aliases(d.tags))
    return out.select("id", F.col("p_tag_id").cast("long").alias("p_tag_id"), F.array_join("d_tag", ",").alias("d_tag"), "error")


@_query("""SELECT id, CASE WHEN needs_tag AND id % 4 <> 0 THEN 3 END AS p_tag_id, needs_tag AND id % 4 <> 0 AS tag_processed, needs_embed AND id % 6 <> 0 AS embedded,
 CASE WHEN needs_tag AND id % 4 = 0 AND needs_embed AND id % 6 = 0 THEN 'tag+embed both failed: tag=quota embed=timeout' WHEN needs_tag AND id % 4 = 0 THEN 'tag: quota' WHEN needs_embed AND id % 6 = 0 THEN 'embed: timeout' END AS cold_error
FROM (SELECT id, NOT tag_processed AS needs_tag, embedding IS NULL AS needs_embed FROM mem WHERE embedding IS NULL OR NOT tag_processed)""")
def q_merge_outcomes(d: Data) -> DataFrame:
    pending = d.mem.where("embedding is null or not tag_processed").select("id", (~F.col("tag_processed")).alias("needs_tag"), F.col("embedding").isNull().alias("needs_embed"))
    t = pending.selectExpr("id", "case when id % 4 <> 0 then 3 end as p_tag_id", "case when id % 4 <> 0 then array('d') end as d_tag", "case when id % 4 = 0 then 'quota' end as error")
    e = pending.selectExpr("id", "case when id % 6 <> 0 then array(1.0f) end as embedding", "case when id % 6 = 0 then 'timeout' end as error")
    out = enrich.merge_outcomes(pending, t, e)
    return out.select("id", "p_tag_id", "tag_processed", F.col("embedding").isNotNull().alias("embedded"), "cold_error")


@_query("SELECT doc_id AS id, md5(substr(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), 1, 8000)) AS input FROM documents")
def q_prepare_embedding_input(d: Data) -> DataFrame:
    return enrich.prepare_embedding_input(d.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("message"))).select("id", md5("input"))


@_query("SELECT vec_id AS id, vec_id % 9 <> 0 AS kept, CASE WHEN vec_id % 9 = 0 THEN 'embedding has 63 values, not 64' END AS error FROM embeddings")
def q_check_embedding(d: Data) -> DataFrame:
    given = d.embeddings.select(F.col("vec_id").alias("id"), F.expr("case when vec_id % 9 = 0 then slice(embedding, 1, 63) else embedding end as embedding"))
    return enrich.check_embedding(given, 64).select("id", F.col("embedding").isNotNull().alias("kept"), "error")


# ---- tags -------------------------------------------------------------------


@_query("""WITH RECURSIVE chain AS (SELECT name, id, id AS top, alias_of FROM forest UNION ALL SELECT c.name, c.id, f.id, f.alias_of FROM chain c JOIN forest f ON f.id = c.alias_of)
SELECT name, id, top AS root_id FROM chain WHERE alias_of IS NULL""")
def q_resolve_aliases(d: Data) -> DataFrame:
    return tags.resolve_aliases(d.forest)


_FREQ = """SELECT user_id, tag, count(*) AS cnt FROM (SELECT user_id, unnest(d_tag) AS tag FROM mem WHERE tag_processed AND is_active AND created_at >= TIMESTAMP '2024-01-01 00:00:00') GROUP BY 1, 2 HAVING count(*) >= 2"""
_TOP = f"SELECT user_id, tag, cnt FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, tag) AS r FROM ({_FREQ})) WHERE r <= 50"
_CLUSTERS = "(VALUES ('errors', 'error'), ('errors', 'k1'), ('click', 'click'), ('buy-flow', 'purchase'), ('buy-flow', 'signup')) AS c(canonical, tag)"
_TOTALS = f"SELECT user_id, canonical, CAST(sum(cnt) AS BIGINT) AS total FROM ({_TOP}) JOIN {_CLUSTERS} USING (tag) GROUP BY 1, 2"


def clusters(d: Data) -> DataFrame:
    return d.spark.createDataFrame([("errors", ["error", "k1"]), ("click", ["click"]), ("Buy Flow", ["purchase", "signup"])], "canonical string, members array<string>")


def totals(d: Data) -> DataFrame:
    return tags.cluster_totals(tags.dtag_frequency(d.mem, AS_OF), clusters(d))


@_query(_TOP)
def q_dtag_frequency(d: Data) -> DataFrame:
    return tags.dtag_frequency(d.mem, AS_OF)


@_query(_TOTALS)
def q_cluster_totals(d: Data) -> DataFrame:
    return totals(d).select("user_id", "canonical", "total")


_PROMOTED = f"""SELECT user_id, canonical, total, CASE canonical WHEN 'click' THEN 8 ELSE 8 + dense_rank() OVER (PARTITION BY canonical = 'click' ORDER BY canonical) END AS p_tag_id FROM ({_TOTALS}) WHERE total >= 10"""


@_query(_PROMOTED)
def q_promote_tags(d: Data) -> DataFrame:
    return tags.promote_tags(d.tags, totals(d))[1].select("user_id", "canonical", "total", F.col("p_tag_id").cast("long").alias("p_tag_id"))


@_query(f"""WITH p AS ({_PROMOTED}), hit AS (SELECT id, arg_min(p.p_tag_id, (-total, canonical)) AS found FROM (SELECT id, user_id, unnest(d_tag) AS tag FROM mem WHERE tag_processed AND p_tag_id IS NULL) m
 JOIN {_CLUSTERS} USING (tag) JOIN p USING (user_id, canonical) GROUP BY id) SELECT id, coalesce(p_tag_id, found) AS p_tag_id FROM mem LEFT JOIN hit USING (id)""")
def q_retrotag(d: Data) -> DataFrame:
    return tags.retrotag(d.mem, tags.promote_tags(d.tags, totals(d))[1]).select("id", F.col("p_tag_id").cast("long").alias("p_tag_id"))


# ---- search -----------------------------------------------------------------

_ASKED = """SELECT a.*, CASE p_tag WHEN 'alpha-ui' THEN 1 END AS tag, p_tag = 'nowhere' AS unknown_tag,
 CASE date_range WHEN '2024-01-10' THEN TIMESTAMP '2024-01-10 00:00:00' WHEN '20_days_ago' THEN TIMESTAMP '2024-01-11 00:00:00' WHEN 'last_month' THEN TIMESTAMP '2023-12-31 00:00:00' END AS since FROM asked a"""
_MATCH = """m.user_id = q.user_id AND (q.include_archived OR m.is_active) AND (q.tag IS NULL OR q.tag = m.p_tag_id) AND (q.role IS NULL OR q.role = m.role) AND (q.since IS NULL OR m.created_at >= q.since) AND coalesce(NOT q.unknown_tag, TRUE)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {0}) AS rank"
_RECENT = f"SELECT query_id, id, rank FROM (SELECT query_id, q.k, m.id, {_RANK.format('m.created_at DESC, m.id')} FROM ({_ASKED}) q JOIN mem m ON {_MATCH} WHERE {{0}}) WHERE rank <= k"
_VECTOR = f"""SELECT query_id, id, rank, similarity FROM (SELECT query_id, k, id, similarity, {_RANK.format('similarity DESC, id')} FROM (SELECT query_id, q.k, m.id, list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])) AS similarity
 FROM ({_ASKED}) q JOIN mem m ON {_MATCH} WHERE q.text IS NOT NULL AND q.vector IS NOT NULL AND m.embedding IS NOT NULL)) WHERE rank <= k"""
_KEYWORD = _RECENT.format("q.text IS NOT NULL AND m.message ILIKE concat('%', q.text, '%')")


def prepared(d: Data) -> DataFrame:
    return search.prepare_queries(d.asked, tags.resolve_aliases(d.tags), AS_OF).where("not unknown_tag")


@_query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN TIMESTAMP '2024-01-31 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-24 00:00:00' WHEN 3 THEN TIMESTAMP '2023-12-31 00:00:00'
 WHEN 4 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(event_id % 40 AS INT)) END AS since FROM events""")
def q_parse_date_range(d: Data) -> DataFrame:
    given = "case event_id % 6 when 0 then concat(date_format(ts, 'yyyy-MM-dd'), 'T09:00') when 1 then ' Today ' when 2 then 'last_week' when 3 then 'last_month' when 4 then concat(event_id % 40, '_days_ago') else 'soon' end"
    return d.events.select("event_id", tx.parse_date_range(F.expr(given), AS_OF).alias("since"))


@_query("""SELECT 'tag' AS asked, id FROM mem WHERE is_active AND p_tag_id = 1 AND created_at >= TIMESTAMP '2024-01-10 00:00:00' AND role = 'user'
UNION ALL SELECT 'user', id FROM mem WHERE user_id = 7 UNION ALL SELECT 'platform', id FROM mem WHERE is_active AND agent_platform = 'codex-cli'""")
def q_filter_memory(d: Data) -> DataFrame:
    asked = [("tag", {"p_tag_id": 1, "since": dt.datetime(2024, 1, 10), "role": "user"}), ("user", {"user_id": 7, "include_archived": True}), ("platform", {"platform": "codex-cli"})]
    return reduce(DataFrame.union, (search.filter_memory(d.mem, **filters).select(F.lit(name).alias("asked"), "id") for name, filters in asked))


@_query(_RECENT.format("TRUE"))
def q_search_recent(d: Data) -> DataFrame:
    return search.search_recent(d.mem, prepared(d))


@_query(f"SELECT query_id, id, rank, round(similarity, 6) AS similarity FROM ({_VECTOR})")
def q_search_vector(d: Data) -> DataFrame:
    return search.search_vector(d.mem, prepared(d)).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@_query(_KEYWORD)
def q_search_keyword(d: Data) -> DataFrame:
    return search.search_keyword(d.mem, prepared(d))


@_query(_KEYWORD)
def q_search_keyword_indexed(d: Data) -> DataFrame:
    """By a stored index of trigrams, whose second half was added later."""
    path = fresh_path(d.spark)
    for half in (0, 1):
        trigrams.keyword_index(d.mem.where(F.col("id") % 2 == half)).write.mode("append").parquet(path)
    return trigrams.search_keyword_indexed(d.mem, prepared(d), d.spark.read.parquet(path))


@_query(f"""WITH q AS ({_ASKED}), v AS ({_VECTOR}), top AS (SELECT query_id, max(similarity) AS top FROM v GROUP BY 1), k AS (SELECT * FROM ({_KEYWORD}) WHERE query_id NOT IN (SELECT query_id FROM top WHERE top >= 0.3)),
 hits AS (SELECT query_id, 'vector' AS used, round(top, 6) AS top_similarity, rank, id FROM v JOIN top USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM k)
 UNION ALL SELECT query_id, 'ilike', NULL, rank, id FROM k UNION ALL SELECT query_id, 'recency', NULL, rank, id FROM ({_RECENT.format("q.text IS NULL")}))
SELECT * FROM hits UNION ALL SELECT query_id, CASE WHEN unknown_tag THEN 'none' ELSE 'recency' END, NULL, NULL, NULL FROM q WHERE query_id NOT IN (SELECT query_id FROM hits)""")
def q_search_hybrid(d: Data) -> DataFrame:
    out = search.search_hybrid(d.mem, d.asked, tags.resolve_aliases(d.tags), AS_OF)
    return out.select("query_id", "used", F.round("top_similarity", 6).alias("top_similarity"), "rank", "id")


# ---- brief ------------------------------------------------------------------

_SINCE = "is_active AND created_at >= TIMESTAMP '2024-01-28 00:00:00'"
_ACTIVE = f"""SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_used DESC, name) AS rank FROM (SELECT user_id, name, count(*) AS count, max(created_at) AS last_used
 FROM mem JOIN tags ON tags.id = mem.p_tag_id WHERE {_SINCE} GROUP BY ALL) QUALIFY rank <= 5"""
_NEWEST = f"""SELECT user_id, agent_platform = 'claude-code' AS is_current, id, role, agent_platform, device_name, substr(message, 1, 100) AS preview, created_at,
 row_number() OVER (PARTITION BY user_id, agent_platform = 'claude-code' ORDER BY created_at DESC, id DESC) AS rank FROM mem WHERE {_SINCE} QUALIFY rank <= CASE WHEN is_current THEN 8 ELSE 4 END"""
_BRIEFS = f"""WITH a AS ({_ACTIVE}), n AS ({_NEWEST}), t AS (SELECT user_id, string_agg(name, ',' ORDER BY rank) AS tags FROM a GROUP BY 1),
 m AS (SELECT user_id, string_agg(CAST(preview AS STRING), ',' ORDER BY rank DESC) FILTER (is_current) AS current, string_agg(preview, ',' ORDER BY rank DESC) FILTER (NOT is_current) AS others FROM n GROUP BY 1)
SELECT p.user_id, user_name, core_profile, sub_profile, coalesce(tags, '') AS tags, coalesce(current, '') AS current, coalesce(others, '') AS others FROM people p LEFT JOIN t ON t.user_id = p.user_id LEFT JOIN m ON m.user_id = p.user_id"""


@_query(f"SELECT user_id, name, count, last_used, rank FROM ({_ACTIVE})")
def q_active_tags(d: Data) -> DataFrame:
    return brief.active_tags(d.mem, d.tags, AS_OF)


@_query(f"SELECT user_id, is_current, rank, id, preview FROM ({_NEWEST})")
def q_recent_messages(d: Data) -> DataFrame:
    return brief.recent_messages(d.mem, AS_OF, "claude-code").select("user_id", "is_current", "rank", "id", "preview")


def briefs(d: Data) -> DataFrame:
    return brief.collect_brief(d.people, d.mem, d.tags, AS_OF, "claude-code")


@_query(_BRIEFS)
def q_collect_brief(d: Data) -> DataFrame:
    names = lambda c, f: F.coalesce(F.array_join(F.transform(c, lambda x: x[f]), ","), F.lit("")).alias(c)
    return briefs(d).select("user_id", "user_name", "core_profile", "sub_profile", names("tags", "name"), names("current", "preview"), names("others", "preview"))


_LINE = "concat('- [', strftime(created_at, '%H:%M'), ' ', CASE WHEN is_current THEN '' ELSE concat(agent_platform, ' ') END, CASE WHEN device_name IS NOT NULL THEN concat('@', device_name, ' ') ELSE '' END, role, '] ', preview)"


@_query(f"""WITH a AS ({_ACTIVE}), n AS ({_NEWEST}),
 t AS (SELECT user_id, string_agg(concat('- **', name, '** — ', count, ' memories (last: ', strftime(last_used, '%Y-%m-%d'), ')'), chr(10) ORDER BY rank) AS lines FROM a GROUP BY 1),
 m AS (SELECT user_id, is_current, string_agg({_LINE}, chr(10) ORDER BY rank DESC) AS lines, count(*) AS k FROM n GROUP BY 1, 2)
SELECT p.user_id, concat_ws(chr(10), concat('# Memory Briefing (user: ', user_name, ')'), 'Current platform: `claude-code @ box`', '', concat('## Core Profile', chr(10), core_profile || chr(10)), concat('## Sub Profile', chr(10), sub_profile || chr(10))) AS head,
 concat('## Active Projects (last 3 days)', chr(10), t.lines, chr(10)) AS projects, concat('## Recent on claude-code (last ', c.k, ', oldest → newest)', chr(10), c.lines, chr(10)) AS recent,
 concat('## Cross-platform Whispers (other agents, last ', o.k, ')', chr(10), o.lines, chr(10)) AS whispers FROM people p LEFT JOIN t ON t.user_id = p.user_id
 LEFT JOIN m c ON c.user_id = p.user_id AND c.is_current LEFT JOIN m o ON o.user_id = p.user_id AND NOT o.is_current""".replace("concat('## Core Profile', chr(10), core_profile || chr(10))", "'## Core Profile' || chr(10) || core_profile || chr(10)")
        .replace("concat('## Sub Profile', chr(10), sub_profile || chr(10))", "'## Sub Profile' || chr(10) || sub_profile || chr(10)")
        .replace("concat('## Active Projects (last 3 days)', chr(10), t.lines, chr(10)) AS projects", "coalesce('## Active Projects (last 3 days)' || chr(10) || t.lines || chr(10), '') AS projects")
        .replace("concat('## Recent on claude-code (last ', c.k, ', oldest → newest)', chr(10), c.lines, chr(10)) AS recent", "coalesce('## Recent on claude-code (last ' || c.k || ', oldest → newest)' || chr(10) || c.lines || chr(10), '') AS recent")
        .replace("concat('## Cross-platform Whispers (other agents, last ', o.k, ')', chr(10), o.lines, chr(10)) AS whispers", "coalesce('## Cross-platform Whispers (other agents, last ' || o.k || ')' || chr(10) || o.lines || chr(10), '') AS whispers"))
def q_render_brief(d: Data) -> DataFrame:
    """The rendered text, cut at its headings."""
    text = brief.render_brief(briefs(d), "box")
    b = F.regexp_replace("brief", "(?s)\n---\n.*$", "")
    cut = lambda start, until: F.regexp_extract(b, f"(?s)(?:^|\n)({start}.*?)(?=\n(?:{until})|\\z)", 1)
    return text.select(
        "user_id", cut("# Memory", "## Active|## Recent|## Cross").alias("head"), cut("## Active", "## Recent|## Cross").alias("projects"),
        cut("## Recent", "## Cross").alias("recent"), cut("## Cross", "## Nothing").alias("whispers"),
    )


@_query("""SELECT id, user_id, round(tokens, 6) AS tokens FROM (SELECT id, user_id, sum(length(message)) OVER (PARTITION BY user_id ORDER BY created_at DESC, id) / 1.7 AS tokens FROM mem
 WHERE is_active AND created_at >= TIMESTAMP '2024-01-21 00:00:00') WHERE tokens <= 100""")
def q_short_term_window(d: Data) -> DataFrame:
    return brief.short_term_window(d.mem, AS_OF, 10, 100).select("id", "user_id", F.round("tokens", 6).alias("tokens"))


@_query("SELECT id FROM mem WHERE agent_platform = 'claude-code' AND agent_model = 'model-3' OR p_tag_id = 4")
def q_scope_memories(d: Data) -> DataFrame:
    return brief.scope_memories(d.mem, "claude-code", "model-3", 4).select("id")


# ---- profiles and evaluation ------------------------------------------------

_SOURCES = "SELECT user_id, id, message, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM mem WHERE is_active AND role = 'user' QUALIFY rank <= 30"


@_query(f"SELECT user_id, id, rank FROM ({_SOURCES})")
def q_profile_sources(d: Data) -> DataFrame:
    return profile.profile_sources(d.mem).select("user_id", "id", "rank")


@_query(f"""WITH s AS ({_SOURCES}), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC) AS i FROM s)
SELECT p.user_id, md5(concat('EXISTING PROFILE (subject to update):', chr(10), 'core_profile:', chr(10), coalesce(any_value(core_profile), '(empty)'), chr(10), chr(10), 'sub_profile:', chr(10), coalesce(any_value(sub_profile), '(empty)'), chr(10), chr(10),
 'RECENT USER MESSAGES (most recent ', count(*), ', role=''user''):', chr(10), string_agg(concat('[#', i, ' @ ', strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '] ', message), chr(10) || chr(10) ORDER BY i), chr(10), chr(10),
 'Task: produce updated core_profile and sub_profile JSON per the system prompt.')) AS prompt FROM people p JOIN n USING (user_id) GROUP BY p.user_id""")
def q_build_profile_prompts(d: Data) -> DataFrame:
    return profile.build_profile_prompts(d.people, profile.profile_sources(d.mem)).select("user_id", md5("prompt"))


@_query("""SELECT user_id, CASE user_id % 4 WHEN 0 THEN core_profile WHEN 1 THEN 'c' ELSE core_profile END AS core_profile, CASE user_id % 4 WHEN 1 THEN NULL ELSE sub_profile END AS sub_profile, user_id % 4 = 1 AS changed,
 CASE WHEN user_id % 4 = 2 THEN 'invalid JSON: {oops' END AS error FROM people""")
def q_apply_profile_output(d: Data) -> DataFrame:
    same = F.to_json(F.struct(F.coalesce("core_profile", F.lit("")).alias("core_profile"), "sub_profile"))
    raw = F.when(F.col("user_id") % 4 == 0, same).when(F.col("user_id") % 4 == 1, F.lit('```json\n{"core_profile": "c", "sub_profile": null}\n```')).when(F.col("user_id") % 4 == 2, F.lit("{oops"))
    return profile.apply_profile_output(d.people, d.people.where("user_id % 4 < 3").select("user_id", raw.alias("raw"))).select("user_id", "core_profile", "sub_profile", "changed", "error")


@_query("SELECT id, role, p_tag_id FROM mem WHERE is_active QUALIFY row_number() OVER (PARTITION BY role ORDER BY md5(concat(CAST(id AS STRING), ':7')), id) <= CASE role WHEN 'user' THEN 50 ELSE 51 END")
def q_sample_by_role(d: Data) -> DataFrame:
    return evaluate.sample_by_role(d.mem, 101, 7).select("id", "role", "p_tag_id")


def classified(d: Data) -> DataFrame:
    return evaluate.classify_tag_responses(d.replies, enrich.tag_candidates(d.tags))


_CLASSES = "SELECT *, id % 5 <> 4 AND error IS NULL AS parse_ok, CASE WHEN id % 5 = 4 OR error IS NOT NULL THEN 'parse-fail' WHEN id % 5 = 0 THEN 'existing' WHEN id % 5 = 1 THEN 'new' WHEN id % 5 = 2 THEN 'null' ELSE 'rejected' END AS matched FROM replies"


@_query(f"SELECT id, parse_ok, matched FROM ({_CLASSES})")
def q_classify_tag_responses(d: Data) -> DataFrame:
    return classified(d).select("id", "parse_ok", "matched")


@_query(f"""WITH c AS ({_CLASSES}), p AS (SELECT model, list_sort(list(latency_ms)) AS l FROM c WHERE error IS NULL GROUP BY 1), e AS (SELECT model, string_agg(error, ',' ORDER BY id) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY id) AS r FROM c WHERE error IS NOT NULL) WHERE r <= 5 GROUP BY 1)
SELECT model, count(*) AS total, count(*) FILTER (parse_ok) AS parse_ok, count(*) FILTER (matched = 'existing') AS matched_existing, count(*) FILTER (matched = 'new') AS matched_new, count(*) FILTER (matched = 'null') AS matched_null,
 count(*) FILTER (matched = 'rejected') AS rejected, round(avg(latency_ms) FILTER (error IS NULL), 6) AS avg_latency_ms, any_value(l[least(len(l) - 1, CAST(floor(len(l) * 0.95) AS BIGINT)) + 1]) AS p95_latency_ms,
 CAST(sum(input_tokens) FILTER (error IS NULL) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) FILTER (error IS NULL) AS BIGINT) AS total_output_tokens,
 round(sum(input_tokens) FILTER (error IS NULL) / 1e6 * 0.2 + sum(output_tokens) FILTER (error IS NULL) / 1e6 * 0.5, 6) AS est_cost_usd, coalesce(any_value(errors), '') AS errors
FROM c JOIN p USING (model) LEFT JOIN e USING (model) GROUP BY model""")
def q_summarize_tagger(d: Data) -> DataFrame:
    prices = d.replies.select("model").distinct().withColumns({"input": F.lit(0.2), "output": F.lit(0.5)})
    out = evaluate.summarize_tagger(classified(d), prices)
    return out.withColumns({"avg_latency_ms": F.round("avg_latency_ms", 6), "est_cost_usd": F.round("est_cost_usd", 6), "errors": F.array_join("errors", ",")})


# ---- lifecycle --------------------------------------------------------------

_SCORED = """SELECT *, CASE WHEN fact_type = 'profile' THEN CAST('inf' AS DOUBLE) ELSE importance * exp(-(epoch(TIMESTAMP '2024-12-31 00:00:00') - epoch(coalesce(last_accessed_at, created_at))) / 86400.0 /
 (CASE fact_type WHEN 'preference' THEN 365 WHEN 'relationship' THEN 365 WHEN 'skill' THEN 180 WHEN 'decision' THEN 180 WHEN 'learning' THEN 90 ELSE 14 END * (1 + log10(access_count + 1)))) END AS score FROM facts"""
_GONE = f"SELECT *, is_active AND fact_type <> 'profile' AND validation_status <> 'pending' AND score < 0.5 AS gone FROM ({_SCORED})"


def facts(d: Data) -> DataFrame:
    return d.facts.withColumn("metadata", F.lit(None).cast("map<string,string>"))


@_query(f"SELECT id, CASE WHEN isinf(score) THEN NULL ELSE round(score, 6) END AS score FROM ({_SCORED})")
def q_decay_score(d: Data) -> DataFrame:
    s = F.col("score")
    return lifecycle.decay_score(facts(d), FACTS_AS_OF).select("id", F.when(s < float("inf"), F.round(s, 6)).alias("score"))


@_query(f"SELECT id, gone AS forgotten_now, is_active AND NOT gone AS is_active FROM ({_GONE})")
def q_forget(d: Data) -> DataFrame:
    return lifecycle.forget(facts(d), FACTS_AS_OF).select("id", "forgotten_now", "is_active")


@_query(f"SELECT id, gone AS restored_now, is_active, CASE WHEN gone THEN TIMESTAMP '2024-12-31 00:03:00' ELSE last_accessed_at END AS last_accessed_at FROM ({_GONE})")
def q_restore(d: Data) -> DataFrame:
    gone = lifecycle.forget(facts(d), FACTS_AS_OF)
    return lifecycle.restore(gone, FACTS_AS_OF + dt.timedelta(minutes=3), since_minutes=5).select("id", "restored_now", "is_active", "last_accessed_at")


@_query(f"SELECT fact_type, count(*) AS forgotten FROM ({_GONE}) WHERE gone GROUP BY ROLLUP (fact_type)")
def q_forgetting_report(d: Data) -> DataFrame:
    return lifecycle.forgetting_report(lifecycle.forget(facts(d), FACTS_AS_OF))


@_query("""SELECT id, access_count + coalesce(n, 0) AS access_count, greatest(ts, last_accessed_at) AS last_accessed_at FROM facts LEFT JOIN (SELECT event_id // 3 AS id, count(*) AS n, max(ts) AS ts FROM events GROUP BY 1) USING (id)""")
def q_record_access(d: Data) -> DataFrame:
    hits = d.events.select(F.expr("event_id div 3 as id"), "ts")
    return lifecycle.record_access(facts(d), hits).select("id", "access_count", "last_accessed_at")


@_query("SELECT id, CASE WHEN created_at >= TIMESTAMP '2024-01-16 00:00:00' THEN 'short_term' ELSE 'long_term' END AS tier, CASE WHEN created_at >= TIMESTAMP '2024-01-16 00:00:00' THEN content END AS content FROM facts")
def q_assign_tier(d: Data) -> DataFrame:
    return lifecycle.assign_tier(d.facts, AS_OF, 15).select("id", "tier", "content")


@_query("""WITH s AS (SELECT user_id AS u FROM people WHERE user_id % 20 = 0), near AS (SELECT u FROM s UNION SELECT to_id FROM edges WHERE from_id IN (SELECT u FROM s) UNION SELECT from_id FROM edges WHERE to_id IN (SELECT u FROM s))
SELECT id, subject_id FROM facts WHERE subject_id IN (SELECT u FROM near) AND list_has_any(tags, ['click', 'k3'])""")
def q_expand_subjects(d: Data) -> DataFrame:
    seeds = d.people.where("user_id % 20 = 0").select(F.col("user_id").alias("subject_id"))
    seeds = seeds.union(seeds)
    return lifecycle.expand_subjects(d.facts, d.edges, seeds, ["click", "k3"]).select("id", "subject_id")


@_query("""SELECT from_id, to_id, relationship_type FROM edges UNION SELECT to_id, from_id, CASE WHEN from_id % 3 = 0 THEN 'owns' ELSE 'advises' END FROM edges WHERE from_id % 3 < 2""")
def q_upsert_edges(d: Data) -> DataFrame:
    kind = F.when(F.col("from_id") % 3 == 0, "owns").when(F.col("from_id") % 3 == 1, "advises").otherwise("likes")
    new = d.edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), kind.alias("relationship_type"))
    own = d.edges.select("from_id", F.col("from_id").alias("to_id"), F.lit("owns").alias("relationship_type"))
    return lifecycle.upsert_edges(d.edges, new.union(own))


@_query("SELECT relationship_type, count(*) AS n FROM edges GROUP BY 1")
def q_edge_stats(d: Data) -> DataFrame:
    return lifecycle.edge_stats(d.edges)


@_query("SELECT CAST(doc_id AS STRING) AS external_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents")
def q_sync_pages(d: Data) -> DataFrame:
    pages = d.documents.select(F.lit("p").alias("provider"), F.col("doc_id").cast("string").alias("external_id"), F.col("text").alias("plaintext"), "doc_id")
    old = lifecycle.normalized(pages.where("doc_id % 5 <> 0")).select("provider", "external_id", "content_hash", F.lit(AS_OF).cast("timestamp_ntz").alias("last_synced_at"))
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("plaintext", F.lit(" edit"))).otherwise(F.concat(F.lit(" "), F.regexp_replace("plaintext", " ", "  "), F.lit("\n")))
    return lifecycle.sync_pages(old, pages.withColumn("plaintext", edited), AS_OF)[1].select("external_id", "status")


# ---- skills and diagnostics -------------------------------------------------


def skill_rows(d: Data) -> DataFrame:
    return d.skills.withColumn("applicable_to", F.struct("models", "platforms", "projects")).drop("models", "platforms", "projects")


_CTX = "SELECT user_id AS ctx_id, CASE WHEN user_id % 3 <> 0 THEN concat('model-', CAST(user_id % 4 AS STRING)) END AS model, CASE WHEN user_id % 2 = 0 THEN 'claude-code' WHEN user_id % 5 <> 0 THEN 'codex-cli' END AS platform, CASE WHEN user_id % 4 = 0 THEN 'p1' WHEN user_id % 4 = 1 THEN 'p9' END AS project_key FROM people"


@_query(f"""SELECT ctx_id, id, row_number() OVER (PARTITION BY ctx_id ORDER BY use_count DESC, id) AS rank FROM skills JOIN ({_CTX}) c ON (c.model IS NULL OR models IS NULL OR list_contains(models, c.model))
 AND (c.platform IS NULL OR platforms IS NULL OR list_contains(platforms, c.platform)) AND (c.project_key IS NULL OR projects IS NULL OR list_contains(projects, c.project_key)) WHERE status = 'active' QUALIFY rank <= 5""")
def q_injectable_skills(d: Data) -> DataFrame:
    contexts = d.spark.sql(_CTX.replace("FROM people", "FROM {people}"), people=d.people)
    return skills.injectable_skills(skill_rows(d), contexts)


@_query("SELECT id, use_count, greatest(last_used_at, ts) AS last_used_at FROM skills LEFT JOIN (SELECT event_id % 300 AS id, max(ts) AS ts FROM events GROUP BY 1) USING (id)")
def q_mark_exposed(d: Data) -> DataFrame:
    shown = d.events.select((F.col("event_id") % 300).alias("skill_id"), "ts")
    return skills.mark_exposed(skill_rows(d), shown).select("id", "use_count", "last_used_at")



@_query("""WITH c AS (SELECT id + 100000 AS candidate_id, embedding, id % 3 AS m FROM skills WHERE id % 20 = 0), s AS (SELECT candidate_id, id, list_cosine_similarity(CAST(skills.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS sim FROM c JOIN skills ON status = 'active'),
 b AS (SELECT candidate_id, id, sim, row_number() OVER (PARTITION BY candidate_id ORDER BY sim DESC, id) AS r FROM s)
SELECT candidate_id, CASE WHEN sim >= 0.7 THEN id END AS skill_id, round(sim, 6) AS similarity, CASE WHEN sim >= 0.9 THEN 'accumulate' WHEN sim >= 0.7 THEN 'branch' ELSE 'create' END AS action, CASE WHEN sim >= 0.7 AND sim < 0.9 THEN id END AS parent_skill_id FROM b WHERE r = 1""")
def q_route_skill_candidates(d: Data) -> DataFrame:
    candidates = d.skills.where("id % 20 = 0").select((F.col("id") + 100000).alias("candidate_id"), "embedding")
    return skills.route_skill_candidates(skill_rows(d), candidates).withColumn("similarity", F.round("similarity", 6))


@_query("SELECT id, coalesce(array_to_string(list_sort(CASE WHEN id % 4 = 3 THEN list_distinct(list_concat(projects, [concat('p', CAST(id % 5 AS STRING))])) ELSE projects END), ','), 'all') AS projects FROM skills")
def q_merge_projects(d: Data) -> DataFrame:
    key = F.when(F.col("id") % 4 == 3, F.concat(F.lit("p"), (F.col("id") % 5).cast("string")))
    out = skills.merge_projects(skill_rows(d), d.skills.select(F.col("id").alias("skill_id"), key.alias("project_key")))
    return out.select("id", F.coalesce(F.array_join(F.sort_array("applicable_to.projects"), ","), F.lit("all")).alias("projects"))


@_query("SELECT id, role, device_name, substr(message, 1, 70) AS preview, created_at FROM mem WHERE agent_platform = 'codex-cli' AND created_at >= TIMESTAMP '2024-01-27 00:00:00' ORDER BY created_at DESC, id LIMIT 30")
def q_platform_activity(d: Data) -> DataFrame:
    return diagnostics.platform_activity(d.mem, "codex-cli", AS_OF, 96)[0]


@_query("SELECT role, count(*) AS cnt FROM mem WHERE agent_platform = 'codex-cli' AND created_at >= TIMESTAMP '2024-01-27 00:00:00' GROUP BY role")
def q_platform_roles(d: Data) -> DataFrame:
    return diagnostics.platform_activity(d.mem, "codex-cli", AS_OF, 96)[1]


@_query(f"SELECT role, count(*) AS n, min(id) AS first_id FROM ({_AGAIN}) GROUP BY role, message, created_at HAVING count(*) > 1")
def q_double_write_report(d: Data) -> DataFrame:
    return diagnostics.double_write_report(again(d)).select("role", "n", "first_id")


# ---- functions that users supply, and streams run to their end ---------------


@_query("SELECT id, CASE WHEN id % 50 <> 7 THEN upper(message) END AS reply, CASE WHEN id % 50 = 7 THEN 'no reply' END AS error FROM mem")
def q_with_model_fn(d: Data) -> DataFrame:
    def shout(values: list[str]) -> list[str]:
        if any(v.startswith("!") for v in values):
            raise ValueError("no reply")
        return [v.upper() for v in values]

    given = d.mem.select("id", F.expr("case when id % 50 = 7 then concat('!', message) else message end as message"))
    return enrich.with_model_fn(given, shout, "message", "reply").select("id", "reply", "error")


def _finished(d: Data, stream: DataFrame, schema: str) -> DataFrame:
    """What a stream over all files at hand writes."""
    out = fresh_path(d.spark)
    stream.writeStream.format("parquet").option("checkpointLocation", fresh_path(d.spark)).trigger(availableNow=True).start(out).awaitTermination()
    return d.spark.read.schema(schema).parquet(out)


@_query(f"SELECT DISTINCT concat('ext:', CAST(id AS STRING)) AS external_uuid FROM ({_AGAIN})")
def q_stream_dedup(d: Data) -> DataFrame:
    from memloom.streaming.capture import stream_dedup

    landing = fresh_path(d.spark)
    rows = again(d).select(F.concat(F.lit("ext:"), F.col("id").cast("string")).alias("external_uuid"), F.col("created_at").cast("timestamp").alias("created_at"))
    rows.write.parquet(landing)
    return _finished(d, stream_dedup(d.spark.readStream.schema(rows.schema).parquet(landing)).select("external_uuid"), "external_uuid string")


@_query(f"SELECT {UUID36} AS session_id, byte_offset, last_value(CASE WHEN turn % 2 = 1 THEN concat('m', CAST((turn + 1) // 2 AS VARCHAR)) END IGNORE NULLS) OVER (PARTITION BY session_no ORDER BY turn) AS carried FROM ({CODEX_AT})")
def q_stream_carry_model(d: Data) -> DataFrame:
    from memloom.streaming.capture import stream_carry_model

    landing = fresh_path(d.spark)
    rows = codex(d).select("session_id", "byte_offset", "line")
    rows.write.parquet(landing)
    stream = stream_carry_model(d.spark.readStream.schema(rows.schema).parquet(landing), keep_hours=None).select("session_id", "byte_offset", "carried")
    return _finished(d, stream, "session_id string, byte_offset long, carried string")


def _ticks(d: Data, n: int) -> DataFrame:
    """A stream of n batches."""
    landing = fresh_path(d.spark)
    for i in range(n):
        d.spark.range(i, i + 1).coalesce(1).write.mode("append").parquet(landing)
    return d.spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(landing)


_SOURCE = "CASE session_no % 6 WHEN 0 THEN 'codex-cli' WHEN 1 THEN 'codex-desktop' WHEN 2 THEN 'codex-mcp' WHEN 3 THEN 'codex-exec' ELSE 'codex-mcp-client' END"


@_query(_parsed(_SOURCE, "said = 1"))
def q_stream_ingest(d: Data) -> DataFrame:
    """All transcripts in three formats, one file a session, through the stream into tables; a second start finds nothing new."""
    from memloom.streaming.capture import stream_ingest

    def ingested(kind: str, files: DataFrame, **more: DataFrame) -> DataFrame:
        landing, table, checkpoint = fresh_path(d.spark), fresh_path(d.spark), fresh_path(d.spark)
        write_files(files, landing, "turn")
        for _ in range(2):
            stream_ingest(d.spark, landing, table, checkpoint, kind, kind_of_path="folder", split_bytes=1 << 20, availableNow=True, **more).awaitTermination()
        return d.spark.read.parquet(table).select("session_id", "role", md5("message"), "agent_model", "agent_platform", "external_uuid")

    def sessions(lines: DataFrame, name: str) -> DataFrame:
        return lines.select("turn", "line", F.expr(name).alias("file"))

    s = d.turns.select("session_no").distinct().where("session_no % 6 <> 5")
    source = F.element_at(F.array(*map(F.lit, ["cli", "vscode", "mcp", "exec", "other"])), (F.col("session_no") % 6 + 1).cast("int"))
    threads = s.select(F.expr(UUID36).alias("id"), source.alias("source"))
    documents = gemini_files(d).select(F.col("text").alias("line"), F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.lit(0).alias("turn"))
    return (
        ingested("claude", sessions(d.claude_lines, "concat(CAST(session_no AS STRING), '.jsonl')"))
        .union(ingested("codex", sessions(d.codex_lines, f"concat('rollout-2024-01-01-', {UUID36}, '.jsonl')"), threads=threads))
        .union(ingested("gemini", documents))
    )


_TOGETHER = "SELECT session_no % 3 AS g, line, row_number() OVER w - 1 AS pos, CAST(sum(strlen(line) + 1) OVER w - strlen(line) - 1 AS BIGINT) AS byte_offset FROM claude_lines WINDOW w AS (PARTITION BY session_no % 3 ORDER BY session_no, turn)"


def _long_files(d: Data) -> str:
    """Three files with a third of the transcripts each; file 0 is read already."""
    landing = fresh_path(d.spark)
    rows = d.claude_lines.selectExpr("session_no % 3 as file", "session_no", "turn", "line").repartition("file").sortWithinPartitions("file", "session_no", "turn")
    rows.select("line", "file").write.partitionBy("file").text(landing)
    return landing


def _file_number(path: str) -> Column:
    return F.regexp_extract(path, "file=([0-9]+)/", 1).cast("long")


@_query(f"SELECT g, pos, byte_offset, md5(line) AS line FROM ({_TOGETHER})")
def q_read_ranges(d: Data) -> DataFrame:
    """Long files in ranges of 100,000 bytes."""
    lines, _ = tr.read_new_lines(d.spark, _long_files(d), pattern="part-*", split_bytes=100_000)
    return lines.select(_file_number("path").alias("g"), "pos", "byte_offset", md5("line"))


@_query(f"SELECT g, count(*) FILTER (g <> 0) AS n_new, max(byte_offset + strlen(line) + 1) AS cursor, max(pos) + 1 AS lines FROM ({_TOGETHER}) GROUP BY g")
def q_read_new_lines(d: Data) -> DataFrame:
    """Ranges behind cursors: the file at its cursor is not opened, the others are read from their start."""
    landing = _long_files(d)
    _, ends = tr.read_new_lines(d.spark, landing, pattern="part-*", split_bytes=100_000)
    lines, after = tr.read_new_lines(d.spark, landing, written(ends).where(_file_number("path") == 0), pattern="part-*", split_bytes=100_000)
    new = lines.groupBy("path").agg(F.count("*").alias("n_new"))
    return after.join(new, "path", "left").select(_file_number("path").alias("g"), F.coalesce("n_new", F.lit(0)).alias("n_new"), "cursor", "lines")


_ENRICHED = """WITH p AS (SELECT *, (embedding IS NULL OR NOT tag_processed) AND (cold_error IS NULL OR updated_at < TIMESTAMP '2024-01-31 00:00:00' - CASE WHEN is_active THEN INTERVAL 5 MINUTE ELSE INTERVAL 1 HOUR END) AS due FROM mem),
 e AS (SELECT id, user_id, is_active, created_at, tag_processed OR due AS tag_processed, CASE WHEN due AND NOT tag_processed THEN 1 ELSE p_tag_id END AS p_tag_id, CASE WHEN due AND NOT tag_processed THEN ['t'] ELSE d_tag END AS d_tag,
  CASE WHEN due OR embedding IS NOT NULL THEN 64 END AS dims, CASE WHEN NOT due THEN cold_error END AS cold_error FROM p),
 f AS (SELECT user_id, tag, count(*) AS cnt FROM (SELECT user_id, unnest(d_tag) AS tag FROM e WHERE tag_processed AND is_active AND created_at >= TIMESTAMP '2024-01-01 00:00:00') GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, tag) <= 50),
 n AS (SELECT tag, 8 + row_number() OVER (ORDER BY tag) AS p FROM (SELECT DISTINCT tag FROM f WHERE cnt >= 10 AND tag <> 'click')),
 h AS (SELECT id, arg_min(CASE WHEN m.tag = 'click' THEN 8 ELSE n.p END, (-cnt, m.tag)) AS found FROM (SELECT id, user_id, unnest(d_tag) AS tag FROM e WHERE tag_processed AND p_tag_id IS NULL) m JOIN f ON f.user_id = m.user_id AND f.tag = m.tag AND cnt >= 10 LEFT JOIN n ON n.tag = m.tag GROUP BY id)
SELECT id, CAST(coalesce(p_tag_id, found) AS BIGINT) AS p_tag_id, tag_processed, dims, cold_error FROM e LEFT JOIN h USING (id)"""


@_query(_ENRICHED)
def q_stream_enrich(d: Data) -> DataFrame:
    """The stream over two ticks with a stored table: the first round enriches all that is pending, the second finds nothing more and promotes."""
    from memloom.streaming.capture import stream_enrich

    tag = lambda values: ['{"p_tag": "alpha", "d_tag": ["t"]}' for _ in values]
    embed = lambda values: [[0.5] * 64 for _ in values]
    path, known = fresh_path(d.spark), [d.tags]
    tr.write_memory(d.mem, path)

    def save(changed: DataFrame, tags: DataFrame, number: int) -> None:
        tr.merge_memory(d.spark, changed, path)
        known.append(tags)

    stream_enrich(_ticks(d, 2), lambda: (tr.read_memory(d.spark, path), known[-1]), save, tag, embed, 64, lambda: AS_OF, fresh_path(d.spark), every=2, availableNow=True).awaitTermination()
    after = tr.read_memory(d.spark, path)
    return after.select("id", F.col("p_tag_id").cast("long").alias("p_tag_id"), "tag_processed", F.size("embedding").alias("dims"), "cold_error")
