"""Tables that the queries derive from the given ones, in one SQL text for Spark and for the oracle.

LIST<<..>> is an array, MINUTES<..> an interval, TS'..' a timestamp without zone, {name} a given table.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.datetime(2024, 1, 31)
FACTS_AS_OF = dt.datetime(2024, 12, 31)
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations"]

_JSON = "substr(to_json(LIST<<message>>), 2, length(to_json(LIST<<message>>)) - 2)"

VIEWS: dict[str, str] = {
    "mem": """
SELECT e.event_id AS id, e.user_id,
 CASE e.event_id % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex-cli' ELSE 'gemini-cli-mcp-client' END AS agent_platform,
 CASE WHEN e.event_id % 2 = 0 THEN NULL WHEN e.event_id % 5 = 0 THEN 'unknown' ELSE concat('model-', CAST(e.event_id % 5 AS STRING)) END AS agent_model,
 FALSE AS subagent, CAST(NULL AS STRING) AS subagent_model, CAST(NULL AS STRING) AS subagent_role,
 CASE WHEN e.event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
 concat(e.event_type, ' k=', regexp_extract(e.props, '"k": ([0-9]+)', 1)) AS message,
 CASE WHEN e.event_id % 11 < 8 THEN e.event_id % 11 + 1 END AS p_tag_id,
 LIST<<e.event_type, concat('k', CAST(CAST(regexp_extract(e.props, '"k": ([0-9]+)', 1) AS INT) % 10 AS STRING))>> AS d_tag,
 v.embedding AS embedding,
 e.event_id % 13 <> 0 AS is_active,
 CASE WHEN e.event_id % 13 = 0 THEN e.ts + MINUTES<1440> END AS archived_at,
 e.event_id % 17 = 0 AND e.event_id % 13 <> 0 AS is_pinned,
 CASE WHEN e.event_id % 23 = 0 THEN 'tag: 429' END AS cold_error,
 e.event_id % 11 <> 10 AS tag_processed,
 CASE WHEN e.event_id % 6 <> 5 THEN concat('ext:', CAST(e.event_id AS STRING)) END AS external_uuid,
 CASE e.event_id % 4 WHEN 0 THEN 'desk' WHEN 1 THEN 'laptop' END AS device_name,
 e.ts AS created_at, e.ts + MINUTES<e.event_id % 90> AS updated_at
FROM {events} e LEFT JOIN {embeddings} v ON v.vec_id = e.event_id""",
    "turns": """
SELECT conv_id * 1000 + turn AS id, conv_id % 5 AS user_id, conv_id AS session_no, turn, role, text AS message,
 TS'2024-01-01 00:00:00' + MINUTES<conv_id * 60 + turn> AS created_at
FROM {conversations} WHERE role IN ('user', 'assistant')""",
    "tags": "SELECT * FROM (VALUES (1, 'alpha', NULL), (2, 'beta', NULL), (3, 'gamma', NULL), (4, 'alpha-app', 1), (5, 'alpha-ui', 4), (6, 'beta-svc', 2), (7, 'delta', NULL), (8, 'click', NULL)) AS t(id, name, alias_of)",
    "forest": "SELECT c_custkey AS id, concat('tag-', CAST(c_custkey AS STRING)) AS name, CASE WHEN c_custkey % 4 <> 0 AND c_custkey > 2 THEN CAST(floor(c_custkey / 2) AS BIGINT) END AS alias_of FROM {customer}",
    "asked": """
SELECT v.vec_id AS query_id, e.user_id, CASE (v.vec_id / 20) % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'k=7' WHEN 2 THEN 'no-such-word' WHEN 3 THEN '100%' END AS text,
 v.embedding AS vector, CASE WHEN (v.vec_id / 20) % 7 = 3 THEN 'alpha-ui' WHEN (v.vec_id / 20) % 7 = 5 THEN 'nowhere' END AS p_tag,
 CASE (v.vec_id / 20) % 6 WHEN 1 THEN '2024-01-10' WHEN 2 THEN '20_days_ago' WHEN 3 THEN 'last_month' END AS date_range,
 CASE WHEN (v.vec_id / 20) % 4 = 1 THEN 'user' END AS role, CAST(NULL AS STRING) AS platform, v.vec_id % 60 = 0 AS include_archived, CAST((v.vec_id / 20) % 9 + 1 AS INT) AS k
FROM {embeddings} v JOIN {events} e ON e.event_id = v.vec_id WHERE v.vec_id % 20 = 0""",
    "facts": """
SELECT id, user_id AS subject_id, message AS content,
 CASE id % 7 WHEN 0 THEN 'profile' WHEN 1 THEN 'preference' WHEN 2 THEN 'skill' WHEN 3 THEN 'decision' WHEN 4 THEN 'learning' WHEN 5 THEN 'state' ELSE 'relationship' END AS fact_type,
 id % 10 + 1 AS importance, id % 12 AS access_count, CASE WHEN id % 3 <> 0 THEN created_at + MINUTES<(id % 20) * 1440> END AS last_accessed_at,
 CASE WHEN id % 10 = 9 THEN 'pending' ELSE 'validated' END AS validation_status, is_active, created_at, d_tag AS tags
FROM (mem)""",
    "edges": """
SELECT DISTINCT user_id AS from_id, (user_id * 7 + 3) % (SELECT max(user_id) + 1 FROM {events}) AS to_id,
 CASE user_id % 5 WHEN 0 THEN 'owns' WHEN 1 THEN 'delegates_to' WHEN 2 THEN 'advises' WHEN 3 THEN 'reports_to' ELSE 'collaborates' END AS relationship_type
FROM {events} WHERE user_id <> (user_id * 7 + 3) % (SELECT max(user_id) + 1 FROM {events})""",
    "people": """
SELECT DISTINCT user_id, concat('user-', CAST(user_id AS STRING)) AS user_name, CASE WHEN user_id % 3 = 0 THEN concat('core of ', CAST(user_id AS STRING)) END AS core_profile,
 CASE WHEN user_id % 4 = 1 THEN concat('sub of ', CAST(user_id AS STRING)) END AS sub_profile FROM {events}""",
    "skills": """
SELECT vec_id AS id, concat('skill ', CAST(vec_id AS STRING)) AS title, embedding, CASE WHEN vec_id % 5 = 4 THEN 'inactive' ELSE 'active' END AS status,
 CASE WHEN vec_id % 3 = 0 THEN LIST<<'model-1', 'model-2'>> END AS models, CASE WHEN vec_id % 4 = 1 THEN LIST<<'claude-code'>> END AS platforms,
 CASE WHEN vec_id % 2 = 1 THEN LIST<<'p1', 'p2'>> END AS projects, vec_id % 17 AS use_count, TS'2024-01-01 00:00:00' + MINUTES<vec_id> AS last_used_at
FROM {embeddings}""",
    "replies": """
SELECT id, CASE id % 3 WHEN 0 THEN 'm-a' WHEN 1 THEN 'm-b' ELSE 'm-c' END AS model,
 CASE id % 5 WHEN 0 THEN '{{"p_tag": "alpha", "d_tag": ["K1", " two "]}}' WHEN 1 THEN concat('{{"p_tag": "NEW: proj-', CAST(session_no % 9 AS STRING), '", "d_tag": []}}')
  WHEN 2 THEN '{{"p_tag": null, "d_tag": ["x"]}}' WHEN 3 THEN '{{"p_tag": "beta-svc", "d_tag": ["y"]}}' ELSE '{{"p_tag": ' END AS raw,
 100 + id % 977 AS latency_ms, 3000 + id % 50 AS input_tokens, 100 + id % 30 AS output_tokens, CASE WHEN id % 41 = 0 THEN concat('timeout ', CAST(id AS STRING)) END AS error
FROM (turns)""",
    "claude_lines": f"""
SELECT session_no, turn, concat('{{{{"type":"', role, '","uuid":"u', CAST(turn AS STRING), '",', CASE WHEN turn % 7 = 5 THEN '"isMeta":true,' ELSE '' END, '"message":{{{{"model":"m',
 CAST(session_no % 3 AS STRING), '","content":', CASE WHEN turn % 3 = 1 THEN concat('[{{{{"type":"tool_use"}}}},{{{{"type":"text","text":', {_JSON}, '}}}}]') ELSE {_JSON} END, '}}}}}}}}') AS line
FROM (turns)""",
    "codex_lines": f"""
SELECT session_no, turn * 2 AS turn, concat('{{{{"type":"event_msg","payload":{{{{"type":"', CASE WHEN role = 'user' THEN 'user_message' ELSE 'agent_message' END, '","message":', {_JSON}, '}}}}}}}}') AS line FROM (turns)
UNION ALL SELECT session_no, turn * 2 - 1, concat('{{{{"type":"turn_context","payload":{{{{"model":"m', CAST(turn AS STRING), '"}}}}}}}}') FROM (turns) WHERE turn % 4 = 2""",
}


def text(name: str, dialect: str) -> str:
    """A view's SQL with the views that it is made of inside."""
    sql = re.sub(r"FROM \((\w+)\)", lambda m: f"FROM ({text(m[1], 'raw')}) AS {m[1]}" if m[1] in VIEWS else m[0], VIEWS[name])
    if dialect == "raw":
        return sql
    spark = dialect == "spark"
    sql = re.sub(r"LIST<<(.*?)>>", r"array(\1)" if spark else r"[\1]", sql)
    sql = re.sub(r"MINUTES<(.*?)>(?=\s|$)", r"make_interval(0, 0, 0, 0, 0, CAST(\1 AS INT), 0)" if spark else r"to_minutes(CAST(\1 AS INT))", sql)
    sql = sql.replace("TS'", "TIMESTAMP_NTZ '" if spark else "TIMESTAMP '")
    if spark:
        return sql.replace("(v.vec_id / 20)", "(v.vec_id DIV 20)")
    sql = sql.replace("(v.vec_id / 20)", "(v.vec_id // 20)")
    return re.sub(r"\{(\w+)\}", r"\1", sql.replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}")


class Data:
    """The given tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = text(name, "spark")
        return self.spark.sql(sql, **{t: getattr(self, t) for t in TABLES if f"{{{t}}}" in sql})


def oracle(sql: str) -> str:
    """The oracle's SQL with the views that it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({text(v, 'duck')})" for v in used)
    if not head:
        return sql
    recursive = sql.lstrip().startswith("WITH RECURSIVE ")
    rest = re.sub(r"^\s*WITH (RECURSIVE )?", ", ", sql) if re.match(r"\s*WITH ", sql) else f" {sql}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{rest}"
