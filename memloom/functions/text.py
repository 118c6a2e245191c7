"""Column functions over message texts, identifiers and dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wrapper elements that are removed with their bodies.
NOISE_TAGS = [
    "system-reminder", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr",
    "task-notification", "user-prompt-submit-hook", "session-start-hook", "session-end-hook",
]
#: Texts and beginnings of texts that are no messages.
INTERRUPTED = ["[Request interrupted by user for tool use]", "[Request interrupted by user]"]
TOOL_LOGS = ["[external_agent_tool_call:", "[external_agent_tool_call_response:"]

_WHITE = r"[\s\p{Z}\x{FEFF}]"


def trim_all(c: Column) -> Column:
    """Trim every Unicode white space on both ends."""
    return F.regexp_replace(c, f"^{_WHITE}+|{_WHITE}+$", "")


def filled(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def slug(c: Column) -> Column:
    return F.lower(trim_all(c))


def strip_noise(c: Column) -> Column:
    """Text without wrapper elements, trimmed; null if nothing or only an interruption marker is left."""
    bare = trim_all(F.regexp_replace(trim_all(c), f"(?s)<({'|'.join(NOISE_TAGS)})>.*?</\\1>", ""))
    return F.when((bare != "") & ~bare.isin(INTERRUPTED), bare)


def session_id_of(path: Column, kind: str, header: Column | None = None) -> Column:
    """Session id of a transcript: its name (claude), the UUID in its name or null (codex), its header or else its name's hex suffix (gemini)."""
    name = F.substring_index(path, "/", -1)
    if kind == "claude":
        return F.regexp_replace(name, r"\.jsonl$", "")
    if kind == "codex":
        return filled(F.regexp_extract(name, r"^rollout-.+?-([0-9a-f-]{36})\.jsonl$", 1))
    short = filled(F.regexp_extract(name, r"^session-.+?-([0-9a-f]+)\.jsonl?$", 1))
    named = F.coalesce(short, F.regexp_replace(name, r"\.jsonl?$", ""))
    return F.coalesce(filled(header), named) if header is not None else named


def external_uuid(platform: str, session: Column, key: Column) -> Column:
    """Dedup key of a message: null if its session or key is."""
    return F.concat(F.lit(f"{platform}:"), session, F.lit(":"), key.cast("string"))


def parse_date_range(c: Column, as_of: dt.datetime) -> Column:
    """Start of a date range, null for no bound. An ISO date counts whatever follows it; a month back keeps the day and runs over."""
    now, s = F.lit(as_of).cast("timestamp_ntz"), F.lower(trim_all(c))
    today = F.to_date(now)
    month = F.make_date(F.year(F.add_months(today, -1)), F.month(F.add_months(today, -1)), F.lit(1))
    shifted = F.date_add(month, F.dayofmonth(today) - 1)
    back = lambda days: F.expr("make_dt_interval(0)") if days is None else now - F.make_dt_interval(days)
    iso = filled(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1))
    days = filled(F.regexp_extract(s, r"^(\d+)_?days?_ago$", 1)).try_cast("int")
    return (
        F.when(iso.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd").cast("timestamp_ntz"))
        .when(s == "today", today.cast("timestamp_ntz"))
        .when(s == "last_week", back(F.lit(7)))
        .when(s == "last_month", shifted.cast("timestamp_ntz") + (now - today.cast("timestamp_ntz")))
        .when(days.isNotNull(), back(days))
    )


def infer_provider(model: Column) -> Column:
    """Provider by the prefix of a model's name, else null."""
    name = F.lower(model)
    #: Prefixes of model names.
    prefixes = {"openai": ["gpt-", "o1-", "o3-", "text-embedding-"], "google": ["gemini-"], "xai": ["grok-"]}
    out = F.lit(None).cast("string")
    for provider, starts in prefixes.items():
        hit = F.lit(False)
        for p in starts:
            hit = hit | name.startswith(p)
        out = F.when(hit, provider).otherwise(out)
    return out


def without_fences(c: Column) -> Column:
    """A model's reply without code fences, trimmed."""
    return trim_all(F.regexp_replace(c, "```json|```", ""))
