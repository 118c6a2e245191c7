"""Ageing, forgetting and restoring of stored facts; their subject graph; and pages that feed them."""

from __future__ import annotations

import datetime as dt
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Half-lives in days by type; profiles have none.
HALF_LIVES = {"preference": 365.0, "skill": 180.0, "decision": 180.0, "learning": 90.0, "state": 14.0, "relationship": 365.0}
#: Types of edges.
EDGE_TYPES = ["owns", "delegates_to", "advises", "reports_to", "collaborates"]
DAY = 86_400.0


def _now(as_of: dt.datetime) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def _stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def decay_score(facts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """facts with `score`: importance times exp(-age / half-life); access lengthens the half-life by its logarithm. Profiles never decay; unknown types decay as states."""
    age = (_seconds(_now(as_of)) - _seconds(F.coalesce("last_accessed_at", "created_at"))) / DAY
    lives = F.create_map(*(F.lit(x) for kv in HALF_LIVES.items() for x in kv))
    life = F.coalesce(lives[F.col("fact_type")], F.lit(HALF_LIVES["state"])) * (1 + F.log10(F.coalesce("access_count", F.lit(0)) + 1))
    return facts.withColumn("score", F.when(F.col("fact_type") == "profile", float("inf")).otherwise(F.col("importance") * F.exp(-age / life)))


def forget(facts: DataFrame, as_of: dt.datetime, threshold: float = 0.5, dry_run: bool = False) -> DataFrame:
    """facts with `forgotten_now`: active rows below the threshold become inactive, stamped in their metadata; not profiles, not what awaits validation."""
    scored = decay_score(facts, as_of)
    open_ = F.col("is_active") & (F.col("fact_type") != "profile") & (F.coalesce("validation_status", F.lit("")) != "pending")
    hit = F.coalesce(open_ & (F.col("score") < threshold), F.lit(False))
    d = scored.withColumn("forgotten_now", hit).drop("score") if dry_run else scored.withColumn("forgotten_now", hit)
    if dry_run:
        return d
    note = F.create_map(F.lit("forgotten_at"), _stamp(_now(as_of)), F.lit("forgotten_reason"), F.concat(F.lit("decay_score="), F.round("score", 4).cast("string")))
    old = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("forgotten_at", "forgotten_reason"))
    return d.withColumns({
        "metadata": F.when(F.col("forgotten_now"), F.map_concat(old, note)).otherwise(F.col("metadata")),
        "is_active": F.when(F.col("forgotten_now"), F.lit(False)).otherwise(F.col("is_active")),
    }).drop("score")


def restore(facts: DataFrame, as_of: dt.datetime, id: int | None = None, since_minutes: float | None = None, dry_run: bool = False) -> DataFrame:
    """facts with `restored_now`: one forgotten row, or those forgotten within so many minutes, become active and count as just accessed; what forgot them stays on record."""
    if (id is None) == (since_minutes is None):
        raise ValueError("exactly one of id and since_minutes is needed")
    at = F.try_to_timestamp(F.col("metadata")["forgotten_at"], F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    chosen = F.col("id") == id if id is not None else at >= F.lit(as_of - dt.timedelta(minutes=since_minutes)).cast("timestamp_ntz")
    hit = F.coalesce(~F.col("is_active") & F.col("metadata")["forgotten_at"].isNotNull() & chosen, F.lit(False))
    d = facts.withColumn("restored_now", hit)
    if dry_run:
        return d
    old = F.map_filter("metadata", lambda k, v: k != "restored_at")
    stamp = _now(as_of).cast(facts.schema["last_accessed_at"].dataType)
    return d.withColumns({
        "metadata": F.when(F.col("restored_now"), F.map_concat(old, F.create_map(F.lit("restored_at"), _stamp(_now(as_of))))).otherwise(F.col("metadata")),
        "last_accessed_at": F.when(F.col("restored_now"), stamp).otherwise(F.col("last_accessed_at")),
        "is_active": F.col("is_active") | F.col("restored_now"),
    })


def forgetting_report(facts: DataFrame) -> DataFrame:
    """(fact_type, forgotten): of each type, and of all under a null type."""
    gone = facts.where(~F.col("is_active") & F.col("metadata")["forgotten_at"].isNotNull())
    return gone.rollup("fact_type").agg(F.count("*").alias("forgotten"))


def record_access(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """facts with access_count and last_accessed_at after hits (id, ts): hits of one id are summed before they meet their fact."""
    sums = hits.groupBy("id").agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    j = facts.join(sums, "id", "left")
    kind = facts.schema["access_count"].dataType
    return j.withColumns({
        "access_count": (F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast(kind), "last_accessed_at": F.greatest("_ts", "last_accessed_at"),
    }).select(*facts.columns)


def assign_tier(facts: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """facts with `tier`: the last days whole (short_term), older ones without text (long_term)."""
    short = F.col("created_at") >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    tier = F.when(short, "short_term").otherwise("long_term")
    return facts.withColumn("tier", tier).withColumn("content", F.when(F.col("tier") == "short_term", F.col("content")))


def expand_subjects(facts: DataFrame, edges: DataFrame, seeds: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Facts of seed subjects (subject_id) and of their neighbours in either direction, that share a tag with `tags` if given."""
    known = seeds.select("subject_id").distinct()
    out = edges.join(known, F.col("from_id") == F.col("subject_id")).select(F.col("to_id").alias("subject_id"))
    into = edges.join(known, F.col("to_id") == F.col("subject_id")).select(F.col("from_id").alias("subject_id"))
    reached = known.union(out).union(into).distinct()
    found = facts.join(reached, "subject_id", "left_semi")
    return found if tags is None else found.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags))))


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with new (from_id, to_id, relationship_type) triples of known types between different subjects."""
    key = ["from_id", "to_id", "relationship_type"]
    ok = new.where((F.col("from_id") != F.col("to_id")) & F.col("relationship_type").isin(EDGE_TYPES)).select(*key).distinct()
    return edges.select(*key).union(ok.join(edges.select(*key), key, "left_anti"))


def edge_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalized(pages: DataFrame, text_col: str = "plaintext") -> DataFrame:
    """pages with the text in NFC and its `content_hash`: SHA-256 with white space collapsed. NFC has no built-in; of texts of ASCII alone, which it leaves as they are, Python sees a null."""
    plain = F.regexp_like(F.col(text_col), F.lit("^[\\x00-\\x7F]*$"))
    whole = pages.withColumn(text_col, F.coalesce(_nfc(F.when(~plain, F.col(text_col))), F.col(text_col)))
    tidy = F.trim(F.regexp_replace(text_col, r"[\s\p{Z}]+", " "))
    return whole.withColumn("content_hash", F.sha2(F.coalesce(tidy, F.lit("")), 256))


def sync_pages(sources: DataFrame, pages: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(registry, pages with `status` new, changed or unchanged). sources: (provider, external_id, content_hash, last_synced_at)."""
    key = ["provider", "external_id"]
    p = normalized(pages)
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col("content_hash"), "unchanged").otherwise("changed")
    judged = p.join(sources.select(*key, F.col("content_hash").alias("_old")), key, "left").withColumn("status", status).drop("_old")
    seen = judged.select(*key, F.col("content_hash").alias("_hash"), "status")
    j = sources.join(seen, key, "full")
    stamp = _now(as_of).cast(sources.schema["last_synced_at"].dataType)
    moved = F.col("status").isin("new", "changed")
    registry = j.select(*key, F.coalesce("_hash", "content_hash").alias("content_hash"), F.when(moved, stamp).otherwise(F.col("last_synced_at")).alias("last_synced_at"))
    return registry, judged
