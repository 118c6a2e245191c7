"""Keyword search by an inverted index of trigrams.

A list of the index holds the ids of one user's messages, out of a range of ids, in whose lower-case text a
trigram occurs. A pattern's literal runs (what lies between its wildcards) give the trigrams that a message must have; the lists of a
range are intersected, and what is left is verified with the pattern itself. Patterns whose runs are all shorter
than three letters are verified against all messages of their user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.search import _few, _ranked, matches

#: Ids of a list at most: a frequent trigram of a busy user is many lists.
RANGE = 1 << 14


def grams_of(text: Column) -> Column:
    """The different runs of three characters."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: text.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def keyword_index(memory: DataFrame, size: int = RANGE) -> DataFrame:
    """(user_id, gram, range, ids) of memory (id, user_id, message): write it, and append the index of rows that are added."""
    rows = memory.where("message is not null").select("user_id", "id", F.explode(grams_of(F.lower("message"))).alias("gram"))
    return rows.groupBy("user_id", "gram", F.expr(f"id div {size}").alias("range")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def pattern_grams(text: Column) -> Column:
    """Trigrams of the literal runs of a pattern of `like`: `%` and `_` end a run, and so do a backslash and what it escapes."""
    runs = F.split(F.regexp_replace(F.lower(text), r"(?s)\\\\.|[%_\\\\]", "\u0000"), "\u0000")
    return F.array_distinct(F.flatten(F.transform(runs, grams_of)))


def keyword_candidates(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id) of the messages of a query's user that have all trigrams of its text; queries: (query_id, q_user, q_raw) with such trigrams."""
    asked = queries.select("query_id", "q_user", pattern_grams(F.col("q_raw")).alias("_grams"))
    asked = asked.select("query_id", "q_user", F.size("_grams").alias("_n"), F.explode("_grams").alias("_gram"))
    met = index.join(_few(asked), (F.col("user_id") == F.col("q_user")) & (F.col("gram") == F.col("_gram")))
    # Rows that are added later have lists of their own: those of a trigram and range are one.
    whole = met.groupBy("query_id", "range", "_n", "gram").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    every = whole.groupBy("query_id", "range", "_n").agg(F.collect_list("ids").alias("_lists")).where(F.size("_lists") == F.col("_n"))
    both = F.aggregate(F.slice("_lists", 2, F.greatest(F.size("_lists"), F.lit(1))), F.col("_lists")[0], F.array_intersect)
    return every.select("query_id", F.explode(both).alias("id"))


def search_keyword_indexed(memory: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id, rank) as search_keyword gives them, testing only messages that the index leaves."""
    rows = memory.select("id", "user_id", "role", "agent_platform", "p_tag_id", "is_active", "created_at", "message")
    wanted = queries.drop("q_vector").where("q_text is not null")
    short = F.size(pattern_grams(F.col("q_raw"))) == 0
    like = F.expr("message ilike concat('%', q_raw, '%')")
    found = keyword_candidates(index, wanted.where(~short)).join(_few(wanted), "query_id")
    # Candidates and rows meet by id, so a row is tested for the queries whose trigrams it has.
    kept = rows.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).where(matches() & like)
    rest = rows.join(_few(wanted.where(short)), matches() & like)
    columns = ["query_id", "id", "created_at", "q_k"]
    return _ranked(kept.select(columns).union(rest.select(columns)), F.desc("created_at"), F.asc("id")).select("query_id", "id", "rank")
