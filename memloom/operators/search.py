"""Search over the memory table for many queries at once.

A query is a row (query_id, user_id, text, vector, p_tag, date_range, role, platform, include_archived, k),
all but the first two nullable. Queries are few; the memory table is not: queries are broadcast if they
fit `MAX_QUERIES`, which is checked, else each is matched by a join on the user.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import parse_date_range, slug, trim_all
from memloom.operators.vectors import blocks, nearest, pair_similarities
from memloom.sources.shared import written

#: Queries that are sent to every task at once (64 MB at 3,072 dimensions of 4 bytes and a margin).
MAX_QUERIES = 4000
#: Largest k.
MOST = 50
FILTERS = ["query_id", "user_id", "text", "vector", "p_tag", "date_range", "role", "platform", "include_archived", "k"]


def prepare_queries(queries: DataFrame, aliases: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Queries with root tag id, start of their date range, k from 1 to 50 (10 if null), and `unknown_tag`."""
    q = queries.select(*(F.col(c) for c in FILTERS)).withColumn("_tag", F.nullif(slug(F.col("p_tag")), F.lit("")))
    q = q.join(aliases.select(F.col("name").alias("_tag"), "root_id"), "_tag", "left")
    asked = F.coalesce(F.col("p_tag"), F.lit("")) != ""
    return q.select(
        "query_id", F.col("user_id").alias("q_user"), F.nullif(trim_all(F.col("text")), F.lit("")).alias("q_text"), F.col("text").alias("q_raw"), F.col("vector").alias("q_vector"),
        F.col("root_id").alias("q_tag"), (asked & F.col("root_id").isNull()).alias("unknown_tag"), parse_date_range(F.col("date_range"), as_of).alias("q_since"),
        F.col("role").alias("q_role"), F.col("platform").alias("q_platform"), F.coalesce("include_archived", F.lit(False)).alias("q_archived"),
        F.greatest(F.lit(1), F.least(F.lit(MOST), F.coalesce("k", F.lit(10)))).alias("q_k"),
    )


def matches() -> F.Column:
    """A row of memory meets a prepared query's filters."""
    free = lambda q, c: F.col(q).isNull() | (F.col(q) == F.col(c))
    return (
        (F.col("user_id") == F.col("q_user")) & (F.col("q_archived") | F.col("is_active")) & free("q_tag", "p_tag_id") & free("q_role", "role")
        & free("q_platform", "agent_platform") & (F.col("q_since").isNull() | (F.col("created_at") >= F.col("q_since")))
    )


def filter_memory(memory: DataFrame, user_id: int | None = None, include_archived: bool = False, p_tag_id: int | None = None, since: dt.datetime | None = None,
                  role: str | None = None, platform: str | None = None) -> DataFrame:
    """One query's filters as plain predicates, which reach the scan."""
    out = memory
    for column, value in (("user_id", user_id), ("p_tag_id", p_tag_id), ("role", role), ("agent_platform", platform)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if include_archived else out.where("is_active")
    return out if since is None else out.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))


def _few(queries: DataFrame) -> DataFrame:
    return F.broadcast(queries) if queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES else queries


def _ranked(hits: DataFrame, *order: F.Column) -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where((F.col("rank") <= MOST) & (F.col("rank") <= F.col("q_k")))  # the literal bound cuts groups before the exchange


def search_recent(memory: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, rank) of the newest rows for each prepared query."""
    rows = memory.select("id", "user_id", "role", "agent_platform", "p_tag_id", "is_active", "created_at")
    return _ranked(rows.join(_few(queries.drop("q_vector")), matches()), F.desc("created_at"), F.asc("id")).select("query_id", "id", "rank")


def search_keyword(memory: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, rank) of the newest rows whose text holds the query's, in any case; % and _ in it are wildcards."""
    rows = memory.select("id", "user_id", "role", "agent_platform", "p_tag_id", "is_active", "created_at", "message")
    like = F.expr("message ilike concat('%', q_raw, '%')")
    return _ranked(rows.join(_few(queries.drop("q_vector").where("q_text is not null")), matches() & like), F.desc("created_at"), F.asc("id")).select("query_id", "id", "rank")


def search_vector(memory: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, rank, similarity): exact cosine top k among the rows of the query's user that meet its filters.

    Queries go in blocks of bounded size to the rows, which are not shuffled: filters are a broadcast join, products are taken
    in the tasks, and each gives its best of a query (see vectors.py). Zero vectors and vectors of another length match nothing.
    """
    wanted = queries.where("q_text is not null and q_vector is not null").withColumnRenamed("q_vector", "vector").withColumn("query_id", F.col("query_id").cast("long"))
    rows = memory.where("embedding is not null").select(F.col("id").cast("long").alias("id"), "user_id", "role", "agent_platform", "p_tag_id", "is_active", "created_at", "embedding")
    hits = memory.sparkSession.createDataFrame([], "query_id long, id long, similarity double, q_k int")
    for own, block in blocks(wanted):
        filters = F.broadcast(own.drop("vector"))
        found = pair_similarities(rows.join(filters, matches()), block, MOST)
        hits = hits.union(found.join(F.broadcast(own.select("query_id", "q_k")), "query_id").select("query_id", "id", "similarity", "q_k"))
    return _ranked(hits, F.desc("similarity"), F.asc("id")).select("query_id", "id", "rank", "similarity")


def nearest_in_blocks(rows: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, id, similarity): of rows (id, embedding) the one of highest cosine for each of queries (query_id, vector), ties by id.

    All queries against all rows: blocks of queries (of `limit` bytes) go to the rows, and each task gives one row a query. Zero vectors,
    null ones and those of another length match nothing.
    """
    top = nearest(rows, queries, limit=limit).groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("id")).alias("i"))).alias("t"))
    return top.select("query_id", (-F.col("t.i")).alias("id"), "t.similarity")


def search_hybrid(memory: DataFrame, queries: DataFrame, aliases: DataFrame, as_of: dt.datetime, threshold: float = 0.3) -> DataFrame:
    """(query_id, used, top_similarity, rank, id, similarity), a row a hit and one for queries without any.

    Vectors first; if there are none, or the best is below the threshold, keyword hits where there are any.
    Queries without text give the newest rows; an unknown tag gives nothing (`none`).
    """
    q = prepare_queries(queries, aliases, as_of)
    known = q.where("not unknown_tag")
    vector = written(search_vector(memory, known))  # read by four legs
    top = vector.groupBy("query_id").agg(F.max("similarity").alias("top"))
    need = known.where("q_text is not null").join(top, "query_id", "left").where(F.col("top").isNull() | (F.col("top") < threshold)).drop("top")
    keyword = search_keyword(memory, need)
    recent = search_recent(memory, known.where("q_text is null"))
    none = F.lit(None).cast("double")
    swapped = keyword.select("query_id").distinct()
    legs = (
        vector.join(swapped, "query_id", "left_anti").join(top, "query_id").select("query_id", F.lit("vector").alias("used"), F.col("top").alias("top_similarity"), "rank", "id", "similarity")
        .union(keyword.select("query_id", F.lit("ilike"), none, "rank", "id", none))
        .union(recent.select("query_id", F.lit("recency"), none, "rank", "id", none))
    )
    empty = q.join(legs.select("query_id").distinct(), "query_id", "left_anti")
    void = lambda t: F.lit(None).cast(t)
    return legs.union(empty.select("query_id", F.when(F.col("unknown_tag"), "none").otherwise("recency"), none, void("int"), void("long"), none))
