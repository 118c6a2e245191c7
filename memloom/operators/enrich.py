"""The enrichment queue: what is pending, prompts, replies, and merging outcomes back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.functions.text import slug, trim_all, without_fences
from memloom.operators.writes import get_or_create_dim
from memloom.sources.shared import fresh_path, written

REPLY = "struct<p_tag:string,d_tag:array<string>>"


def claim_pending(memory: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Rows without vector or tag that are past their error's cooldown, active and old ones first; flags say what they need."""
    wait = F.when(F.col("is_active"), F.expr("interval 5 minutes")).otherwise(F.expr("interval 1 hour"))
    due = F.col("cold_error").isNull() | (F.col("updated_at") < as_of - wait)
    rows = memory.where((F.col("embedding").isNull() | ~F.col("tag_processed")) & due)
    rows = rows.select(
        "id", "message", "role", "agent_platform", "agent_model", "is_active", "created_at", (~F.col("tag_processed")).alias("needs_tag"), F.col("embedding").isNull().alias("needs_embed")
    )
    return rows if limit is None else rows.orderBy(F.desc("is_active"), "created_at", "id").limit(limit)


def tag_candidates(tags: DataFrame, n: int = 20) -> DataFrame:
    """The first n root tags: the list that a prompt shows."""
    return tags.where("alias_of is null").orderBy("id").limit(n).select("id", "name")


def build_tag_prompts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, prompt). The candidates are one row of at most as many names as tag_candidates gives."""
    names = candidates.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ", ").alias("names"))
    listed = F.when(F.col("names") == "", "(none)").otherwise(F.col("names"))
    joined = rows.join(F.broadcast(names))
    return joined.select("id", F.concat(F.lit("candidates: "), listed, F.lit("\nrole="), F.col("role"), F.lit("\nmessage: "), F.col("message")).alias("prompt"))


def parsed_reply(raw: Column) -> Column:
    """The reply's struct, null if it is no JSON object."""
    text = without_fences(raw)
    return F.when(F.try_parse_json(text).isNotNull() & text.startswith("{"), F.from_json(text, REPLY))


def clean_d_tags(d: Column) -> Column:
    kept = F.filter(F.transform(d, slug), lambda x: (F.length(x) > 0) & (F.length(x) <= 50))
    return F.coalesce(F.slice(kept, 1, 5), F.array().cast("array<string>"))


def parse_tag_output(responses: DataFrame, tags: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, p_tag_id, d_tag, error), tags): `NEW:` names are created or found, known names give their root, others null.

    aliases: (name, id, root_id) of resolve_aliases.
    """
    r = responses.withColumn("_r", parsed_reply(F.col("raw")))
    given = F.col("_r.p_tag")
    fresh = given.startswith("NEW:")
    wanted = F.when(fresh, slug(F.substring(given, 5, 1_000_000))).otherwise(slug(given))
    r = r.select("id", "raw", "_r", F.nullif(wanted, F.lit("")).alias("_name"), F.coalesce(fresh, F.lit(False)).alias("_fresh"))
    r = written(r)  # read by the new names and by the rows
    whole, made = get_or_create_dim(tags, r.where("_fresh and _name is not null").select(F.col("_name").alias("name")), aliases)
    ids = aliases.select(F.col("name").alias("_name"), "root_id", F.lit(None).cast(made.schema["id"].dataType).alias("_made"))
    ids = ids.union(made.select("name", F.lit(None).cast(aliases.schema["root_id"].dataType), "id")).groupBy("_name").agg(F.max("root_id").alias("root_id"), F.max("_made").alias("_made"))
    joined = r.join(ids, "_name", "left")
    tag_id = F.when(F.col("_fresh"), F.coalesce("root_id", "_made")).otherwise(F.col("root_id"))
    error = F.when(F.col("_r").isNull(), F.concat(F.lit("invalid JSON: "), F.substring(F.coalesce("raw", F.lit("")), 1, 200)))
    return joined.select("id", tag_id.alias("p_tag_id"), clean_d_tags(F.col("_r.d_tag")).alias("d_tag"), error.alias("error")), whole


def merge_outcomes(pending: DataFrame, tag_out: DataFrame, embed_out: DataFrame) -> DataFrame:
    """(id, p_tag_id, d_tag, tag_processed, embedding, cold_error): tags and vectors succeed apart; if both fail nothing is filled.

    tag_out: (id, p_tag_id, d_tag, error); embed_out: (id, embedding, error).
    """
    t = tag_out.select("id", F.col("p_tag_id").alias("_p"), F.col("d_tag").alias("_d"), F.col("error").alias("_te"))
    e = embed_out.select("id", F.col("embedding").alias("_v"), F.col("error").alias("_ee"))
    j = pending.select("id", "needs_tag", "needs_embed").join(t, "id", "left").join(e, "id", "left")
    te, ee = F.when(F.col("needs_tag"), F.col("_te")), F.when(F.col("needs_embed"), F.col("_ee"))
    both = te.isNotNull() & ee.isNotNull()
    tagged = F.col("needs_tag") & te.isNull() & F.col("_d").isNotNull()
    parts = F.concat_ws(" | ", F.concat(F.lit("tag: "), F.substring(te, 1, 200)), F.concat(F.lit("embed: "), F.substring(ee, 1, 200)))
    failed = F.concat(F.lit("tag+embed both failed: tag="), F.substring(te, 1, 80), F.lit(" embed="), F.substring(ee, 1, 80))
    return j.select(
        "id", F.when(tagged, F.col("_p")).alias("p_tag_id"), F.when(tagged, F.col("_d")).alias("d_tag"), F.coalesce(tagged, F.lit(False)).alias("tag_processed"),
        F.when(F.col("needs_embed") & ee.isNull(), F.col("_v")).alias("embedding"), F.when(both, failed).otherwise(F.nullif(parts, F.lit(""))).alias("cold_error"),
    )


def apply_outcomes(memory: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The memory table with merged outcomes: what succeeded is filled in, the rest kept."""
    o = outcomes.select("id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in ("p_tag_id", "d_tag", "tag_processed", "embedding", "cold_error")))
    done, hit = F.coalesce("_tag_processed", F.lit(False)), F.coalesce("_hit", F.lit(False))
    stamp = as_of.cast(memory.schema["updated_at"].dataType)
    return memory.join(o, "id", "left").withColumns({
        "p_tag_id": F.when(done, F.col("_p_tag_id")).otherwise(F.col("p_tag_id")), "d_tag": F.when(done, F.col("_d_tag")).otherwise(F.col("d_tag")),
        "tag_processed": F.col("tag_processed") | done, "embedding": F.coalesce("_embedding", "embedding"),
        "cold_error": F.when(hit, F.col("_cold_error")).otherwise(F.col("cold_error")), "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
    }).select(*memory.columns)


def prepare_embedding_input(rows: DataFrame, limit: int = 8000) -> DataFrame:
    """(id, input): the text that is sent to an embedding model, which takes so many characters."""
    return rows.select("id", F.substring(trim_all(F.col("message")), 1, limit).alias("input"))


def check_embedding(df: DataFrame, dim: int) -> DataFrame:
    """(id, embedding, error): vectors of another length become errors."""
    n = F.size("embedding")
    ok = F.col("embedding").isNotNull() & (n == dim)
    error = F.when(~ok, F.when(F.col("embedding").isNull(), "no embedding").otherwise(F.concat(F.lit("embedding has "), n.cast("string"), F.lit(f" values, not {dim}"))))
    return df.select("id", F.when(ok, F.col("embedding")).alias("embedding"), error.alias("error"))


def is_transient(e: Exception) -> bool:
    """Whether another try may help: rate limits, timeouts, lost connections."""
    #: The status of a rate limit, and codes of network errors.
    return getattr(e, "status", None) == 429 or getattr(e, "code", None) in ("ETIMEDOUT", "ECONNRESET") or isinstance(e, (TimeoutError, ConnectionError))


def with_model_fn(
    df: DataFrame, fn: Callable[[list[str]], list], in_col: str, out_col: str, out_type: T.DataType | str = "string", tries: int = 3, batch: int = 256, parallel: int = 4,
    wait: float = 1.0, longest: float = 5.0, transient: Callable[[Exception], bool] = is_transient,
) -> DataFrame:
    """df with out_col and `error`: fn gets lists of up to `batch` values, `parallel` of them at once in each task; rows keep their order.

    A transient error is tried again, `tries` times in all, after a wait that doubles from `wait` up to `longest` seconds.
    Any other error of a list is asked for again value by value, so that one bad value does not fail the others; of
    a single value it is final. The result is lazy: each use of it asks again, so write it, or use `answered`.
    """
    kind = T._parse_datatype_string(out_type) if isinstance(out_type, str) else out_type
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, kind), T.StructField("error", T.StringType())])

    def ask(values: list[str]) -> list[tuple]:
        error: Exception | None = None
        for attempt in range(tries):
            try:
                got = list(fn(values))
                if len(got) == len(values):
                    return [(v, None) for v in got]
                error = ValueError("a result for each value is needed")
            except Exception as e:  # noqa: BLE001 - whatever the caller's function raises belongs to the row
                error = e
            if attempt + 1 == tries or not transient(error):
                break
            time.sleep(min(wait * 2**attempt, longest))
        if len(values) > 1 and not transient(error):
            return [x for v in values for x in ask([v])]
        return [(None, str(error) or type(error).__name__)] * len(values)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            for part in parts:
                values = list(part[in_col])
                got = [x for some in pool.map(ask, [values[i : i + batch] for i in range(0, len(values), batch)]) for x in some]
                part[out_col], part["error"] = [g[0] for g in got], [g[1] for g in got]
                yield part

    return df.mapInPandas(run, schema)


def answered(df: DataFrame, fn: Callable[[list[str]], list], in_col: str, out_col: str, out_type: str = "string", store: str | None = None, number: int = 0, **more: object) -> DataFrame:
    """df (id, in_col) with out_col and `error`, each row asked once: replies are written to the store before anyone sees them.

    store: a folder of this function's own, kept by the caller over restarts; a new one if None. A reply is known by id and hash of its
    text. Round `number` takes known replies, and known errors if they are its own: so a round that is run again asks only
    what it had not written, and a later round asks again for what had failed. (A task that Spark runs again asks its
    own rows again.) Rows without an id are asked by their text alone.
    """
    spark = df.sparkSession
    store = store or fresh_path(spark)
    kind = T._parse_datatype_string(out_type)
    keyed = df.withColumn("_hash", F.sha2(F.coalesce(F.col(in_col), F.lit("")), 256))
    schema = T.StructType([df.schema["id"], T.StructField("_hash", T.StringType()), T.StructField(out_col, kind), T.StructField("error", T.StringType()), T.StructField("round", T.LongType())])
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["_hash"] == y["_hash"])

    def known() -> DataFrame:
        try:
            stored = spark.read.schema(schema).parquet(store)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)
        rows = stored.where(F.col("error").isNull() | (F.col("round") == number))
        return rows.groupBy("id", "_hash").agg(F.max_by(F.struct(out_col, "error"), F.struct(F.col("error").isNull(), "round")).alias("_r")).select("id", "_hash", "_r.*")

    have = known()
    new = keyed.dropDuplicates(["id", "_hash"])
    new = new.join(have, same(new, have), "left_anti")
    asked = with_model_fn(new.select("id", "_hash", in_col), fn, in_col, out_col, kind, **more)
    asked.select("id", "_hash", out_col, "error", F.lit(number).cast("long").alias("round")).write.mode("append").parquet(store)
    have = known()
    return keyed.join(have, same(keyed, have), "left").select(*(keyed[c] for c in df.columns), have[out_col], have["error"])
