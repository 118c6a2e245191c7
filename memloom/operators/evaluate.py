"""Comparing taggers: samples, classes of replies, and a summary by model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import slug, without_fences


def sample_by_role(memory: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n active rows: half (rounded down) of users, the rest of assistants, in the order of the MD5 of `id:seed`."""
    half = n // 2
    rows = memory.where("is_active and role in ('user', 'assistant')").select("id", "role", "message", "p_tag_id", "d_tag")
    order = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))
    rank = F.row_number().over(Window.partitionBy("role").orderBy(order, "id"))
    kept = F.col("rank") <= F.when(F.col("role") == "user", half).otherwise(n - half)
    return rows.withColumn("rank", rank).where((F.col("rank") <= n - half) & kept).drop("rank")  # the literal bound cuts groups before the exchange


def classify_tag_responses(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """responses with `parse_ok` and `matched`: parse-fail, null, new, existing or rejected. candidates: (name) of tag_candidates."""
    text = without_fences(F.col("raw"))
    ok = F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False)) & F.col("error").isNull()
    tag = F.get_json_object(text, "$.p_tag")
    names = candidates.select(F.lower("name").alias("_name")).distinct().withColumn("_known", F.lit(True))
    j = responses.withColumns({"parse_ok": ok, "_tag": tag}).withColumn("_name", slug(F.col("_tag"))).join(names, "_name", "left")
    matched = (
        F.when(~F.col("parse_ok"), "parse-fail").when(F.col("_tag").isNull(), "null").when(F.col("_tag").startswith("NEW:"), "new").when(F.col("_known"), "existing").otherwise("rejected")
    )
    return j.withColumn("matched", matched).select(*responses.columns, "parse_ok", "matched")


def summarize_tagger(results: DataFrame, prices: DataFrame) -> DataFrame:
    """One row a model: parse and class counts, mean and nearest-rank p95 latency, tokens, cost, and the first five errors by id.

    results: classified (id, model, raw, latency_ms, input_tokens, output_tokens, error); prices: (model, input, output) for a million tokens.
    p95 comes from counts by latency, so no list of all latencies is gathered.
    """
    fine = F.col("error").isNull()
    n = lambda what: F.count_if(F.col("matched") == what)
    sums = results.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if("parse_ok").alias("parse_ok"), n("existing").alias("matched_existing"), n("new").alias("matched_new"),
        n("null").alias("matched_null"), n("rejected").alias("rejected"), F.coalesce(F.avg(F.when(fine, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum(F.when(fine, F.col("input_tokens"))), F.lit(0)).alias("total_input_tokens"), F.coalesce(F.sum(F.when(fine, F.col("output_tokens"))), F.lit(0)).alias("total_output_tokens"),
    )
    by = results.where(fine).groupBy("model", "latency_ms").agg(F.count("*").alias("n"))
    w = Window.partitionBy("model")
    upto = by.withColumn("upto", F.sum("n").over(w.orderBy("latency_ms"))).withColumn("all", F.sum("n").over(w))
    place = F.least(F.col("all") - 1, F.floor(F.col("all") * 0.95))
    p95 = upto.where(F.col("upto") > place).groupBy("model").agg(F.min("latency_ms").alias("p95_latency_ms"))
    first = Window.partitionBy("model").orderBy("id")
    errors = results.where("error is not null").select("model", "id", "error").withColumn("rank", F.row_number().over(first)).where("rank <= 5")
    errors = errors.groupBy("model").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "error"))), lambda x: x["error"]).alias("errors"))
    price = prices.select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    j = sums.join(p95, "model", "left").join(errors, "model", "left").join(price, "model", "left")
    cost = F.col("total_input_tokens") / 1e6 * F.col("_in") + F.col("total_output_tokens") / 1e6 * F.col("_out")
    return j.withColumns({"est_cost_usd": cost, "p95_latency_ms": F.coalesce("p95_latency_ms", F.lit(0)), "errors": F.coalesce("errors", F.array().cast("array<string>"))}).drop("_in", "_out")
