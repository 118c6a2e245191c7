"""The corpus queries: each operator over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm.alignment import alignment_counts
from memloom.llm.common import table
from memloom.llm.language import languages
from memloom.llm.lexical import ranked_documents
from memloom.llm.merkle import edited_fingerprints
from memloom.llm.mixing import mix
from memloom.llm.neighbours import embedding_components
from memloom.llm.packing import pack
from memloom.llm.quality import quality_scores
from memloom.llm.simhash import simhash_components
from memloom.llm.substring import dedup_substrings
from memloom.llm.suffixes import repeated_passages
from memloom.llm.toxicity import toxicity_scores
from memloom.llm.urlrules import judge_urls

#: Weights of the mix: domains, then languages within them; all else weighs alike.
WEIGHTS = {("web",): 2.0, ("books",): 1.0, ("web", "en"): 3.0, ("books", "en"): 2.0}


def domain_of(source: Column) -> Column:
    """The tables have no domain: sources numbered below ten stand for the web, the others for books."""
    number = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int")
    return F.when(number < 10, "web").when(number >= 10, "books").otherwise("unknown")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, share=0.5, max_epochs=2.0, domain=domain_of(F.col("source")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), max_distance=4, ngram=4)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=0, folds=5)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), window=20)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), least=50)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out=1, folds=3)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"), held_out=2, folds=4)


#: The rules of the URL query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_document_fingerprints, op2_mixing, op3_simhash_near_dedup, op4_toxicity, op5_embedding_near_dedup,
        op6_substring_dedup, op7_suffix_array_dedup, op8_quality_classifier, op9_best_fit_packing, op10_language_id,
        op11_url_filters, op12_cross_tokenizer_alignment, op13_ranked_lexical_search,
    ]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_URLS = f"""SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)"""
_RULES = ", ".join(str(r) for r in RULES)
_TERM = r"regexp_extract_all(translate(text, {az}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(az=_AZ)


def oracle_sql() -> dict[str, str]:
    """Two of the thirteen can be said in SQL; tokenizers, fitted models, components and XXH64 are beyond it. tests/llm has brute-force versions."""
    return {
        "op11_url_filters": f"""WITH r(host, path, verdict) AS (VALUES {_RULES}), u AS ({_URLS}), m AS (SELECT u.host, u.path, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, arg_max(verdict, (length(r.host || r.path), length(r.host))) AS verdict
 FROM (SELECT DISTINCT host, path FROM u) u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.host, u.path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path""",
        "op13_ranked_lexical_search": f"""WITH t AS (SELECT doc_id, unnest({_TERM}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1),
 a AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L FROM n), q AS (SELECT DISTINCT item_id, unnest({_TERM}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1),
 w AS (SELECT term, CAST(floor(1000 * ln((2.0 * N_ + 2) / (2.0 * df + 1))) AS BIGINT) AS w FROM df, a),
 f AS (SELECT tf.doc_id, tf.term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(n AS BIGINT) * N_) // L)) AS f FROM tf JOIN w USING (term) JOIN n USING (doc_id), a),
 s AS (SELECT item_id, doc_id, CAST(sum(w * f) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
    }
