"""A training corpus in five stages: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns
of documents; the last returns the packed pieces. A stage's result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import materialize, table
from memloom.llm.labelled import BROADCAST_ROWS
from memloom.llm.mixing import mix
from memloom.llm.packing import pack
from memloom.llm.quality import quality_scores
from memloom.llm.simhash import similar_groups
from memloom.llm.substring import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: As in the mixing query, which reads the tables themselves.
WEIGHTS = {("web",): 2.0, ("books",): 1.0, ("web", "en"): 3.0, ("books", "en"): 2.0}


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the ids in gone. Up to BROADCAST_ROWS ids (8 bytes each) are sent to the documents, so their texts stay where they are; more are joined by shuffle."""
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.select(COLUMNS).join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking rejects go; those without an id stay. Null and empty texts are judged like others, repeated rows alike; without labels, and of an empty table, nothing goes."""
    judged = materialize(quality_scores(docs, table(spark, sf_dir, "labels")))
    return _without(docs, judged.where("predicted = 0").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, whatever its place; rows that repeat this id all stay.

    Texts without a word and rows without an id are in no group and stay; an empty table stays empty.
    """
    groups = materialize(similar_groups(docs, similarity=0.8, ngram=5))
    return _without(docs, groups.where("doc_id <> component_id").select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that also start earlier go; texts of which nothing is left go with them."""
    left = dedup_substrings(docs, window=20, texts=True, carry=("lang", "source"))
    kept = left.where("n_removed = 0 or n_removed < n_words")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, shared among domains, languages and sources by weight; no row twice.

    Null labels are a leaf of their own; texts without a word come where their place is taken. Rows that repeat
    an id come together; those without one stay away from a prefix's last cell. An empty table stays empty.
    """
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    domain = F.when(number < 10, "web").when(number >= 10, "books").otherwise("unknown")
    return mix(docs.select(COLUMNS), WEIGHTS, share=0.8, max_epochs=1.0, domain=domain, keep=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences. Null and empty texts are a piece of their end token; repeated rows are packed each; an empty table gives no sequence."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]

#: Fitted models, fingerprints and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
