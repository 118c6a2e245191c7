"""Ranked lexical search: the best documents for each of many items, by presence masks.

Documents are read twice. First each gives the number of its terms and, of the terms that items ask for, how often they occur; from
that come the statistics of the whole table. Then each task goes through its documents in chunks: every asked
term has a bitmap of the chunk's documents that hold it; an item's bitmaps, turned around, are a mask of matched
terms for each document, and documents with the same mask form a group. A mask's maximum is the sum, over its terms, of
the weight times the largest factor in the chunk. Masks are evaluated by descending maximum, and the item is
finished when the next maximum is below the k-th best score that the task has: no document left can enter. Tasks
give k documents an item, and their best are ranked.

Null texts and texts without a term match nothing and count for nothing. Rows with a null id count as documents and
are ranked, behind others of the same score; repeated rows are ranked each. Items with the same id are one item; those
with a null id or without terms have no results. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import documents_of, encoded, map_frames, materialize

#: Terms of a block of items, which tasks hold (an item with more is a block of its own); entries of a chunk's table of factors.
BLOCK_TERMS, CELLS = 50_000, 1 << 22
#: Letters and digits of ASCII in lower case, a space for its other characters; bytes of others as they are.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return encoded(text).translate(_TERMS).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * df + 1)))


def factors(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurring term's weight is multiplied by; n: the terms of its document."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // length))


class Best:
    """The k best of one item: scores descending, ids ascending, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.doc, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def floor(self) -> int:
        """No document below this score can enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        some = score >= self.floor
        score, doc, null = (np.concatenate([x, y[some]]) for x, y in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def masks_of(bitmaps: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms' bitmaps to (masks, order, first): the distinct masks as rows of bits by term, the documents group after group, and where each group begins."""
    each = np.packbits(np.unpackbits(bitmaps, axis=1, count=documents), axis=0)
    wide = np.zeros((documents, -(-len(each) // 8) * 8), np.uint8)
    wide[:, : len(each)] = each.T
    keys = wide.view(np.uint64)
    order = np.lexsort(keys.T)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if documents else np.zeros(0, np.int64)
    return np.unpackbits(wide[order[first]], axis=1, count=len(bitmaps)), order, first


def evaluate(best: Best, bitmaps: np.ndarray, table: np.ndarray, weights: np.ndarray, most: np.ndarray, doc: np.ndarray, null: np.ndarray) -> int:
    """Adds a chunk's documents to the best of an item, masks by descending maximum; returns how many were scored. Rows of bitmaps, table, weights and most are the item's terms."""
    masks, order, first = masks_of(bitmaps, len(doc))
    maximum = masks.astype(np.int64) @ (weights * most)
    sizes = np.diff(np.append(first, len(order)))
    ranked = np.argsort(-maximum, kind="stable")
    at, step, scored = 0, 8, 0
    while at < len(ranked) and maximum[ranked[at]] >= best.floor:
        some = ranked[at : at + step]
        some = some[maximum[some] >= best.floor]
        own = order[np.repeat(first[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())]
        best.add(weights @ table[:, own], doc[own], null[own])
        scored += len(own)
        at, step = at + step, 2 * step
    return scored


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS, cells: int = CELLS,
                     id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents with a score above 0.

    Items are taken in blocks of about block_terms terms, each block with two passes over the documents.
    """
    spark = docs.sparkSession

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = [(i, t) for i, text in zip(part["doc_id"], part["text"], strict=True) for t in set(terms_of(text))]
            yield pd.DataFrame(own, columns=["item_id", "term"])

    asked = documents_of(items, item_col, item_text).where("doc_id is not null")
    asked = materialize(map_frames(asked, ask, "item_id long, term binary").distinct())
    blocks = -(-asked.count() // block_terms)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    found = spark.createDataFrame([], "item_id long, score long, doc_id long")
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("item_id", "term").collect()  # about block_terms
        found = found.union(_block(documents_of(docs, id_col, text_col), [(r["item_id"], bytes(r["term"])) for r in rows], k, cells))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(texts: DataFrame, asked: list[tuple[int, bytes]], k: int, cells: int) -> DataFrame:
    """(item_id, score, doc_id): the k best of each task for each item."""
    number = {t: i for i, t in enumerate(sorted({t for _, t in asked}))}
    wanted: dict[int, list[int]] = {}
    for item, term in asked:
        wanted.setdefault(item, []).append(number[term])

    def hold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, at, tf = [], [], []
            for text in part["text"]:
                terms = terms_of(text)
                counted = Counter(terms)
                own = sorted((number[t], counted[t]) for t in counted.keys() & number.keys())
                n.append(len(terms))
                at.append(np.array([x for x, _ in own], np.int32))
                tf.append(np.array([x for _, x in own], np.int64))
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n": n, "at": at, "tf": tf})

    held = materialize(map_frames(texts, hold, "doc_id long, n long, at array<int>, tf array<long>").where("n > 0"))
    documents, length = held.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(number), np.int64)
    for r in held.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row a term of the block
        df[r["at"]] = r["count"]
    weights = np.array([weight(documents, x) for x in df.tolist()], np.int64)
    size = max(64, cells // max(1, len(number)) // 8 * 8)
    terms = {item: np.array(sorted(own)) for item, own in wanted.items()}

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {item: Best(k) for item in terms}
        for part in parts:
            for start in range(0, len(part), size):
                some = part.iloc[start : start + size]
                null, doc = some["doc_id"].isna().to_numpy(), some["doc_id"].fillna(0).to_numpy(np.int64)
                many = some["at"].map(len).to_numpy()
                at, tf = (np.concatenate(some[c].to_numpy()).astype(np.int64) for c in ("at", "tf"))
                row = np.repeat(np.arange(len(some)), many)
                table = np.zeros((len(weights), len(some)), np.int64)
                table[at, row] = factors(tf, np.repeat(some["n"].to_numpy(), many), documents, length)
                most, bitmaps = table.max(axis=1), np.packbits(table > 0, axis=1)
                for item, own in terms.items():
                    evaluate(best[item], bitmaps[own], table[own], weights[own], most[own], doc, null)
        for item, b in best.items():
            ids = pd.array(b.doc, "Int64")
            ids[b.null] = pd.NA
            yield pd.DataFrame({"item_id": item, "score": b.score, "doc_id": ids})

    return map_frames(held, score, "item_id long, score long, doc_id long")
