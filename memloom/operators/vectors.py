"""Products of many vectors with a block of queries: rows stay where they are, each task keeps the best of its own.

Queries are taken in blocks of a bounded number of bytes, which are sent to all tasks; a task goes through its rows in
slices, takes products in double precision, and gives the k best rows of each query at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.shared import written

#: Bytes of a block of queries (a third of a million of 24 dimensions, 2,700 of 3,072), rows of a slice.
BLOCK_BYTES, SLICE = 64 << 20, 1024


class Block:
    """Vectors of a block of queries by length: their places in `ids`, their numbers and their norms."""

    def __init__(self, ids: np.ndarray, vectors: list) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(vectors[i]) for i in order], np.int64)
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            values = np.array([np.asarray(vectors[order[i]], dtype=np.float64) for i in at])
            self.by_size[size] = at, values, np.sqrt(np.einsum("ij,ij->i", values, values))


def blocks(queries: DataFrame, limit: int | None = None) -> Iterator[tuple[DataFrame, Block]]:
    """(the rows of a block, its vectors) of queries (query_id long, vector, ...). The driver passes on one block at a time."""
    queries = written(queries.where("query_id is not null and vector is not null"))
    n, size = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    many = -(-n * 8 * (size or 1) // (limit or BLOCK_BYTES))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, many))))
    for number in range(many):
        own = dealt.where(F.col("_block") == number).drop("_block")
        rows = own.select("query_id", "vector").toArrow()
        yield own, Block(rows["query_id"].to_numpy(), rows["vector"].to_pylist())


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of the vectors of each length in slices; null ones, and empty ones, are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        for i in range(0, len(at), SLICE):
            some = at[i : i + SLICE]
            flat = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
            yield some, flat.astype(np.float64).reshape(len(some), size)


class Best:
    """The k best rows of each query so far: (query, similarity, id), ties by id."""

    def __init__(self, k: int) -> None:
        self.k, self.query, self.sim, self.id = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, sim: np.ndarray, id_: np.ndarray) -> None:
        some = np.isfinite(sim)
        query, sim, id_ = (np.concatenate([x, y[some]]) for x, y in ((self.query, query), (self.sim, sim), (self.id, id_)))
        order = np.lexsort((id_, -sim, query))
        own = query[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        order = order[rank < self.k]
        self.query, self.sim, self.id = query[order], sim[order], id_[order]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.query), pa.array(self.id), pa.array(self.sim)], names=["query_id", "id", "similarity"])


def pair_similarities(pairs: DataFrame, block: Block, k: int) -> DataFrame:
    """(query_id, id, similarity): cosines of pairs (query_id, id, embedding), the k best of each query in each task. Vectors of another length than the query's, and zero ones, give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for b in batches:
            query, ids = b["query_id"].to_numpy(), b["id"].to_numpy()
            place = np.searchsorted(block.ids, query)
            for at, x in matrices(b["embedding"]):
                if x.shape[1] not in block.by_size:
                    continue
                own, values, norms = block.by_size[x.shape[1]]
                i = np.searchsorted(own, place[at])
                met = (i < len(own)) & (own[np.minimum(i, len(own) - 1)] == place[at])
                x, i, at = x[met], i[met], at[met]
                with np.errstate(divide="ignore", invalid="ignore"):
                    sim = np.einsum("ij,ij->i", x, values[i]) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * norms[i])
                best.add(query[at], sim, ids[at])
        yield best.batch()

    return pairs.select("query_id", "id", "embedding").mapInArrow(run, "query_id long, id long, similarity double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 1, limit: int | None = None) -> DataFrame:
    """(query_id, id, similarity): of rows (id, embedding) the k of highest cosine for each of queries (query_id, vector) in each task.

    All queries against all rows, a matrix product for each block and slice; rows are read once a block and not shuffled.
    """
    spark = rows.sparkSession
    found = spark.createDataFrame([], "query_id long, id long, similarity double")
    held = rows.where("embedding is not null and id is not null").select("id", "embedding")

    def against(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(k)
            for b in batches:
                ids = b["id"].to_numpy()
                for at, x in matrices(b["embedding"]):
                    if x.shape[1] not in block.by_size:
                        continue
                    own, values, norms = block.by_size[x.shape[1]]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        sim = (values @ x.T) / norms[:, None] / np.sqrt(np.einsum("ij,ij->i", x, x))[None, :]
                    sim = np.where(np.isfinite(sim), sim, -np.inf)
                    # Ties go to the smaller id: columns in that order, and a stable choice of the k largest.
                    order = np.argsort(ids[at], kind="stable")
                    sim = sim[:, order]
                    top = sim.argmax(axis=1)[:, None] if k == 1 else np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    best.add(np.repeat(block.ids[own], top.shape[1]), np.take_along_axis(sim, top, axis=1).ravel(), ids[at][order][top].ravel())
            yield best.batch()

        return held.mapInArrow(run, "query_id long, id long, similarity double")

    for _, block in blocks(queries.select("query_id", "vector"), limit):
        found = found.union(against(block))
    return found
