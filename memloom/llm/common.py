"""Small pieces that the corpus operators share: inputs, written tables, hashing of words, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memloom.sources.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch of whole texts on the way to Python, which the executor and its worker both hold.
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, stays columnar and compressed.

    batch_rows: Python gets batches of so many rows at most while df is written; the session's setting stands again after it.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    before = spark.conf.get(_BATCH)
    if batch_rows:
        spark.conf.set(_BATCH, str(batch_rows if int(before) <= 0 else min(batch_rows, int(before))))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names: whatever else the input has can neither clash nor be shuffled."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """df.mapInPandas(run, schema), in which numbers beside null stay whole: pandas would hold them as floats, which alters ids above 2**53."""
    target = to_arrow_schema(T._parse_datatype_string(schema))
    whole = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({f.name: c.to_pandas(types_mapper=whole.get if c.null_count else None) for f, c in zip(b.schema, b.columns, strict=True)})

        for out in run(frames()):
            yield pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    return df.mapInArrow(arrow, schema)


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def chunks(texts: pd.Series, limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts in UTF-8, with the place of the first: about limit bytes together, one text at least. Bounds the arrays made from them."""
    start, size, out = 0, 0, []
    for text in texts:
        own = encoded(text)
        if out and size + len(own) > limit:
            yield start, out
            start, size, out = start + len(out), 0, []
        out.append(own)
        size += len(own) + 1
    if out:
        yield start, out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer text asks for them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = 1 << (n - 1).bit_length()
            up = np.full(m, _BASE, dtype=np.uint64)
            down = np.full(m, _BASE_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of many texts at once.

    Returns the joined bytes; each word's start and end there; its 64-bit hash; and for each text the
    number of its first word (one entry more than texts).
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _POWERS.get(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, starts, ends, hashes, np.searchsorted(starts, offsets)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words (len - k + 1 of them)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[: n - k + 1])


def run_hashes_by_row(words: np.ndarray, k: int) -> np.ndarray:
    """run_hashes of each row of a matrix."""
    up, down = _POWERS.get(words.shape[1] + 1)
    total = np.zeros((len(words), words.shape[1] + 1), dtype=np.uint64)
    np.cumsum(words * up[:-1], axis=1, out=total[:, 1:])
    return mix64((total[:, k:] - total[:, :-k]) * down[: words.shape[1] - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if step else out
        have += step
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that occurs in edges; component is one id of the component.

    Contraction rounds: each vertex hooks to its smallest neighbour under a scrambled order, hooks are
    shortened twice, edges are renamed and loops dropped, until none is left. Aggregations combine
    before the shuffle, joins have one row per key on one side, so a vertex with very many edges or a
    component with very many vertices can be split by AQE. Nothing passes through the driver.
    """
    scramble = lambda c: F.xxhash64(F.col(c).cast("long"))  # noqa: E731 - one-to-one on a single long
    ends = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null")
    ends = materialize(ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    nodes = ends.select(F.col("x").alias("id")).union(ends.select("y")).distinct()
    nodes = nodes.select("id", scramble("id").alias("label"))
    e = ends.where("x <> y").select(scramble("x").alias("x"), scramble("y").alias("y"))
    e = materialize(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    hooks = []

    def follow(frame: DataFrame, col: str, to: DataFrame) -> DataFrame:
        to = to.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        return frame.join(to, frame[col] == F.col("_v"), "left").withColumn(col, F.coalesce("_p", col)).drop("_v", "_p")

    while not e.isEmpty():
        hook = materialize(e.groupBy(F.col("y").alias("v")).agg(F.min("x").alias("p")))
        twice = materialize(follow(follow(hook, "p", hook), "p", hook))
        hooks.append(twice)
        e = follow(follow(e, "x", twice), "y", twice).where("x <> y")
        e = materialize(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    for h in hooks:
        nodes = follow(nodes, "label", h)
    labels = materialize(nodes)
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
