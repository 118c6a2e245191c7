"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits recursively along a random direction at the median of a bounded sample; vectors within a
margin of the split go to both sides (spill), the margin being as wide as a random direction spreads two
vectors at the wanted cosine. Splits that would send most vectors to both sides are not made. Every vector
is dropped through all trees, and vectors are compared within leaves; a leaf larger than `tile` rows is
compared in pairs of tiles, so no leaf is cut short and none meets in one task. A pair that shares several
leaves is counted in the first of them only.

Equal vectors are collapsed first and counted as links of each other. Null vectors, zero vectors and those
with null or non-finite components link with nothing and are components of their own; so are rows with a
null id, whose component is null. Vectors of different lengths are never compared. Rows that repeat an id
count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import connected_components, materialize
from memloom.llm.labelled import at_most


class Tree:
    """One tree: arrays of directions, thresholds and children; leaves have negative children."""

    def __init__(self, sample: np.ndarray, total: int, leaf: int, margin: float, rng: np.random.Generator) -> None:
        self.directions, self.thresholds, self.children, self.leaves, self.margin = [], [], [], 0, margin
        self.root = self._grow(sample, total / max(1, len(sample)), leaf, rng)

    def _grow(self, x: np.ndarray, scale: float, leaf: int, rng: np.random.Generator) -> int:
        best = None
        if len(x) * scale > leaf and len(x) >= 32:
            for _ in range(6):
                d = rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = x @ d
                t = float(np.median(p))
                spill = float(np.mean(np.abs(p - t) < self.margin))
                if best is None or spill < best[0]:
                    best = spill, d, t, p
        if best is None or best[0] > 0.6:
            self.leaves += 1
            return -self.leaves
        _, d, t, p = best
        node = len(self.thresholds)
        self.directions.append(d)
        self.thresholds.append(t)
        self.children.append((0, 0))
        low, high = x[p < t + self.margin], x[p >= t - self.margin]
        self.children[node] = self._grow(low, scale, leaf, rng), self._grow(high, scale, leaf, rng)
        return node

    def drop(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that each row reaches."""
        rows, found, open_ = [], [], [(self.root, np.arange(len(x)))]
        while open_:
            node, at = open_.pop()
            if node < 0:
                rows.append(at)
                found.append(np.full(len(at), -node - 1))
                continue
            p = x[at] @ self.directions[node]
            low, high = self.children[node]
            open_ += [(low, at[p < self.thresholds[node] + self.margin]), (high, at[p >= self.thresholds[node] - self.margin])]
        return np.concatenate(rows), np.concatenate(found)


def unit(vectors: list) -> np.ndarray:
    """Vectors of length one. Divided by their largest component first, so that squares neither vanish nor overflow."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(a: np.ndarray, b: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b (of a, each pair once, if b is None) with at least this cosine."""
    near = (a @ (a if b is None else b).T) >= threshold
    if b is None:
        near = np.triu(near, 1)
    return np.nonzero(near)


def forest(x: np.ndarray, p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that join what the pairs join: at most n of them."""
    if len(p) <= 2 * n:
        return p, q
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def embedding_components(
    vectors: DataFrame, threshold: float = 0.95, trees: int = 4, leaf: int = 1000, tile: int = 1500, sample: int = 16_384, spread: float = 0.75, seed: int = 5,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept). spread: the spill margin in standard deviations of a linked pair's projection.

    The trees are fitted on a sample of about `sample` vectors; every vector is put into them.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    kinds = materialize(rows.where(usable).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    total = kinds.count()
    drawn: dict[int, list] = {}
    for r in sorted(at_most(kinds.withColumnRenamed("rep", "doc_id"), sample, seed).select("doc_id", "v").collect()):
        drawn.setdefault(len(r["v"]), []).append(r["v"])
    models, number = {}, 0
    for dim, own in drawn.items():
        x = unit(own)
        margin = spread * np.sqrt(2 * (1 - threshold)) / np.sqrt(dim)
        models[dim] = []
        for i in range(trees):
            t = Tree(x, round(total * len(own) / max(1, sum(map(len, drawn.values())))), leaf, margin, np.random.default_rng([seed, dim, i]))
            models[dim].append((number, t))
            number += t.leaves

    def drop(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, own in part.groupby(part["v"].map(len)):
                x = unit(list(own["v"]))
                leaves: list[list[int]] = [[] for _ in range(len(own))]
                for first, t in models.get(dim, [(-dim, None)]):
                    # A length that the sample lacks is a leaf of its own.
                    at, found = t.drop(x) if t else (np.arange(len(own)), np.zeros(len(own), np.int64))
                    for i, k in zip(at.tolist(), (found + first).tolist(), strict=True):
                        leaves[i].append(k)
                yield pd.DataFrame({"rep": own["rep"].to_numpy(), "copies": own["copies"].to_numpy(), "v": list(own["v"]), "leaves": leaves})

    placed = materialize(kinds.mapInPandas(drop, "rep long, copies long, v array<double>, leaves array<long>"))
    apart = placed.select("*", F.explode("leaves").alias("leaf"))
    tiles = apart.groupBy("leaf").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    apart = apart.join(tiles, "leaf").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    apart = apart.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    apart = apart.select("rep", "copies", "v", "leaves", "leaf", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def within(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        leaf_, i, j = key
        a = group[group["own"] == i]
        b = a if i == j else group[group["own"] == j]
        none = pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        if not len(a) or not len(b):
            return none
        p, q = compare(unit(list(a["v"])), None if i == j else unit(list(b["v"])), threshold)
        if not len(p):
            return none
        # Earlier leaves that both share: there the pair is counted.
        earlier = sorted({k for x in group["leaves"] for k in x if k < leaf_})
        if earlier:
            place = {k: n for n, k in enumerate(earlier)}

            def member(rows: pd.DataFrame) -> np.ndarray:
                m = np.zeros((len(rows), len(earlier)), dtype=np.float32)
                for n, x in enumerate(rows["leaves"]):
                    m[n, [place[k] for k in x if k < leaf_]] = 1
                return m

            fresh = ((member(a) @ member(b).T) == 0)[p, q]
            p, q = p[fresh], q[fresh]
        ra, rb, ca, cb = a["rep"].to_numpy(), b["rep"].to_numpy(), a["copies"].to_numpy(), b["copies"].to_numpy()
        to_a, to_b = np.bincount(p, weights=cb[q], minlength=len(a)), np.bincount(q, weights=ca[p], minlength=len(b))
        child, parent = forest(None, p, q if i == j else q + len(a), len(a) + (0 if i == j else len(b)))
        names = ra if i == j else np.concatenate([ra, rb])
        counted = pd.DataFrame({"rep": np.concatenate([ra, rb]), "links": np.concatenate([to_a, to_b]).astype(np.int64), "to": -1})
        joined = pd.DataFrame({"rep": names[child], "links": np.int64(0), "to": names[parent]})
        return pd.concat([counted[counted["links"] > 0], joined])

    found = apart.groupBy("leaf", "i", "j").applyInPandas(within, "rep long, links long, to long")
    found = materialize(found)
    links = found.where("links > 0").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("links = 0").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = kinds.join(links, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    named = materialize(named.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    single = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where(usable).join(named, "v").select("vec_id", "n_links", "component_id").union(single)
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
