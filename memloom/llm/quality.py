"""Quality classifier: Bradley-Terry scores learnt from preference pairs, threshold at a score quantile.

Each text gives a few shares (symbols, capitals, repeated words and lines, ...), cut into quantile bins.
A pair is a document of quality 1 that is preferred to one of quality 0; the model has the score of a
document as a linear function of its features and fits the logistic loss of feature differences over all
pairs of labelled rows. Pairs are never listed: what a row has lost to all others follows from its score and
a histogram of the others' scores, so a round of Newton's method is two passes over the labelled rows.

Null and empty texts have the features of no word and are scored like others. Rows with a null id are
scored and never learnt from. Labels for unknown documents are ignored; with no pair to learn from every
score is 0.5. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import documents_of, encoded, map_frames, materialize
from memloom.llm.labelled import fold, one_label, with_labels

#: Classes of ASCII bytes whose shares are features.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "*&%$#@^~+=", "<>{}[]()", ":;", "\"'`", "/\\_-"]
_CLASS_OF = np.full(256, len(CLASSES), dtype=np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c.encode())] = _i
N_FEATURES = len(CLASSES) + 1 + 9


def features(text: bytes) -> np.ndarray:
    """Shares that describe how a text is written; none depends on its language's words."""
    n = max(1, len(text))
    shares = np.bincount(_CLASS_OF, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=len(CLASSES) + 1) / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w, distinct = max(1, len(words)), len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    bare = sum(not x.isalnum() and len(x) == 1 and x[0] < 128 for x in words)
    upper = sum(map(bytes.isupper, words))
    rest = [
        np.log1p(len(words)),
        sum(map(len, words)) / w,
        1 - distinct / w if w > 1 else 0.0,
        (w - distinct) / (w * np.log2(w + 2)),
        again / w,
        bare / w,
        upper / w,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(text) / max(1, len(lines))),
    ]
    return np.concatenate([shares, rest]).astype(np.float64)


#: Cells of a histogram of scores, such cells that share the weights of a round's curvature, and cells in which the threshold is looked for.
FINE, COARSE, CUTS = 1024, 64, 1 << 16
#: Tasks of a pass over the labelled rows; each returns one or two megabytes.
TASKS = 32
#: Adds up what a function gives for blocks of (bins, label), over all labelled rows.
Summed = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray]


#: Quantiles of each label; bins are cut at quantiles of both together, so that the rarer label counts as much. They are found among values in steps of a thousandth, of which there are ten thousands at most, so that exact ones need little memory.
_SHARES = np.arange(1, 128) / 128
_STEP, _NEAR_ZERO = 1000, 1e-4


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -700, 700)))


def steps(bins: np.ndarray, widths: list[int]) -> np.ndarray:
    """A step at each cut: neighbouring bins share what lies below them."""
    return np.hstack([b[:, None] > np.arange(n)[None, :] for b, n in zip(bins.T, widths, strict=True)]).astype(np.float64)


class _Scores:
    """Scores of rows from their bins, and the cells that they fall into; the range follows from the weights."""

    def __init__(self, w: np.ndarray, widths: list[int]) -> None:
        ends = np.cumsum(widths)[:-1]
        self.table = np.zeros((len(widths), max(widths) + 1))
        for own, part, n in zip(self.table, np.split(w, ends), widths, strict=True):
            own[1 : n + 1] = np.cumsum(part)
            own[n + 1 :] = own[n]
        self.low, high = self.table.min(axis=1).sum(), self.table.max(axis=1).sum()
        self.span = max(high - self.low, 1e-9) * (1 + 1e-9)

    def of(self, bins: np.ndarray) -> np.ndarray:
        return self.table[np.arange(bins.shape[1]), bins].sum(axis=1)

    def cell(self, s: np.ndarray, cells: int) -> np.ndarray:
        return np.clip((s - self.low) / self.span * cells, 0, cells - 1).astype(np.int64)

    def histogram(self, bins: np.ndarray, y: np.ndarray, cells: int) -> np.ndarray:
        """Rows and sums of scores by label and cell."""
        s = self.of(bins)
        at = self.cell(s, cells) + cells * y
        return np.stack([np.bincount(at, minlength=2 * cells), np.bincount(at, weights=s, minlength=2 * cells)])

    def means(self, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        centre = self.low + (np.arange(n.shape[1]) + 0.5) / n.shape[1] * self.span
        return np.where(n > 0, total / np.maximum(n, 1), centre)


def _pull(bins: np.ndarray, y: np.ndarray, scores: _Scores, widths: list[int], grid: np.ndarray, lost: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The pairs' gradient, second moments by the rows' weights, and sums of rows by label and coarse cell, for a block of rows."""
    d = sum(widths)
    out = [np.zeros(d), np.zeros((d, d)), np.zeros((2 * COARSE, d))]
    for at in range(0, len(y), 4096):  # bounds the matrix
        own, label = bins[at : at + 4096], y[at : at + 4096]
        z, s = steps(own, widths), scores.of(own)
        by_label = np.where(label == 1, -np.interp(s, grid, lost[1]), np.interp(s, grid, lost[0]))
        cell = scores.cell(s, COARSE)
        out[0] += by_label @ z
        out[1] += (z * weight[label, cell][:, None]).T @ z
        out[2] += (np.arange(2 * COARSE)[:, None] == (cell + COARSE * label)[None, :]).astype(np.float64) @ z
    return np.concatenate([x.ravel() for x in out])


class BradleyTerry:
    """Additive scores over binned features, from all pairs of a good and a bad row. Their mean loss counts as that of `pairs` pairs against the penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int, bins: int = 16, l2: float = 3.0) -> None:
        self.ready = bool((y == 1).any() and (y == 0).any())
        if self.ready:
            self.cuts = [np.unique(np.quantile(np.concatenate([np.quantile(c[y == label], _SHARES) for label in (0, 1)]), np.arange(1, bins) / bins)) for c in x.T]
            here = self.bins(x)
            self._fit(lambda f: f(here, y.astype(np.int64)), pairs, l2)

    @classmethod
    def of(cls, cuts: list[np.ndarray], summed: Summed, pairs: int, l2: float = 3.0) -> BradleyTerry:
        """From rows that lie elsewhere, binned by the cuts; not ready without cuts."""
        model = cls(np.zeros((0, 0)), np.zeros(0), pairs)
        if cuts:
            model.ready, model.cuts = True, cuts
            model._fit(summed, pairs, l2)
        return model

    def _fit(self, summed: Summed, pairs: int, l2: float) -> None:
        widths = [len(c) for c in self.cuts]
        d = sum(widths)

        def at(w: np.ndarray) -> tuple[_Scores, np.ndarray, np.ndarray, float]:
            scores = _Scores(w, widths)
            n, total = summed(lambda b, y: scores.histogram(b, y, FINE)).reshape(2, 2, FINE)
            (n0, m0), (n1, m1) = ((v[v > 0], m[v > 0]) for v, m in zip(n, scores.means(n, total), strict=True))
            loss = n1 @ np.logaddexp(0, m0[None, :] - m1[:, None]) @ n0
            return scores, n, total, loss * pairs / n.sum(axis=1).prod() + l2 / 2 * w @ w

        w = np.zeros(d)
        scores, n, total, loss = at(w)
        for _ in range(60):
            (n0, m0), (n1, m1) = ((v[v > 0], m[v > 0]) for v, m in zip(n, scores.means(n, total), strict=True))
            share = pairs / n.sum(axis=1).prod()
            grid = scores.low + np.arange(FINE) / (FINE - 1) * scores.span
            # What a row of each label at a place of the grid has lost to all rows of the other.
            lost = np.stack([_sigmoid(grid[:, None] - m1[None, :]) @ n1, _sigmoid(m0[None, :] - grid[:, None]) @ n0])
            few, sums = (v.reshape(2, COARSE, -1).sum(axis=2) for v in (n, total))
            centre = scores.means(few, sums)
            p = _sigmoid(centre[1][:, None] - centre[0][None, :])
            v = p * (1 - p)
            weight = np.stack([few[1] @ v, v @ few[0]])
            found = summed(lambda b, y, s=scores, g=grid, lost=lost, weight=weight: _pull(b, y, s, widths, g, lost, weight))
            slope, square, by_cell = found[:d], found[d : d + d * d].reshape(d, d), found[d + d * d :].reshape(2, COARSE, d)
            cross = by_cell[1].T @ v @ by_cell[0]
            step = np.linalg.solve(share * (square - cross - cross.T) + l2 * np.eye(d), share * slope + l2 * w)
            for _ in range(20):
                after = at(w - step)
                if after[3] <= loss:
                    break
                step = step / 2
            else:
                break
            w, (scores, n, total, loss) = w - step, after
            if np.abs(step).max() < 1e-3:
                break
        self.w, self.scores = w, scores
        n, total = summed(lambda b, y: scores.histogram(b, y, CUTS)).reshape(2, 2, CUTS)
        own, rows = n.sum(axis=0), int(n.sum())
        n, mean = n[:, own > 0], (total.sum(axis=0) / np.maximum(own, 1))[own > 0]
        self.scale = max(1e-6, np.sqrt(max(0.0, own[own > 0] @ (mean - total.sum() / rows) ** 2 / rows)))
        if len(mean) == 1:
            self.quantile, self.threshold = 0.5, mean[0]
            return
        right = np.cumsum(n[0])[:-1] + np.cumsum(n[1][::-1])[::-1][1:]
        k = int(np.argmax(right))
        #: The share of documents below the threshold: the quantile of scores at which most labels come out right, midway between two documents.
        self.quantile = (n[:, : k + 1].sum() - 0.5) / (rows - 1)
        self.threshold = (mean[k] + mean[k + 1]) / 2

    def bins(self, x: np.ndarray) -> np.ndarray:
        """How many of a feature's cuts lie below."""
        return np.stack([np.searchsorted(cuts, c) for c, cuts in zip(x.T, self.cuts, strict=True)], axis=1).astype(np.uint8)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return steps(self.bins(x), [len(c) for c in self.cuts])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready or not len(x):
            return np.full(len(x), 0.5)
        return _sigmoid(np.clip(2 * (self.scores.of(self.bins(x)) - self.threshold) / self.scale, -30, 30))


def _cuts(taught: DataFrame, bins: int = 16) -> list[np.ndarray]:
    """Cuts of each feature by all good and all bad rows; none if either are missing."""
    at = F.array(*map(F.lit, _SHARES.tolist()))
    codes = [F.round(F.log(F.col("x")[i] + _NEAR_ZERO) * _STEP) for i in range(N_FEATURES)]
    rows = taught.groupBy("label").agg(F.array(*(F.percentile(c, at) for c in codes)).alias("at")).collect()
    if len(rows) < 2:
        return []
    # The upper end of a step: rows of the same step are not cut.
    both = (np.quantile(np.concatenate([r["at"][i] for r in rows]), np.arange(1, bins) / bins) for i in range(N_FEATURES))
    return [np.unique(np.exp((np.ceil(v) + 0.5) / _STEP) - _NEAR_ZERO) for v in both]


def _summed(rows: DataFrame) -> Summed:
    """Sums over rows (label, bins), by up to TASKS tasks."""

    def run(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                bins = np.frombuffer(b"".join(b["bins"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
                total = total + f(bins, b["label"].to_numpy().astype(np.int64))
            if isinstance(total, np.ndarray):
                yield pa.RecordBatch.from_pydict({"v": [total.astype(np.float64).tobytes()]})

        return sum(np.frombuffer(r["v"]) for r in rows.coalesce(TASKS).mapInArrow(add, "v binary").collect())

    return run


def quality_scores(
    docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, pairs: int = 20_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted). Learns from all labelled rows outside of the held-out fold and all pairs of them, whose mean loss counts as that of `pairs` pairs."""

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "x": [features(encoded(t)) for t in part["text"]]})

    described = materialize(map_frames(documents_of(docs, id_col, text_col), describe, "doc_id long, x array<double>"))
    taught = with_labels(described.where(fold(F.col("doc_id"), folds) != held_out), one_label(labels, "quality", id_col))
    cuts = _cuts(taught)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part["x"].to_numpy()) if len(part) else np.zeros((0, N_FEATURES))
            bins = np.stack([np.searchsorted(own, c) for c, own in zip(x.T, cuts, strict=True)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"label": part["label"], "bins": [b.tobytes() for b in bins]})

    model = BradleyTerry.of(cuts, _summed(materialize(map_frames(taught.select("label", "x"), cut, "label int, bins binary"))) if cuts else None, pairs)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part["x"].to_numpy()) if len(part) else np.zeros((0, N_FEATURES))
            s = model.score(x)
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype("int32")})

    scored = map_frames(described, judge, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", "predicted")
