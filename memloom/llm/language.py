"""Language identification by hierarchical discrimination.

Hashed letter n-grams (one to three letters, with word ends) of the whole text; a linear support vector
machine for each language family picks the family, then one-versus-one machines vote among its languages.

Learns from about `sample` rows for each language (a bounded sample chosen by a hash of the id), never from
the held-out fold, null languages or null texts. A text that is null or has no letter is `und` with
score 0. Languages outside of the family table are families of their own. Without any row to learn from,
every language is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import documents_of, map_frames
from memloom.llm.labelled import at_most, fold

DIMS = 4096
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn ur pa mr gu ne",
    "celtic": "ga gd cy br",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    low = codes < 0x10000
    out = np.zeros(len(codes), dtype=bool)
    out[low] = _LETTER[codes[low]]
    if not low.all():
        kinds, at = np.unique(codes[~low], return_inverse=True)
        out[~low] = np.array([chr(c).isalpha() for c in kinds])[at]
    return out


def profiles(texts: list[str | None]) -> np.ndarray:
    """A row of DIMS values for each text: root of the n-gram counts, of unit length (zero: no letter)."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        total = np.zeros(DIMS)
        for at in range(0, len(text), 1 << 20):  # bounds the arrays; three letters of overlap
            codes = np.frombuffer(text[max(0, at - 2) : at + (1 << 20)].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
            codes = np.concatenate([[0], np.where(_letters(codes), codes, 0), [0]]).astype(np.uint32)
            one, two, three = codes[1:-1] * np.uint32(0x9E3779B1), (codes[:-1] * np.uint32(0x85EBCA77)) ^ (codes[1:] * np.uint32(0xC2B2AE3D)), None
            three = two[:-1] ^ (codes[2:] * np.uint32(0x27D4EB2F)) + np.uint32(0x165667B1)
            letter = codes > 0
            picked = np.concatenate([one[letter[1:-1]], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
            picked = (picked ^ (picked >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            total += np.bincount((picked >> np.uint32(20)).astype(np.int64), minlength=DIMS)
        norm = np.sqrt(total.sum())
        if norm and any(c.isalpha() for c in text):
            out[i] = np.sqrt(total) / norm
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss (y: -1 or 1, both sides weigh alike), by accelerated gradients."""
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    step, t = 1 / (1 + 4 * c), 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * c * (x.T @ (weight * gap * y)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + np.float32((t - 1) / t2) * (new - w), t2
    return w


class Languages:
    """Families first, then pairs of languages within the family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        lang = np.array(langs, dtype=object)
        self.langs = sorted(set(langs))
        self.family = {k: FAMILY_OF.get(k, k) for k in self.langs}
        self.families = sorted(set(self.family.values()))
        of = np.array([self.family[k] for k in langs], dtype=object)
        sign = lambda at: np.where(at, 1, -1).astype(np.float32)
        self.first = np.stack([fit_svm(x, sign(of == f)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for a, b in combinations([k for k in self.langs if self.family[k] == f], 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_svm(x[rows], sign(lang[rows] == a))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n, sure = len(x), lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        dot = lambda w: x @ w[:-1].T + w[-1] if w.ndim == 1 else x @ w[:, :-1].T + w[:, -1]
        chance = np.ones((n, 1)) if self.first is None else sure(dot(self.first))
        chance = chance / chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        names, score = np.full(n, "und", dtype=object), np.zeros(n)
        votes = {k: sure(dot(w)) for k, w in self.pairs.items()}
        for i, f in enumerate(self.families):
            own = [k for k in self.langs if self.family[k] == f]
            won = np.ones((n, len(own)))
            for (a, b), p in votes.items():
                if a in own:
                    won[:, own.index(a)] *= p
                    won[:, own.index(b)] *= 1 - p
            at = best == i
            top = won.argmax(axis=1)
            names[at] = np.array(own, dtype=object)[top[at]]
            score[at] = (chance[:, i] * won.max(axis=1) / won.sum(axis=1))[at]
        return list(names), score


def languages(docs: DataFrame, held_out: int = 2, folds: int = 4, sample: int = 1_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    taught = rows.where((fold(F.col("doc_id"), folds) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "lang": part["lang"], "x": [p.astype("<f2").tobytes() for p in profiles(list(part["text"]))]})

    fit = at_most(taught, sample, 10, "lang").mapInPandas(describe, "doc_id long, lang string, x binary").collect()
    fit = sorted((r["doc_id"], r["lang"], bytes(r["x"])) for r in fit)
    model = Languages(np.stack([np.frombuffer(r[2], "<f2") for r in fit]).astype(np.float32), [r[1] for r in fit]) if fit else None

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, names, score = list(part["text"]), [], []
            for i in range(0, len(texts), 512):
                x = profiles(texts[i : i + 512])
                some = x.any(axis=1)
                own, p = model.predict(x) if model else (["und"] * len(x), np.zeros(len(x)))
                names += [k if s else "und" for k, s in zip(own, some, strict=True)]
                score += np.where(some, p, 0.0).tolist()
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": names, "score": score})

    found = map_frames(documents_of(docs, id_col, text_col), judge, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
