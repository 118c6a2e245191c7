"""What the two operators on repeated passages share: content-selected positions and filters of repeated hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import mix64, run_hashes, sliding_min

#: Words in a minimiser.
GRAM = 4
_AT = np.uint64((1 << 24) - 1)


def minimisers(hashes: np.ndarray, first: np.ndarray, window: int, block: int = 1 << 23) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window of so many words within one text: its first word, the place of its minimiser, and that one's hash.

    The minimiser is the run of GRAM words with the smallest hash (the leftmost at a tie): a choice that
    depends on the window's content alone, so that equal windows choose alike. first: see words_of. Places
    are kept in the low 24 bits within overlapping blocks, so texts may be of any length.
    """
    grams = run_hashes(hashes, GRAM)
    span = window - GRAM + 1
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    places = np.empty(len(grams) - span + 1, dtype=np.int64)
    for b in range(0, len(places), block):
        part = grams[b : b + block + span - 1]
        least = sliding_min((part & ~_AT) | np.arange(len(part), dtype=np.uint64), span)
        places[b : b + len(least)] = b + (least & _AT).astype(np.int64)
    left = np.repeat(first[1:], np.diff(first))[: len(places)] - np.arange(len(places))
    at = np.flatnonzero(left >= window)
    place = places[at]
    return at, place, grams[place]


def runs_of(at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (in `at`) of runs of consecutive windows with one minimiser."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(place) != 0)) + 1
    return np.concatenate([[0], new]), np.concatenate([new, [len(at)]])


class Filter:
    """A Bloom filter of 64-bit hashes: no hash that was put in is missed. Without bits it holds everything."""

    PROBES = 3

    def __init__(self, bits: np.ndarray | None) -> None:
        self.bits = bits

    def places(self, h: np.ndarray, i: int) -> np.ndarray:
        return mix64(h + np.uint64(i * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(len(self.bits) * 64 - 1)

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], dtype=np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for i in range(self.PROBES if self.bits is not None else 0):
            p = self.places(h, i)
            out &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def filter_of(hashes: DataFrame, column: str = "h", most_bits: int = 1 << 29) -> Filter:
    """A filter of the column's values, combined by Spark. Its size follows their number up to most_bits (64 MB).

    Beyond 4 bits for each value there would be little left to filter: then the filter holds everything,
    and what follows works on all rows, with the same result.
    """
    n = hashes.count()
    bits = 1 << max(16, (8 * max(1, n) - 1).bit_length())
    bits = min(bits, most_bits)
    if n * 4 > bits:
        return Filter(None)
    shape = Filter(np.zeros(bits // 64, dtype=np.uint64))

    def put(parts):
        import pandas as pd

        for part in parts:
            h = part[column].to_numpy().astype(np.int64).view(np.uint64)
            p = np.unique(np.concatenate([shape.places(h, i) for i in range(Filter.PROBES)]))
            word = (p >> np.uint64(6)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], np.diff(word) != 0])) if len(word) else np.zeros(0, np.int64)
            bit = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), start) if len(start) else np.zeros(0, np.uint64)
            yield pd.DataFrame({"word": word[start], "bit": bit.view(np.int64)})

    words = hashes.select(column).mapInPandas(put, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    shape.bits[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return shape


def repeated(counts: DataFrame) -> DataFrame:
    """Of (h, n) rows, each h whose n come to two or more."""
    return counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
