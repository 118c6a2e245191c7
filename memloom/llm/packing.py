"""Best-fit packing: patterns of a few lengths, repeat counts by non-negative least squares, residuals by best fit.

Documents become token ids (and an end id); longer ones are cut into full pieces, the shorter piece first.
What the plan needs is the histogram of piece lengths, which has `capacity` bins at any size of the input.
The plan maps ranges of ranks within a length to sequences, so assigning a piece is a look-up: no piece
passes through the driver, and no length, however frequent, through one task.

A null or empty text is the end id alone. Rows with a null id are packed like others. Ties (equal lengths)
go by partition and order in it. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm.common import documents_of, map_frames, materialize

CAPACITY = 1024
END_ID = 2


class TokenIds:
    """Token ids of whole texts, as the vocabulary in a `tokenizers` file gives them.

    The same vocabulary as a file of ranks gives the same ids (tests/llm compares them) in a third of the
    time; a text that holds a special token's own string goes through the first.
    """

    def __init__(self, path: str, ranks: str | None) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            with open(ranks, "rb") as f:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


@cache
def token_ids(path: str, ranks: str | None) -> TokenIds:
    """One for each Python worker."""
    return TokenIds(path, ranks)


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its partition and its rank among the partition's pieces of its length."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, end, at = token_ids(tokenizer_path, ranks_path), np.array([end_id], dtype="<u4"), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for part in parts:
            rows, owner = [], []
            for row, text in enumerate(part["text"]):
                ids = np.concatenate([known.encode(text), end]).astype("<u4") if text else end
                n = len(ids)
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    owner.append(row)
                    rows.append((i, s, e - s, zlib.crc32(ids[s:e].tobytes()), at, seen[e - s]))
                    seen[e - s] += 1
            out = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", "part", "nth"])
            yield out.assign(doc_id=part["doc_id"].astype("Int64").array.take(owner))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    return map_frames(documents_of(docs, id_col, text_col), run, schema)


def _patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int) -> list[tuple[int, ...]]:
    """Patterns of two and three of the lengths at hand that fill a sequence exactly, the likeliest first."""
    have = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    found = []
    for a in have:
        b = capacity - a
        if a >= b and b in have:
            found.append((min(have[a], have[b]), (a, b)))
    for i, a in enumerate(lengths[::-1].tolist()):
        for b in lengths[::-1][i:].tolist():
            c = capacity - a - b
            if 0 < c <= b and c in have:
                found.append((min(have[a], have[b], have[c]), (a, b, c)))
    found.sort(key=lambda x: (-x[0], x[1]))
    return [p for _, p in found[:most]]


def _nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients."""
    gram, target = a.T @ a, a.T @ b
    step = 1 / max(np.linalg.norm(gram, 2) if len(gram) < 1500 else np.abs(gram).sum(axis=0).max(), 1e-9)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (gram @ y - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit over counts by length, many equal sequences at a time: each opens with the longest piece left and takes the longest that fits."""
    plan = []
    left = left.copy()
    while (have := np.flatnonzero(left)).size:
        pattern, room, times = [int(have[-1])], capacity - int(have[-1]), None
        used = {pattern[0]: 1}
        while True:
            fits = [x for x in have[: np.searchsorted(have, room, "right")][::-1] if left[x] > used.get(int(x), 0)]
            if not fits:
                break
            x = int(fits[0])
            pattern.append(x)
            used[x] = used.get(x, 0) + 1
            room -= x
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
        plan.append((tuple(pattern), int(times)))
    return plan


def pack_histogram(histogram: np.ndarray, capacity: int = CAPACITY, most_patterns: int = 1200) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] for a histogram with counts at index = length."""
    left = histogram.astype(np.int64).copy()
    plan = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths) and (patterns := _patterns(lengths, left[lengths], capacity, most_patterns)):
        place = {int(x): i for i, x in enumerate(lengths)}
        a = np.zeros((len(lengths), len(patterns)))
        for j, p in enumerate(patterns):
            for x in p:
                a[place[x], j] += 1
        # Long pieces are hard to place: they weigh more, as a miss of them costs more.
        weight = np.sqrt(lengths / capacity)
        repeats = np.floor(_nnls(a * weight[:, None], left[lengths] * weight) + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            need = {x: patterns[j].count(x) for x in patterns[j]}
            times = min(int(repeats[j]), *(int(left[x]) // n for x, n in need.items()))
            if times > 0:
                plan.append((patterns[j], times))
                for x, n in need.items():
                    left[x] -= n * times
    return plan + _best_fit(left, capacity)


def pack(
    docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place.

    The driver receives the histogram (capacity bins) and sends the plan, whose entries are bounded by
    patterns and lengths, not by documents.
    """
    if tokenizer_path is None:
        tokenizer_path, ranks_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = materialize(pieces(docs, tokenizer_path, ranks_path, capacity, end_id, id_col, text_col))
    per = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    per = materialize(per.selectExpr("length", "part", "n", "sum(n) over (partition by length order by part) - n as before"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    where: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]  # by length: first rank, first sequence, offset
    used, base = np.zeros(capacity + 1, dtype=np.int64), 0
    for pattern, times in pack_histogram(histogram, capacity):
        offset = 0
        for x in pattern:
            where[x].append((int(used[x]), base, offset))
            used[x] += times
            offset += x
        base += times
    steps = [np.array(x, dtype=np.int64).reshape(-1, 3) for x in where]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n, rank = part["length"].to_numpy(), part.pop("rank").to_numpy()
            seq, off = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for x in np.unique(n):
                at, t = n == x, steps[x]
                i = np.searchsorted(t[:, 0], rank[at], "right") - 1
                seq[at], off[at] = t[i, 1] + rank[at] - t[i, 0], t[i, 2]
            part["sequence_id"], part["offset"] = seq, off
            yield part

    ranked = cut.join(per.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return map_frames(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
