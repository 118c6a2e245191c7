"""Sparse suffix arrays: passages of `least` words or more that occur twice.

Only suffixes that start at a minimiser are kept (one in about a dozen words). Any two occurrences of such
a passage choose the same minimisers within it, so both have suffixes that start alike. Suffixes whose first
`key` words occur once are left out (counted by Spark, carried back by a filter of bounded size); the others
are sorted, neighbours are compared, and matches are extended to the right and, from the words before, to
the left.

Suffixes that start alike are a group. In a group of two the neighbours are all there is; in a larger one a
suffix can share its right side with one neighbour and, by both sides together, a passage with one further
away. So each of its windows of `least` words is also looked up in the group: within the task, or, for a
group of over GROUP_ROWS rows or one that is cut by the bounds of a task, by grouping hashes across tasks.
No group has to fit one task, and every repeated window is found.

Every suffix carries `least` words of its own and those before that a passage of that length can have, as
32-bit hashes; longer passages come out whole because their suffixes' spans overlap. Suffixes alike in all
these words are collapsed in each batch. A null text has no words; rows with a null id are left out of the
search; rows that repeat an id count as one document, and occurrences within one document count. Ties in
the order go by doc_id and place. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import chunks, documents_of, materialize, mix64, run_hashes, run_hashes_by_row, words_of
from memloom.llm.mixing import word_count
from memloom.llm.repeats import Filter, filter_of, minimisers, repeated

#: Rows of one group that a task holds at once; the windows of larger groups are compared across tasks.
GROUP_ROWS = 20_000


def _suffixes(hashes: np.ndarray, first: np.ndarray, window: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes that have `key` words within their text, and the hash of those words."""
    _, place, _ = minimisers(hashes, first, window)
    place = np.unique(place)
    doc = np.searchsorted(first, place, "right") - 1
    place = place[place + key <= first[doc + 1]]
    return place, run_hashes(hashes, key)[place] if len(place) else np.zeros(0, np.uint64)


def suffix_counts(texts: DataFrame, window: int, key: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for _, rows in chunks(part["text"]):
                _, _, _, hashes, first = words_of(rows)
                found.append(_suffixes(hashes, first, window, key)[1])
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    return texts.select("text").mapInPandas(run, "h long, n long")


def suffixes(texts: DataFrame, window: int, key: int, least: int, chosen: Filter) -> DataFrame:
    """(h, doc_id, at, after, before): kept suffixes with `least` words after their start and least - key before it, nearest first.

    Of those alike within a batch two are kept whole and the others only name their span (`n` words from `at`).
    """
    back = least - key

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, out, seen = part["doc_id"].to_numpy(), [], {}
            for i, rows in chunks(part["text"]):
                _, _, _, hashes, first = words_of(rows)
                place, h = _suffixes(hashes, first, window, key)
                some = chosen.has(h)
                place, h = place[some], h[some]
                doc = np.searchsorted(first, place, "right") - 1
                small = (hashes >> np.uint64(32)).astype(">u4")
                for p, k, d in zip(place.tolist(), h.view(np.int64).tolist(), doc.tolist(), strict=True):
                    begin = int(first[d])
                    after = small[p : min(p + least, int(first[d + 1]))].tobytes()
                    before = small[max(begin, p - back) : p][::-1].tobytes()
                    alike, own = (after, before), (int(ids[i + d]), p - begin)
                    words = (len(after) + len(before)) // 4
                    if words >= least and alike in seen:
                        one, more = seen[alike]
                        if own == one:
                            continue  # a repeated row
                        if more:
                            out.append((0, own[0], own[1] - len(before) // 4, None, None, words))
                            continue
                        seen[alike] = one, True  # two are kept whole: compared as any others, each shows the other's span
                    else:
                        seen.setdefault(alike, (own, False))
                    out.append((k, *own, after, before, 0))
            yield pd.DataFrame(out, columns=["h", "doc_id", "at", "after", "before", "n"])

    return texts.mapInPandas(run, "h long, doc_id long, at long, after binary, before binary, n long")


def _words(column: pd.Series, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `most` word hashes, zero beyond a row's own, and how many are its own."""
    flat = b"".join(x.ljust(4 * most, b"\0") for x in column)
    return np.frombuffer(flat, ">u4").reshape(-1, most).astype(np.uint64), column.str.len().to_numpy().astype(np.int64) // 4


def _common(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words in the common prefix of each row and the next."""
    differ = words[1:] != words[:-1]
    alike = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.minimum(alike, np.minimum(n[1:], n[:-1]))


def _compare(part: pd.DataFrame, across: set[int], least: int, back: int) -> Iterator[pd.DataFrame]:
    """Spans of sorted suffixes (w null), and of the groups in `across` one place of each window with its hash w."""
    part = part.drop_duplicates(["doc_id", "at", "after", "before"], ignore_index=True)
    h, doc, at = (part[c].to_numpy().astype(np.int64) for c in ("h", "doc_id", "at"))
    after, n_after = _words(part["after"], least)
    before, n_before = _words(part["before"], back)
    # found[i, k]: the window with k words before the start of suffix i occurs elsewhere.
    found, left_words = np.zeros((len(part), back + 1), dtype=bool), np.arange(back + 1)
    right, left = _common(after, n_after), _common(before, n_before)
    alike = (h[1:] == h[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
    shared = alike[:, None] & (left_words >= (least - right)[:, None]) & (left_words <= left[:, None])
    found[1:] |= shared
    found[:-1] |= shared

    _, group, size = np.unique(h, return_inverse=True, return_counts=True)
    wide = np.isin(h, np.fromiter(across, np.int64, len(across)))
    rows = np.flatnonzero(wide | (size[group] > 2))
    wide, own_doc, own_at = wide[rows], doc[rows], at[rows]
    hashes = run_hashes_by_row(mix64(np.hstack([before[rows, ::-1], after[rows]])), least)
    for k in range(back + 1):
        some = np.flatnonzero((n_before[rows] >= k) & (n_after[rows] >= least - k))
        w = mix64(hashes[some, back - k] + np.uint64(k))
        order = np.lexsort((own_at[some], own_doc[some], w))
        some, w = some[order], w[order]
        new = np.concatenate([[True], w[1:] != w[:-1]])[: len(w)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(w) else np.zeros(0, np.int64)
        last = np.append(np.flatnonzero(new)[1:], len(w))[np.cumsum(new) - 1] - 1 if len(w) else first
        # Rows that repeat an id are one place, so the first and the last of equal windows must differ in it.
        twice = (own_doc[some[first]] != own_doc[some[last]]) | (own_at[some[first]] != own_at[some[last]])
        found[rows[some[twice]], k] = True
        one = some[new & wide[some]]
        yield pd.DataFrame({"doc_id": own_doc[one], "start": own_at[one] - k, "n": least, "w": w[new & wide[some]].view(np.int64)})

    # Windows with k to m words before the start, all found, are one span.
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, k), (_, m) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    yield pd.DataFrame({"doc_id": doc[i], "start": at[i] - (m - 1), "n": least + m - 1 - k, "w": None})


def spans(suffixes: DataFrame, least: int, back: int, group_rows: int) -> DataFrame:
    """(doc_id, start, n): spans of `least` words or more, around the suffixes' starts, that occur twice."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        across: set[int] = set()  # a task's first and last group may go on in another, and large ones come in parts
        rest = None
        for part in parts:
            rest = part if rest is None else pd.concat([rest, part], ignore_index=True)
            if not len(rest):
                continue
            h = rest["h"].to_numpy()
            across = across or {int(h[0])}
            cut = int(np.flatnonzero(h == h[-1])[0])
            if len(h) - cut > group_rows:
                across.add(int(h[-1]))
                cut = len(h)
            if cut:
                yield from _compare(rest[:cut], across, least, back)
                rest = rest[cut:]
        if rest is not None and len(rest):
            yield from _compare(rest, across | {int(rest["h"].iloc[-1])}, least, back)

    # Dealt by range, so that one group can be spread over tasks.
    dealt = suffixes.select("h", "doc_id", "at", "after", "before").repartitionByRange("h", "doc_id")
    dealt = dealt.sortWithinPartitions("h", "after", "before", "doc_id", "at")
    got = materialize(dealt.mapInPandas(run, "doc_id long, start long, n long, w long"))
    open_ = got.where("w is not null")
    places = open_.groupBy("w").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last"))
    more = open_.join(places.where("first <> last").select("w"), "w", "left_semi")
    return got.where("w is null").select("doc_id", "start", "n").union(more.select("doc_id", "start", "n"))


def repeated_passages(
    docs: DataFrame, least: int = 50, key: int = 24, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_repeated, passages array<struct<start, end>>): the words of each text that lie in passages found twice.

    A passage of `least` words has a minimiser in its first least - key, with `key` words after it.
    """
    texts = documents_of(docs, id_col, text_col)
    known = texts.where("doc_id is not null")
    window = least - key + 1
    chosen = filter_of(materialize(repeated(suffix_counts(known, window, key))))
    found = materialize(suffixes(known, window, key, least, chosen))
    whole = found.where("n = 0")
    every = spans(whole, least, least - key, group_rows).union(found.where("n > 0").select("doc_id", "at", "n"))
    # Union of spans in a document: a span that starts behind all earlier ends opens a passage.
    every = every.distinct().selectExpr("doc_id", "start", "start + n as end")
    every = every.selectExpr("*", "max(end) over (partition by doc_id order by start, end rows between unbounded preceding and 1 preceding) as reach")
    every = every.selectExpr("*", "sum(cast(coalesce(start > reach, true) as int)) over (partition by doc_id order by start, end) as number")
    passages = every.groupBy("doc_id", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    passages = passages.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("passages"))
    sized = texts.select("doc_id", word_count(F.col("text")).alias("n_words"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = sized.join(materialize(passages), "doc_id", "left")
    return joined.select("doc_id", "n_words", F.coalesce("n", F.lit(0)).alias("n_repeated"), F.coalesce("passages", empty).alias("passages"))
