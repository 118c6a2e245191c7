"""Substring deduplication: FM-indexes of content-dealt shards, searched backward over wavelet trees.

A window of `window` words that occurs twice must meet its other occurrence. Windows are dealt to shards by
their minimiser (the run of four words in them with the smallest hash), so equal windows meet in one shard
and no document has to be searched in every shard. Two counts (of minimisers, then of windows under repeated
ones) leave what can repeat at all; filters of bounded size carry them back to the texts, and let a few
others through, never too few. Of the stretches of words that remain the different ones are put into one
compressed FM-index for each shard, and all are streamed against it: matching statistics give the interval
of each window, and its first suffix the earliest occurrence, which decides for every document that holds
the stretch. Equal stretches of a batch travel as one row with the list of their places.

A null text has no words; words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged. "Earlier" is a
smaller doc_id, or an earlier start in the same document; rows that repeat an id and text are the same
document, rows with a null id are returned whole and remove nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import TEXT_ROWS, chunks, documents_of, encoded, map_frames, materialize, run_hashes, words_of
from memloom.llm.fmindex import FMIndex
from memloom.llm.labelled import BROADCAST_ROWS
from memloom.llm.repeats import Filter, filter_of, minimisers, repeated, runs_of

#: Words of an index, about: shards are put together up to that size.
SHARD_WORDS = 150_000
#: Rows of a frame that Python hands to Spark, at most: the executor holds a whole frame outside of its heap.
FRAME_ROWS = 1 << 16


def _counts(found: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """(h, n) of the hashes of some arrays at a time, in frames of at most FRAME_ROWS. Equal hashes meet in Spark's sum."""
    held: list[np.ndarray] = []

    def close() -> Iterator[pd.DataFrame]:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(h), FRAME_ROWS):
            yield pd.DataFrame({"h": h[i : i + FRAME_ROWS].view(np.int64), "n": n[i : i + FRAME_ROWS]})

    for hashes in found:
        held.append(hashes)
        if sum(map(len, held)) >= 4 * FRAME_ROWS:
            yield from close()
            held = []
    if held:
        yield from close()


def minimiser_counts(texts: DataFrame, window: int) -> DataFrame:
    """(h, n): how often each minimiser was chosen, summed for some texts at a time."""

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for part in parts:
            for _, rows in chunks(part["text"]):
                _, _, _, hashes, first = words_of(rows)
                at, place, h = minimisers(hashes, first, window)
                yield h[runs_of(at, place)[0]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _counts(found(parts))

    return texts.select("text").mapInPandas(run, "h long, n long")


def window_counts(texts: DataFrame, window: int, chosen: Filter) -> DataFrame:
    """(h, n): how often each window with a repeated minimiser occurs, summed for some texts at a time."""

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for part in parts:
            for _, rows in chunks(part["text"]):
                _, _, _, hashes, first = words_of(rows)
                at, place, h = minimisers(hashes, first, window)
                start, end = runs_of(at, place)
                keep = np.repeat(chosen.has(h[start]), end - start)
                yield run_hashes(hashes, window)[at[keep]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _counts(found(parts))

    return texts.select("text").mapInPandas(run, "h long, n long")


def stretches(texts: DataFrame, window: int, chosen: Filter, most: int = 50_000) -> DataFrame:
    """(shard, key, words, doc_id, start, members): runs of windows that may repeat, under one minimiser.

    A row holds the equal runs among about `most` that follow each other: key is a hash of their words, members
    (doc_id, start) where they are, doc_id and start the first of these.
    """

    def collapsed(seen: dict[tuple[int, bytes], list[tuple[int, int]]], rows: int = FRAME_ROWS // 8) -> Iterator[pd.DataFrame]:
        every = iter(seen.items())
        while some := list(islice(every, rows)):
            out = [(k[0], xxhash.xxh3_64_intdigest(k[1], 6) - (1 << 63), k[1], *min(m), m) for k, m in some]
            yield pd.DataFrame(out, columns=["shard", "key", "words", "doc_id", "start", "members"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        held = 0
        for part in parts:
            ids = part["doc_id"].to_numpy()
            for i, rows in chunks(part["text"]):
                buf, ws, we, hashes, first = words_of(rows)
                at, place, h = minimisers(hashes, first, window)
                keep = chosen.has(run_hashes(hashes, window)[at])
                at, place, h = at[keep], place[keep], h[keep]
                start, end = runs_of(at, place)
                a, n = at[start], end - start
                doc = np.searchsorted(first, a, "right") - 1
                raw = buf.tobytes()
                bounds = zip(ws[a].tolist(), we[a + n + window - 2].tolist(), strict=True)
                words = [b" ".join(raw[s:e].split()) for s, e in bounds]
                for shard, w, own, s in zip(h[start].view(np.int64).tolist(), words, ids[i + doc].tolist(), (a - first[doc]).tolist(), strict=True):
                    seen.setdefault((shard, w), []).append((own, s))
                held += len(words)
                if held > most:
                    yield from collapsed(seen)
                    seen, held = {}, 0
        yield from collapsed(seen)

    return texts.mapInPandas(run, "shard long, key long, words binary, doc_id long, start long, members array<struct<doc_id: long, start: long>>")


def search_shard(rows: list[tuple[int, int, bytes]], window: int) -> list[list[tuple[int, int, int, int]]]:
    """For each of the rows (doc_id, start, words), all different in words: runs (at, n, doc_id, start) of its windows and where these start first.

    The rows are indexed in the order of doc_id and start, and each is streamed against the index: an
    interval of full depth gives the earliest occurrence of the window that it belongs to.
    """
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    split = [rows[i][2].split(b" ") for i in order]
    symbol = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for x in split for w in x))}
    texts = [np.array([symbol[w] for w in x], dtype=np.int64) for x in split]
    index = FMIndex(texts, len(symbol) + 1, window)
    length, found = index.matching_statistics(texts)
    docs, starts = (np.array([rows[i][c] for i in order], dtype=np.int64) for c in (0, 1))
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.arange(len(of)) - np.searchsorted(of, of)
    hit = np.flatnonzero(length >= window)
    owner = np.searchsorted(index.starts, found[hit], "right") - 1
    of, at, doc, start = of[hit], at[hit], docs[owner], starts[owner] + found[hit] - index.starts[owner]
    new = np.ones(len(hit), dtype=bool)
    new[1:] = (np.diff(of) != 0) | (np.diff(at) != 1) | (np.diff(doc) != 0) | (np.diff(start) != 1)
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(hit)]]))
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in rows]
    for i, a, n, d, s in zip(of[head].tolist(), at[head].tolist(), size.tolist(), doc[head].tolist(), start[head].tolist(), strict=True):
        out[order[i]].append((a, n, d, s))
    return out


def earliest_runs(dealt: DataFrame, window: int) -> DataFrame:
    """(key, at, n, first_doc, first_start): for n windows from `at` on in the stretches with this key, where the first of them starts first; one FM-index for each few shards.

    dealt: (shard, key, offset, words, doc_id, start, many). Stretches that occur once and start first themselves give no row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple[int, int, bytes]] = []
        owners: list[dict[tuple[int, int], int]] = []
        size, shard = 0, None

        def close() -> list[tuple]:
            nonlocal size
            out = []
            for row, keys, runs in zip(waiting, owners, search_shard(waiting, window) if waiting else [], strict=True):
                alone = sum(keys.values()) == 1
                for (key, offset) in keys:
                    out += [(key, offset + at, n, d, s) for at, n, d, s in runs if not alone or (d, s) != (row[0], row[1] + at)]
            waiting.clear()
            owners.clear()
            size = 0
            return out

        for part in parts:
            out = []
            for s, key, offset, words, doc, start, many in part.itertuples(index=False, name=None):
                if s != shard:
                    if size > SHARD_WORDS:
                        out += close()
                    shard = s
                    waiting_from = len(waiting)
                if len(waiting) > waiting_from and waiting[-1][2] == words:  # sorted: the first of equal ones is the earliest
                    owners[-1][key, offset] = owners[-1].get((key, offset), 0) + many
                    continue
                waiting.append((doc, start, words))
                owners.append({(key, offset): many})
                size += words.count(b" ") + 1
            yield pd.DataFrame(out, columns=["key", "at", "n", "first_doc", "first_start"])
        yield pd.DataFrame(close(), columns=["key", "at", "n", "first_doc", "first_start"])

    sorted_ = dealt.repartition("shard").sortWithinPartitions("shard", "words", "doc_id", "start")
    return sorted_.select("shard", "key", "offset", "words", "doc_id", "start", "many").mapInPandas(run, "key long, at long, n long, first_doc long, first_start long")


def single_windows(rows: DataFrame, window: int) -> DataFrame:
    """Stretches cut into their windows, each a shard of its own content."""
    cut = F.expr(f"transform(sequence(0, size(split(w, ' ')) - {window}), i -> struct(i as i, array_join(slice(split(w, ' '), i + 1, {window}), ' ') as w))")
    # Bytes pass through Latin-1, which keeps each of them.
    each = rows.withColumn("w", F.decode("words", "ISO-8859-1")).select("key", "offset", "doc_id", "start", "many", F.explode(cut).alias("c"))
    return each.select(
        F.xxhash64("c.w").alias("shard"), "key", (F.col("offset") + F.col("c.i")).alias("offset"), F.encode("c.w", "ISO-8859-1").alias("words"), "doc_id", (F.col("start") + F.col("c.i")).alias("start"), "many",
    )


def removed_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000) -> DataFrame:
    """(doc_id, runs array<struct<start, n>>): runs of n windows from word `start` on whose words also start earlier.

    A minimiser with over `most` rows of stretches is not searched as one shard: its windows are dealt by
    their own content, which finds the same.
    """
    texts = documents_of(docs, id_col, text_col).where("doc_id is not null")
    first = filter_of(materialize(repeated(minimiser_counts(texts, window)), TEXT_ROWS))
    second = filter_of(materialize(repeated(window_counts(texts, window, first)), TEXT_ROWS))
    found = materialize(stretches(texts, window, second), TEXT_ROWS)
    rows = found.select("shard", "key", F.lit(0).cast("long").alias("offset"), "words", "doc_id", "start", F.size("members").alias("many"))
    hot = materialize(rows.groupBy("shard").count().where(F.col("count") > most).select("shard"))
    many = hot.limit(BROADCAST_ROWS + 1).count()
    if many:
        side = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
        rows = rows.join(side, "shard", "left_anti").unionByName(single_windows(rows.join(side, "shard", "left_semi"), window))
    known = materialize(earliest_runs(rows, window))
    met = found.select("key", "members").join(known, "key").select("at", "n", "first_doc", "first_start", F.explode("members").alias("m"))
    later = met.where("first_doc < m.doc_id or first_doc = m.doc_id and first_start < m.start + at")
    return later.groupBy(F.col("m.doc_id").alias("doc_id")).agg(F.collect_set(F.struct((F.col("m.start") + F.col("at")).alias("start"), "n")).alias("runs"))


def dedup_substrings(
    docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), or with texts=True (doc_id, text, n_words, n_removed, *carry) with what is left of the text.

    The kept text is the kept words joined by one space; where nothing is removed, `texts` returns the text
    unchanged. carry: columns of docs that go along, so that no further join has to move the texts.
    """
    own = documents_of(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry) if carry else own
    runs = materialize(removed_windows(docs, window, id_col, text_col))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (p.iloc[i : i + TEXT_ROWS] for p in parts for i in range(0, len(p), TEXT_ROWS)):
            kept_texts, n_words, n_removed, hashes = [], [], [], []
            for text, own_runs in zip(part["text"], part["runs"], strict=True):
                words = encoded(text).split()
                n, kept = len(words), words
                if own_runs is not None:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    for r in own_runs:
                        gone[r["start"]] += 1
                        gone[r["start"] + r["n"] + window - 1] -= 1
                    stay = np.cumsum(gone[:-1]) == 0
                    kept = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                left = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                if texts:
                    kept_texts.append(text if len(kept) == n else left.decode("utf-8", "surrogatepass"))
                else:
                    hashes.append(hashlib.sha256(left).hexdigest())
            out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_words": n_words, "n_removed": n_removed})
            if texts:
                out["text"] = kept_texts
                for c in carry:
                    out[c] = part[c]
            else:
                out["kept_sha256"] = hashes
            yield out

    if texts:
        schema = ", ".join(["doc_id long, text string, n_words long, n_removed long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)])
    else:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return map_frames(rows.join(runs, "doc_id", "left"), run, schema)
