"""Cross-tokenizer alignment: tokens of two vocabularies over the same bytes, cut where both end.

Each text is encoded with a space before it by a byte-level vocabulary (A) and by a sentence-piece vocabulary
(B, which adds that space itself). Divide and conquer at shared cuts: in an interval of A's tokens an end near
the middle is looked up among B's ends by bisection, the nearest to the middle that both share cuts the
interval in two, and both halves are treated alike; an interval without a shared end is a leaf group. All
intervals of a chunk of texts take a step at once, in arrays.

A pair of tokens is linked where their bytes overlap. `alignments` gives ids and cuts; `alignment_counts` how
many links a text has, how many of them are the commonest for their A id over all texts, and how common they are.

No token goes over a space that follows something other than white space (A's pattern and B's pieces, which
are looked at when loaded, rule it out), so the ids of stretches between such spaces are remembered within a
worker. Texts that are null or empty, or whose tokens are not the text's bytes, have no tokens: counts of zero
and an empty digest. Rows with a null id and repeated rows are texts of their own. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import documents_of, map_frames, materialize

#: Entries of the table of counts that tasks hold at once (16 bytes each); more are looked up in further passes.
SLICE = 2_000_000
#: Stretches of text whose ids a worker remembers (some 350 bytes each).
REMEMBERED = 300_000


class _Remembered(dict):
    """One vocabulary: the ids, 4 bytes each, of stretches with a space before them; None for one that its ids do not give back byte by byte."""

    def __init__(self, encode: Callable[[str], np.ndarray | list[int]], parts: list[bytes]) -> None:
        self.encode, self.parts = encode, parts
        self.sizes = np.array([len(x) for x in parts], dtype=np.int64)
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(parts), np.uint8)

    def _ids(self, text: str) -> np.ndarray | None:
        try:
            data = np.frombuffer(b" " + text.encode(), np.uint8)
        except UnicodeError:  # half a surrogate pair
            return None
        ids = np.asarray(self.encode(text), "<u4")
        sizes = self.sizes[ids]
        have = np.repeat(self.starts[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return ids if len(have) == len(data) and (self.flat[have] == data).all() else None

    def learn(self, stretches: list[str]) -> None:
        """All as one text, whose ids are cut where the stretches end; one by one if that fails, and those that end with white space."""
        closed = [s for s in stretches if not s[-1].isspace()]
        ids = self._ids(" ".join(closed)) if closed else None
        if ids is not None:
            ends, reached = np.cumsum([len(s.encode()) + 1 for s in closed]), np.cumsum(self.sizes[ids])
            at = np.searchsorted(reached, ends)
            if (reached[at] == ends).all():
                packed, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
                self.update(zip(closed, map(packed.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True))
                stretches = [s for s in stretches if s[-1].isspace()]
        for s in stretches:
            ids = self._ids(s)
            self[s] = None if ids is None else ids.tobytes()


class Vocabularies:
    """Both vocabularies: ids of texts with a space before them, and the bytes of each id."""

    #: Where a text is cut: at a space after something other than white space, but for the last. Most texts have no other space.
    CUT, OTHER = re.compile(r"(?<=\S) (?!\Z)"), re.compile(r"\s ")
    BLANKS = [f"{c} " for c in " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f"]

    def __init__(self, ranks: str, model: str) -> None:
        with open(ranks, "rb") as f:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        b = sentencepiece.SentencePieceProcessor(model_file=model)
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, rank in known.items():
            self.a_bytes[rank] = token
        pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether a piece could go over a cut; texts are not cut then.
        self.whole = any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not b.is_byte(i))
        self.a = _Remembered(lambda s: a.encode_to_numpy(f" {s}", disallowed_special=()), self.a_bytes)
        self.b = _Remembered(lambda s: b.encode(s, num_threads=1), self.b_bytes)
        #: Ids as decimals before a comma, or before what ends a side of a group.
        self.words = np.array([f"{i}{end}".encode() for size, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(size) for end in ends], dtype=object)

    def cut(self, text: str | None) -> list[str]:
        if not text or self.whole:
            return [text] if text else []
        plain = text[0] != " " != text[-1] and not (any(x in text for x in self.BLANKS) if text.isascii() else self.OTHER.search(text))
        return text.split(" ") if plain else self.CUT.split(text)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of each text by A and by B; none for a text that its ids do not give back byte by byte."""
        cut = [self.cut(t) for t in texts]
        if len(self.a) > REMEMBERED:
            self.a.clear()
            self.b.clear()
        if new := list(set(chain.from_iterable(cut)) - self.a.keys()):
            self.a.learn(new)
            self.b.learn(new)
        a, b, out = self.a.__getitem__, self.b.__getitem__, []
        for stretches in cut:
            try:
                out.append((b"".join(map(a, stretches)), b"".join(map(b, stretches))))
            except TypeError:  # a stretch that its ids do not give back
                out.append((b"", b""))
        return out


@cache
def vocabularies(ranks: str, model: str) -> Vocabularies:
    """One for each Python worker."""
    return Vocabularies(ranks, model)


def _nearest(ends_a: np.ndarray, ends_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each interval lo..hi of A's tokens the token before hi, nearest to the middle, whose end B shares; -1 if there is none."""
    middle = (lo + hi - 1) // 2
    end = ends_a[middle]
    best = np.where(ends_b[np.searchsorted(ends_b, end)] == end, middle, -1)
    left, reach, width = np.flatnonzero((best < 0) & (hi - lo > 1)), 1, 1
    while len(left):
        away = np.arange(reach, reach + width)
        tried = middle[left][:, None] + np.stack([away, -away], axis=1).ravel()[None, :]
        inside = (tried >= lo[left][:, None]) & (tried < hi[left][:, None])
        end = ends_a[np.where(inside, tried, 0)]
        hit = inside & (ends_b[np.searchsorted(ends_b, end)] == end)
        first = hit.argmax(axis=1)
        some = hit[np.arange(len(left)), first]
        best[left[some]] = tried[some, first[some]]
        reach += width
        width *= 2
        left = left[~some & ((middle[left] + reach < hi[left]) | (middle[left] - reach >= lo[left]))]
    return best


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The tokens of A, ascending, at whose ends B ends too. Ends ascend over all texts; first: each text's first token of A, and their number."""
    lo, hi = first[:-1], first[1:] - 1
    found = [hi[hi >= lo]]
    lo, hi = lo[hi > lo], hi[hi > lo]
    while len(lo):
        at = _nearest(ends_a, ends_b, lo, hi)
        cut = at >= 0
        lo, hi, at = lo[cut], hi[cut], at[cut]
        found.append(at)
        lo, hi = np.concatenate([lo, at + 1]), np.concatenate([at, hi])
        more = hi > lo
        lo, hi = lo[more], hi[more]
    return np.sort(np.concatenate(found))


class Aligned:
    """The alignment of a chunk of texts."""

    def __init__(self, texts: list[str | None], v: Vocabularies) -> None:
        both = v.encode(texts)
        self.v, self.n = v, len(texts)
        self.a, self.b = (np.frombuffer(b"".join([x[side] for x in both]), "<u4").astype(np.int64) for side in (0, 1))
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum([len(x[side]) // 4 for x in both])]) for side in (0, 1))
        self.ends_a, self.ends_b = np.cumsum(v.a.sizes[self.a]), np.cumsum(v.b.sizes[self.b])
        self.cuts_a = shared_cuts(self.ends_a, self.ends_b, self.first_a)
        self.cuts_b = np.searchsorted(self.ends_b, self.ends_a[self.cuts_a])
        self.groups = np.searchsorted(self.cuts_a, self.first_a)  # each text's first group

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as `a1,a2|b1;a3|b2,b3`, empty for texts without tokens."""
        n, m = len(self.a), len(self.b)
        last_a, last_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
        last_a[self.cuts_a] = last_b[self.cuts_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        words = np.empty(n + m, np.int64)
        words[np.arange(n) + np.concatenate([[0], self.cuts_b + 1])[group_a]] = 2 * self.a + last_a
        words[np.arange(m) + (self.cuts_a + 1)[group_b] if m else np.zeros(0, np.int64)] = 2 * len(self.v.a_bytes) + 2 * self.b + last_b
        listed = self.v.words[words].tolist()
        at = (self.first_a + self.first_b).tolist()
        return [hashlib.sha256(b"".join(listed[s:e])[:-1]).hexdigest() if e > s else "" for s, e in zip(at, at[1:], strict=False)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(token of A, token of B) for each overlap: each token of A with the token of B at its end, and the other way round where only B ends."""
        own = np.ones(len(self.b), bool)
        own[self.cuts_b] = False
        own = np.flatnonzero(own)
        i = np.concatenate([np.arange(len(self.a)), np.searchsorted(self.ends_a, self.ends_b[own])])
        return i, np.concatenate([np.searchsorted(self.ends_b, self.ends_a), own])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's different linked pairs of ids (a times B's size plus b), ascending; how often each; and each text's first."""
        i, j = self.links()
        size = len(self.v.a_bytes) * len(self.v.b_bytes)
        text = np.searchsorted(self.first_a, i, "right") - 1
        keys, times = np.unique(text * size + self.a[i] * len(self.v.b_bytes) + self.b[j], return_counts=True)
        return keys % size, times, np.searchsorted(keys, np.arange(self.n + 1) * size)


def _chunks(texts: pd.Series, limit: int = 1 << 18) -> Iterator[tuple[int, list]]:
    start, size, out = 0, 0, []
    for text in texts:
        if out and size + len(text or "") > limit:
            yield start, out
            start, size, out = start + len(out), 0, []
        out.append(text)
        size += len(text or "") + 1
    if out:
        yield start, out


def _paths(ranks: str | None, model: str | None) -> tuple[str, str]:
    return ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), model or public_tokenizers.path("piece_bpe_32k.model")


def alignments(docs: DataFrame, ranks: str | None = None, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts): the ids of each text, and for each group how many tokens of A and of B end with it or before."""
    paths = _paths(ranks, model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabularies(*paths)
        for part in parts:
            for start, texts in _chunks(part["text"]):
                x = Aligned(texts, v)
                split = lambda values, at: np.split(values, at[1:-1])
                a_cuts, b_cuts = ([c + 1 - at[k] for k, c in enumerate(split(cuts, x.groups))] for cuts, at in ((x.cuts_a, x.first_a), (x.cuts_b, x.first_b)))
                own = part["doc_id"].iloc[start : start + len(texts)].astype("Int64").array
                yield pd.DataFrame({"doc_id": own, "a_ids": split(x.a, x.first_a), "b_ids": split(x.b, x.first_b), "a_cuts": a_cuts, "b_cuts": b_cuts})

    return map_frames(documents_of(docs, id_col, text_col), run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


def alignment_counts(docs: DataFrame, ranks: str | None = None, model: str | None = None, slice_: int = SLICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A pair's count is the number of texts that hold it linked. Texts are encoded once; their different pairs
    are written, counted by aggregation, and looked up in the counts of two and more (what is not among these counts one), so many
    entries at a time as a task can hold. The driver passes these slices on, and one bit for each id of A.
    """
    paths = _paths(ranks, model)
    a_size, b_size = (len(x) for x in (lambda v: (v.a_bytes, v.b_bytes))(vocabularies(*paths)))
    kind = "<u4" if a_size * b_size < 1 << 32 else "<i8"

    def align(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabularies(*paths)
        for part in parts:
            for start, texts in _chunks(part["text"]):
                x = Aligned(texts, v)
                pairs, times, at = x.pairs()
                packed = lambda values, form: [values[s:e].astype(form).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                n_a, n_b, n_groups = np.diff(x.first_a), np.diff(x.first_b), np.diff(x.groups)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].iloc[start : start + len(texts)].astype("Int64").array, "n_a": n_a, "n_b": n_b, "n_groups": n_groups,
                    "n_links": n_a + n_b - n_groups, "groups_sha256": x.digests(), "pairs": packed(pairs, kind), "times": packed(times, "<u4"),
                })

    counts_of = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    rows = materialize(map_frames(documents_of(docs, id_col, text_col), align, counts_of))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held, size = [], 0
            for own in [*part["pairs"], None]:
                if own is not None:
                    held.append(own)
                    size += len(own)
                if held and (own is None or size > 1 << 23):
                    pair, n = np.unique(np.frombuffer(b"".join(held), kind), return_counts=True)
                    yield pd.DataFrame({"pair": pair.astype(np.int64), "n": n})
                    held, size = [], 0

    counts = materialize(rows.select("pairs").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1"))
    a_id = F.expr(f"pair div {b_size}")
    most = materialize(counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most")))
    known = np.zeros(a_size, bool)
    known[[r["a"] for r in most.select("a").collect()]] = True  # at most one row for each id of A
    counts = counts.withColumn("a", a_id).join(most, "a").select("pair", F.expr("2 * n + cast(n = most as int)").alias("value"))
    passes = max(1, -(-counts.count() // slice_))
    counts = materialize(counts.withColumn("slice", F.pmod(F.xxhash64("pair"), F.lit(passes))))
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})

    def added(rows: DataFrame, number: int) -> DataFrame:
        own = counts.where(F.col("slice") == number).select("pair", "value").toArrow()
        pair, value = (own[c].to_numpy() for c in ("pair", "value"))
        order = np.argsort(pair)
        pair, value = pair[order], value[order]

        def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                best, total = [], []
                for p, t in zip(part["pairs"], part["times"], strict=True):
                    p, t = np.frombuffer(p, kind).astype(np.int64), np.frombuffer(t, "<u4").astype(np.int64)
                    at = np.minimum(np.searchsorted(pair, p), max(len(pair) - 1, 0))
                    hit = pair[at] == p if len(pair) else np.zeros(len(p), bool)
                    found = value[at[hit]]
                    # In the first pass each pair counts one and is the best of an id of which all count one.
                    best.append((t[hit] * (found & 1)).sum() + (0 if number else t[~known[p // b_size]].sum()))
                    total.append((t[hit] * ((found >> 1) - 1)).sum() + (0 if number else t.sum()))
                yield part.assign(n_best=part["n_best"] + np.array(best, np.int64), count_sum=part["count_sum"] + np.array(total, np.int64))

        return map_frames(rows, look, f"{counts_of}, n_best long, count_sum long")

    for number in range(passes):
        rows = added(rows if number == 0 else materialize(rows), number)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
