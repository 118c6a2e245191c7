"""SimHash near-duplicates: fingerprints, exact linking by pigeonhole blocks, and groups of similar texts.

`simhash_components` finds every pair of fingerprints within `max_distance` bits: the 64 bits are split
into max_distance + 2 blocks, so two close fingerprints agree in two blocks at least; rows are joined on
each pair of blocks and the Hamming distance is verified. Copies are collapsed to one fingerprint first.
Links that join what is already one component add nothing, so cheap links come first (neighbours in the
sorted blocks), and the exact join then looks only across components and only where a bucket holds two.

`similar_groups` is for similarities (0.8 of shared shingles) at which a fingerprint differs in about a
sixth of its bits, where blocks of which one must agree would be a few bits long and pair everything. There
blocks of 256-bit fingerprints come first and find what is nearest, pairs that they leave apart are joined
on rare shingles, and a pair is linked only if the shingle sets themselves are as similar.

Null and empty texts have no shingle and fingerprint zero; they are linked like any other. Rows whose id
is null count as documents of their own fingerprint but never name a component. Repeated rows come back
repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import TEXT_ROWS, chunks, connected_components, documents_of, encoded, map_frames, materialize, mix64, run_hashes, words_of
from memloom.llm.labelled import BROADCAST_ROWS
from memloom.llm.repeats import Filter, filter_of, repeated


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ngram words of a text, A-Z in lower case; fewer words: of them all."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    runs = zip(*(w[i:] for i in range(ngram)), strict=False) if len(w) >= ngram else [w]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in map(b" ".join, runs)), dtype=np.uint64)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """The bits (0 or 1, most significant first) that are set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return (2 * votes > len(hashes)).astype(np.uint8)


def as_long(bits: np.ndarray) -> np.int64:
    return np.packbits(bits).view(">i8")[0].astype(np.int64)


def fingerprints(docs: DataFrame, ngram: int = 4, id_col: str = "doc_id", text_col: str = "text", lanes: int = 1) -> DataFrame:
    """(doc_id, fp array<long>): lanes times 64 bits; the first lane is the plain 64-bit fingerprint."""
    odd = [np.uint64(0x9E3779B97F4A7C15 * i & (2**64 - 1)) for i in range(lanes)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"]:
                h = shingle_hashes(encoded(text), ngram)
                out.append([as_long(majority_bits(mix64(h + x) if i else h)) for i, x in enumerate(odd)])
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "fp": out})

    return map_frames(documents_of(docs, id_col, text_col), run, "doc_id long, fp array<long>")


def _block_keys(fp: str, max_distance: int, bits: int = 64) -> list:
    """One key for each pair of blocks: the pair's number above the bits of both blocks."""
    n = max_distance + 2
    cuts = [round(i * bits / n) for i in range(n + 1)]
    block = lambda i: F.shiftrightunsigned(F.col(fp), cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    keys = []
    for number, (i, j) in enumerate(combinations(range(n), 2)):
        low = cuts[j + 1] - cuts[j]
        keys.append(F.shiftleft(block(i), low).bitwiseOR(block(j)).bitwiseOR(F.lit(number << 48)))
    return keys


def _neighbour_links(entries: DataFrame, max_distance: int, reach: int = 8) -> DataFrame:
    """Links among the next `reach` fingerprints of a block's order. Range partitioning splits a hot block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in parts:
            key, fp = np.concatenate([key, part["key"].to_numpy()]), np.concatenate([fp, part["fp"].to_numpy()])
            x, y = [], []
            for s in range(1, min(reach, len(fp) - 1) + 1):
                near = (key[s:] == key[:-s]) & (np.bitwise_count((fp[s:] ^ fp[:-s]).view(np.uint64)) <= max_distance)
                x.append(fp[s:][near])
                y.append(fp[:-s][near])
            key, fp = key[-reach:], fp[-reach:]
            if x:
                yield pd.DataFrame({"a": np.concatenate(x), "b": np.concatenate(y)}).drop_duplicates()

    dealt = entries.select("key", "fp").repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    return dealt.mapInPandas(run, "a long, b long")


def hamming_components(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """(fp, component) for each distinct long in fps.fp: components of all pairs within max_distance bits.

    component is one fingerprint of the component. Exact: no pair is missed, none is added.
    """
    keys = _block_keys("fp", max_distance)
    uniq = materialize(fps.select("fp").distinct())
    entries = uniq.select("fp", F.explode(F.array(*keys)).alias("key"))
    near = connected_components(_neighbour_links(entries, max_distance)).withColumnRenamed("id", "fp")
    known = uniq.join(near, "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp"))
    sizes = known.groupBy("comp").agg(F.count("*").alias("n"))
    known = materialize(known.join(sizes, "comp"))
    entries = materialize(known.select("fp", "comp", "n", F.explode(F.array(*keys)).alias("key")))
    # Within a bucket, one side of a pair across components lies outside of the bucket's largest component.
    mixed = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("n", "comp")).alias("top"))
    mixed = materialize(mixed.where("lo <> hi").select("key", F.col("top.comp").alias("top")))
    rest = entries.join(mixed, "key").where("comp <> top").select(F.col("key").alias("key2"), F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
    rest = materialize(rest)
    own = entries.select("key", "fp", "comp")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_distance
    across = own.join(rest, (F.col("key") == F.col("key2")) & (F.col("comp") != F.col("comp2")) & close)
    more = connected_components(across.select(F.col("comp").alias("a"), F.col("comp2").alias("b")).distinct())
    more = more.select(F.col("id").alias("comp"), F.col("component").alias("wider"))
    return known.select("fp", "comp").join(more, "comp", "left").select("fp", F.coalesce("wider", "comp").alias("component"))


def simhash_components(docs: DataFrame, max_distance: int = 4, ngram: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest doc_id that links reach."""
    prints = materialize(fingerprints(docs, ngram, id_col, text_col).select("doc_id", F.col("fp")[0].alias("fp")))
    comps = materialize(hamming_components(prints, max_distance))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(comps, "fp")
    least = first.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialize(first.join(least, "component").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bits_at(similarity: float, bits: int) -> int:
    """How many of so many bits differ, in the mean, between sets of equal size with this Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def shingle_sets(texts: list[bytes], ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of its different shingles, and these as 64-bit hashes, ascending within each text, one text after the other.

    A-Z in lower case; a text of fewer than ngram words has one shingle, all of them; one without words has none.
    """
    _, _, _, words, first = words_of([t.lower() for t in texts])
    sizes = np.diff(first)
    left = np.repeat(first[1:], sizes) - np.arange(len(words))
    at = np.flatnonzero(left >= ngram)
    of, h = np.searchsorted(first, at, "right") - 1, run_hashes(words, ngram)[at] if len(at) else np.zeros(0, np.uint64)
    for k in range(1, ngram):
        short = np.flatnonzero(sizes == k)
        if len(short):
            of, h = np.concatenate([of, short]), np.concatenate([h, run_hashes(words, k)[first[short]]])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return np.bincount(of[new], minlength=len(texts)), h[new]


def _sets(texts: pd.Series, ngram: int) -> Iterator[np.ndarray]:
    for _, some in chunks(texts):
        sizes, h = shingle_sets(some, ngram)
        yield from np.split(h, np.cumsum(sizes)[:-1])


def _wide_prints(sizes: np.ndarray, h: np.ndarray, lanes: int) -> np.ndarray:
    """A fingerprint of lanes times 64 bits for each text."""
    out, has = np.zeros((len(sizes), lanes), np.int64), sizes > 0
    starts = (np.cumsum(sizes) - sizes)[has]
    for i in range(lanes if len(h) else 0):
        bits = np.unpackbits(mix64(h + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[has, i] = np.packbits(2 * votes > sizes[has][:, None], axis=1).view(">i8")[:, 0]
    return out


def _common_shingles(texts: DataFrame, ngram: int, part: int = 16, levels: tuple[int, ...] = (2, 32)) -> list[Filter]:
    """Filters of the shingles that occur `levels` times in one of `part` texts. They only order shingles, rare ones first, which no result depends on."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for _, some in chunks(rows["text"]):
                h, n = np.unique(shingle_sets(some, ngram)[1], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    taken = texts.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text")
    counts = taken.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where(F.col("n") >= min(levels)), TEXT_ROWS)
    return [filter_of(counts.where(F.col("n") >= n)) for n in levels]


def _with_texts(rows: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """rows with the text of the set rows.v; ids: (v, first, whole), where to find one. Texts stay where they are if rows are few. Documents that are there twice come twice."""
    wanted = materialize(rows.join(ids.select("v", F.col("first").alias("doc_id"), "whole"), "v"))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    read = texts.withColumn("whole", F.xxhash64("text")).join(F.broadcast(wanted) if few else wanted, ["doc_id", "whole"])
    return read.select(*rows.columns, "text")


def _similar_links(pairs: DataFrame, texts: DataFrame, ids: DataFrame, similarity: float, ngram: int) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard similarity is as high."""

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for part in parts:
            out = []
            for a, b, v, own in zip(part["a"], part["b"], part["v"], _sets(part["text"], ngram), strict=True):
                if last is not None and last[:2] == (a, b):
                    if v != last[2]:  # else the same document again
                        both = len(np.intersect1d(last[3], own, assume_unique=True))
                        if both / (len(last[3]) + len(own) - both) >= similarity:
                            out.append((a, b))
                else:
                    last = a, b, v, own
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64").drop_duplicates()

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("v"))
    met = _with_texts(ends, texts, ids).repartition("a", "b").sortWithinPartitions("a", "b", "v")
    return materialize(met.mapInPandas(verify, "a long, b long"), TEXT_ROWS)


def _shared(x: list[np.ndarray], y: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """How many elements each set of x shares with each of y, over `step` elements at a time."""
    ax, ay = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(ax, ay)
    rx, ry = np.repeat(np.arange(len(x)), [len(s) for s in x]), np.repeat(np.arange(len(y)), [len(s) for s in y])
    out = np.zeros((len(x), len(y)), np.float32)
    for c in range(0, len(common), step):
        some = common[c : c + step]
        sides = []
        for rows, of, size in ((ax, rx, len(x)), (ay, ry, len(y))):
            at = np.minimum(np.searchsorted(some, rows), len(some) - 1)
            hit = some[at] == rows
            m = np.zeros((size, len(some)), np.float32)
            m[of[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _hot_links(own: DataFrame, texts: DataFrame, ids: DataFrame, similarity: float, ngram: int, tile: int = 1024) -> DataFrame:
    """Links (a, b) across components under keys with many sets; own: (h, v, comp, top, held, kept), top being the key's largest component with `kept` of its `held` sets.

    Each key's sets outside of its largest component meet all its sets, dealt into cells of about tile times
    tile; a cell counts shared shingles by a matrix product and gives spanning links only, so no task holds a
    whole key and no pair leaves one.
    """

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.assign(set=list(_sets(cell["text"], ngram)))
        left, right = cell[cell["side"] == 0], cell[cell["side"] == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            both = _shared(list(left["set"]), list(right["set"]))
            n, m = (f["set"].map(len).to_numpy() for f in (left, right))
            near = both / (n[:, None] + m[None, :] - both) >= similarity
            near &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(near), strict=True):
                x, y = find(left["comp"].iat[i]), find(right["comp"].iat[j])
                if x != y:
                    root[x] = y
                    out.append((left["v"].iat[i], right["v"].iat[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    tiles = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(tile))).cast("int")
    sized = own.withColumns({"across": tiles(F.col("held") - F.col("kept")), "down": tiles(F.col("held"))})
    dealt = lambda n, seed: F.pmod(F.xxhash64("v", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = sized.where("comp <> top").select("h", dealt("across", 1).alias("i"), every("down").alias("j"), "v", "comp", F.lit(0).alias("side"))
    inner = sized.select("h", every("across").alias("i"), dealt("down", 2).alias("j"), "v", "comp", F.lit(1).alias("side"))
    found = materialize(_with_texts(own.select("v").distinct(), texts, ids))
    cells = outer.union(inner).join(found, "v").groupBy("h", "i", "j").applyInPandas(compare, "a long, b long")
    return materialize(cells.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def similar_groups(
    docs: DataFrame, similarity: float = 0.8, ngram: int = 5, reach: int = 4, small: int = 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, component_id): components of all pairs whose sets of word shingles have at least this Jaccard similarity.

    Exact (up to equal 64-bit hashes): every link is verified on the shingle sets, and no pair is missed.
    First pass, pigeonhole blocks: 256-bit fingerprints are split into 16 blocks; under each block they are
    sorted, and each takes the nearest of the `reach` before it that share the block, within the bits that
    differ at `similarity`; of all blocks each fingerprint keeps its nearest. Each component has its closest
    candidate in another verified, for as long as at least half of these link. Blocks find all but surely
    what is very near, so this collapses large groups of copies; at 0.8 itself a pair shares a block in seven
    of ten cases only. Second pass, what that leaves: pairs across components are joined on their first
    shingles in one order, rare ones first (two such sets share one of the first n - ceil(similarity * n) + 1),
    and verified, but for those whose places of the last shared one leave too few shingles behind it. Keys
    with over `small` sets are compared in cells (see _hot_links).

    Texts without a word (null, empty, blank) and rows without an id stay alone (component_id null for the
    latter). Rows that repeat an id count as that document. Of a group the smallest id names it; ties have no
    part in it. An empty table gives an empty result; other columns are not read.
    """
    lanes, blocks = 4, 16
    limit = bits_at(similarity, 64 * lanes)
    texts = documents_of(docs, id_col, text_col)
    common = _common_shingles(texts, ngram)

    def sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i, some in chunks(part["text"]):
                sizes, h = shingle_sets(some, ngram)
                prints = _wide_prints(sizes, h, lanes)
                starts = np.cumsum(sizes) - sizes
                rank = np.sum([f.has(h) for f in common], axis=0, dtype=np.int8)
                of = np.repeat(np.arange(len(sizes)), sizes)
                ordered = h[np.lexsort((h, rank, of))].view(np.int64)
                first = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + (sizes > 0)
                names = [np.uint64(xxhash.xxh3_64_intdigest(h[s : s + n].tobytes(), 42)).astype(np.int64) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                own = part.iloc[i : i + len(some)]
                yield pd.DataFrame({
                    "doc_id": own["doc_id"].astype("Int64").array, "v": names, "whole": own["whole"].array, "n": sizes.astype(np.int32), "fp": list(prints),
                    "keys": [ordered[s : s + k] for s, k in zip(starts.tolist(), first.tolist(), strict=True)],
                })

    prints = materialize(map_frames(texts.withColumn("whole", F.xxhash64("text")), sketch, "doc_id long, v long, whole long, n int, fp array<long>, keys array<long>"), TEXT_ROWS)
    words = prints.where("n > 0 and doc_id is not null")
    uniq = words.groupBy("v").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("whole", "n", "fp", "keys"), "doc_id").alias("s"))
    uniq = materialize(uniq.select("v", "first", "s.whole", "s.n", "s.fp", "s.keys"))

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, fp, v = np.zeros(0, np.int64), np.zeros((0, lanes), np.int64), np.zeros(0, np.int64)
        for part in parts:
            if not len(part):
                continue
            old = len(v)
            block = np.concatenate([block, part["number"].to_numpy() << 16 | (part["place"].to_numpy() >> 48) & 0xFFFF])
            fp = np.concatenate([fp, np.stack(part["fp"].to_numpy()).astype(np.int64)])
            v = np.concatenate([v, part["v"].to_numpy()])
            best, to = np.full(len(v), limit + 1), np.full(len(v), -1)
            for s in range(1, min(reach, len(v) - 1) + 1):
                apart = np.bitwise_count((fp[s:] ^ fp[:-s]).view(np.uint64)).sum(axis=1)
                closer = np.flatnonzero((block[s:] == block[:-s]) & (apart < best[s:]))
                best[closer + s], to[closer + s] = apart[closer], closer
            own = np.flatnonzero(to >= 0)
            own = own[own >= old]
            yield pd.DataFrame({"v": v[own], "w": v[to[own]], "apart": best[own].astype(np.int32)})
            block, fp, v = block[-reach:], fp[-reach:], v[-reach:]

    lane = lambda i: F.col("fp")[i % lanes]
    places = [
        lane(q) if not r else F.shiftleft(lane(q), r).bitwiseOR(F.shiftrightunsigned(lane(q + 1), 64 - r))
        for q, r in (divmod(64 * lanes // blocks * i, 64) for i in range(blocks))
    ]
    tables = uniq.select("v", "fp", F.posexplode(F.array(*places)).alias("number", "place"))
    tables = tables.repartitionByRange("number", "place").sortWithinPartitions("number", "place", "v")
    near = tables.mapInPandas(nearest, "v long, w long, apart int").groupBy("v").agg(F.min(F.struct("apart", "w")).alias("to"))
    near = materialize(near.select(F.least("v", "to.w").alias("a"), F.greatest("v", "to.w").alias("b"), "to.apart").distinct())

    def named(links: DataFrame) -> DataFrame:
        """(v, comp) for each set that has links."""
        return materialize(connected_components(links).select(F.col("id").alias("v"), F.col("component").alias("comp")))

    def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            comp = comps.select(F.col("v").alias(end), F.col("comp").alias(f"{end}_in"))
            pairs = pairs.join(comp, end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
        return pairs.where("a_in <> b_in")

    links = near.select("a", "b").limit(0)
    comps, left = links.selectExpr("a as v", "b as comp"), near
    while True:
        left = materialize(across(left, comps).select("a", "b", "apart", F.greatest("a_in", "b_in").alias("of")))
        best = left.groupBy("of").agg(F.min(F.struct("apart", "a", "b")).alias("p"))
        best = materialize(best.select("p.a", "p.b").distinct())
        tried = best.count()
        if not tried:
            break
        found = _similar_links(best, texts, uniq, similarity, ngram)
        linked = found.count()
        if linked:
            links = links.union(found)
            comps = named(links)
        if 2 * linked < tried:
            break
        left = left.join(best, ["a", "b"], "left_anti").select("a", "b", "apart")

    chosen = filter_of(materialize(repeated(uniq.select(F.explode("keys").alias("h"), F.lit(1).alias("n")))))

    def entries_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            sizes = part["keys"].map(len).to_numpy()
            h = np.concatenate(part["keys"].to_numpy()).astype(np.int64)
            some = chosen.has(h.view(np.uint64))
            place = np.concatenate([np.arange(n) for n in sizes])
            yield pd.DataFrame({"h": h[some], "at": place[some], "v": np.repeat(part["v"].to_numpy(), sizes)[some], "n": np.repeat(part["n"].to_numpy(), sizes)[some]})

    entries = uniq.select("v", "n", "keys").mapInPandas(entries_of, "h long, at int, v long, n int")
    entries = materialize(entries.join(comps, "v", "left").select("h", "at", "v", "n", F.coalesce("comp", "v").alias("comp")))
    # Of a pair across components, one side lies outside of its key's largest component.
    parts = entries.groupBy("h", "comp").agg(F.count("*").alias("many"))
    mixed = parts.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("many").alias("held"), F.max(F.struct("many", "comp")).alias("top")).where("kinds > 1")
    mixed = materialize(mixed.select("h", "held", F.col("top.comp").alias("top"), F.col("top.many").alias("kept")))
    every = materialize(entries.join(mixed, "h"))
    own = every.where(F.col("held") <= small)
    rest = own.where("comp <> top").select("h", *(F.col(c).alias(f"{c}2") for c in ("at", "v", "n", "comp")))
    alike = F.least("n", "n2") >= (similarity - 1e-9) * F.greatest("n", "n2")
    pairs = own.join(rest, "h").where(alike & F.expr("comp <> comp2 and (comp = top or v < v2)"))
    pairs = pairs.groupBy("v", "v2", "n", "n2").agg(F.count("*").alias("both"), F.max("at").alias("at"), F.max("at2").alias("at2"))
    most = F.col("both") + F.least(F.expr("n - at - 1"), F.expr("n2 - at2 - 1"))
    pairs = pairs.where(most >= similarity / (1 + similarity) * (F.col("n") + F.col("n2")) - 1e-6)
    pairs = materialize(pairs.select(F.least("v", "v2").alias("a"), F.greatest("v", "v2").alias("b")).distinct())
    links = links.union(_similar_links(pairs, texts, uniq, similarity, ngram))
    hot = every.where(F.col("held") > small).select("h", "v", "comp", "top", "held", "kept")
    if not hot.isEmpty():
        links = links.union(_hot_links(hot, texts, uniq, similarity, ngram))
    comps = named(links)

    grouped = uniq.select("v", "first").join(comps, "v", "left").select("v", "first", F.coalesce("comp", "v").alias("comp"))
    least = grouped.groupBy("comp").agg(F.min("first").alias("component_id"))
    grouped = materialize(grouped.join(least, "comp").select("v", "component_id"))
    grouped = prints.select("doc_id", F.when(F.col("n") > 0, F.col("v")).alias("v")).join(grouped, "v", "left")
    return grouped.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
