"""Document fingerprints: a Merkle tree over paragraphs and sections.

Leaves are pieces of a paragraph (runs of words, cut where a word's hash says so, about four words long),
their parents are paragraphs (lines), sections are runs of about eight paragraphs, cut where a paragraph's
digest says so, and the root is over the sections. Cuts depend on content alone, so an edit changes the
leaves it touches and the branches above them, wherever it lies and however it moves the rest. A leaf's
digest has 128 bits; every node above is the SHA-256 of its children's digests.

A fingerprint is the tree as text: the root, a colon, and the sections with `/` between them. A section is
its digest (64 bits shown), `=`, and its paragraphs with `.` between them; a paragraph is its digest (as
many), `-`, and its leaves' digests (32 bits shown). Roots test equality; sections and paragraphs that
differ locate edits (`differences`), and the leaves give a likeness (`likeness`) between 0 and 1.

A null text counts as empty; an empty text has a root and no leaf. White space is part of the pieces, so
equal fingerprints mean equal texts (up to collisions of 128-bit hashes). Rows with a null id are left out, as they have no next document; of
rows that repeat an id the order is by text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import documents_of, map_frames

LEAF_WORDS, SECTION_PARAGRAPHS = 4, 8
#: Hexadecimal digits of a leaf's and of a node's digest in a fingerprint.
LEAF_HEX, NODE_HEX = 8, 16


def _paragraph(line: bytes) -> tuple[bytes, tuple[str, ...]]:
    """A line's node digest and its leaves' digests; a leaf ends at each word whose hash is a multiple of LEAF_WORDS."""
    pieces, start, at = [], 0, 0
    hashed = xxhash.xxh32_intdigest
    for w in line.split(b" "):
        at += len(w) + 1
        if hashed(w) % LEAF_WORDS == 0:
            pieces.append(line[start:at])
            start = at
    if start < len(line):
        pieces.append(line[start:])
    digests = b"".join(map(xxhash.xxh3_128_digest, pieces))
    shown = digests.hex()
    return hashlib.sha256(digests).digest(), tuple(shown[i : i + LEAF_HEX] for i in range(0, len(shown), 32))


Paragraph = tuple[str, tuple[str, ...]]
Tree = tuple[str, list[tuple[str, list[Paragraph]]]]


def tree(text: str | None, known: dict | None = None) -> Tree:
    """(root, sections), a section being (digest, paragraphs), a paragraph (digest, leaf digests). known keeps paragraphs that have been seen."""
    known = {} if known is None else known
    sections, section, nodes = [], [], []
    top = hashlib.sha256()

    def close() -> None:
        if section:
            node = hashlib.sha256(b"".join(nodes))
            top.update(node.digest())
            sections.append((node.hexdigest()[:NODE_HEX], section.copy()))
            section.clear()
            nodes.clear()

    for line in (text or "").encode("utf-8", "surrogatepass").splitlines(keepends=True):
        if line not in known:
            known[line] = _paragraph(line)
        node, leaves = known[line]
        section.append((node.hex()[:NODE_HEX], leaves))
        nodes.append(node)
        if node[0] % SECTION_PARAGRAPHS == 0:
            close()
    close()
    return top.hexdigest(), sections


def leaf_counts(t: Tree) -> Counter:
    return Counter(chain.from_iterable(leaves for _, section in t[1] for _, leaves in section))


def as_text(t: Tree) -> str:
    return t[0] + ":" + "/".join(s + "=" + ".".join(p + "-" + "".join(x) for p, x in section) for s, section in t[1])


def branches(fingerprint: str) -> list[tuple[str, list[Paragraph]]]:
    """The sections of `tree`, read from its text."""
    out = []
    for section in filter(None, fingerprint.partition(":")[2].split("/")):
        digest, _, body = section.partition("=")
        parts = [p.partition("-") for p in body.split(".")]
        out.append((digest, [(p, tuple(x[i : i + LEAF_HEX] for i in range(0, len(x), LEAF_HEX))) for p, _, x in parts]))
    return out


def likeness(a: str, b: str) -> float:
    """Shared leaves of both, twice, over all leaves of both (repeats count); 1 for equal roots."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    return _shared(leaf_counts(("", branches(a))), leaf_counts(("", branches(b))))


def _shared(x: Counter, y: Counter) -> float:
    total = x.total() + y.total()
    if len(y) < len(x):
        x, y = y, x
    return 2 * sum(min(n, y[k]) for k, n in x.items() if k in y) / total if total else 0.0


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of each paragraph of a that b lacks: equal branches are passed over whole."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    there = branches(b)
    whole, parts = {digest for digest, _ in there}, {p for _, section in there for p, _ in section}
    return [(i, j) for i, (digest, own) in enumerate(branches(a)) if digest not in whole for j, (p, _) in enumerate(own) if p not in parts]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "fingerprint": [as_text(tree(t)) for t in part["text"]]})

    return map_frames(documents_of(docs, id_col, text_col), run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter (rounded down) replaced by as many first code points of the
    next document in ascending doc_id (the first, after the last). Texts move once: rows are dealt by
    range of doc_id, and the first row of each range also to the range before it. The driver gets the
    ranges' bounds, eight for each shuffle partition.
    """
    spark = docs.sparkSession
    rows = documents_of(docs, id_col, text_col).where("doc_id is not null")
    ids = rows.select("doc_id")
    ranges = min(8192, max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = ids.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()
    bounds = np.array(sorted(set(got["q"] or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(), "right").astype(np.int32))

    found = sorted((r["r"], r["first"]) for r in ids.groupBy(range_of("doc_id").alias("r")).agg(F.min("doc_id").alias("first")).collect())
    before = {first: found[i - 1][0] for i, (_, first) in enumerate(found)}

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series) -> pd.Series:
        """Twice the range; as a guest, twice the range before and one."""
        own = np.searchsorted(bounds, doc_id.to_numpy(), "right").tolist()
        return pd.Series([[2 * r, 2 * before[d] + 1] if d in before else [2 * r] for r, d in zip(own, doc_id.tolist(), strict=True)])

    dealt = rows.select("doc_id", "text", F.explode(places("doc_id")).alias("place"))
    dealt = dealt.select("doc_id", "text", F.shiftright("place", 1).alias("r"), (F.col("place") % 2).alias("guest"))
    dealt = dealt.repartition("r").sortWithinPartitions("r", "guest", "doc_id", "text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for part in parts:
            out = []
            for doc, text, r, guest in zip(part["doc_id"], part["text"], part["r"], part["guest"], strict=True):
                if guest and (last is None or last[0] != r):
                    continue  # a further guest of the same id
                known: dict = {}
                t = tree(text, known)
                now = (r, doc, text or "", t, leaf_counts(t), known)
                if last is not None and last[0] == r:
                    out.append(_edited(last, now))
                last = None if guest else now
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _edited(own: tuple, following: tuple) -> tuple:
    _, doc, text, t, counts, known = own
    _, _, next_text, next_tree, next_counts, next_known = following
    cut = len(text) // 4
    edited = text[: len(text) - cut] + next_text[:cut]
    e = tree(edited, known | next_known if cut else known)
    alike = lambda other, its: 1.0 if other[0] == t[0] else _shared(counts, its)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), sha, as_text(t), as_text(e), alike(e, leaf_counts(e)), alike(next_tree, next_counts)
