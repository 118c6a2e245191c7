"""URL rules, cross-tokenizer alignment and ranked search against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memloom.llm import alignment, lexical, urlrules

LARGE = 2**53 + 1
SCHEMA = "doc_id long, text string, n_a string, rank string, item_id string"
TEXTS = [
    (1, "Some words, and some more words."), (2, ""), (3, None), (4, " "), (5, "x   "), (6, "  two  gaps \n  and\n lines \t end\n"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"), (8, "ÄÖ é 日本 語 🎉 👩‍👩‍👧"), (9, "▁ x▁y"),
    (10, "a\x00 b \x1c c\x85d　e"), (11, "don't can't I'LL 1234 5678"), (12, "é" * 40), (13, "a" * 2000), (1, "Some words, and some more words."), (None, "some words"), (LARGE, "Words WORDS words; and"), (14, "und das ist die Frage " * 900),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- op 11 ------------------------------------------------------------------


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, rules):
    host, path = parts_of(url)
    fits = [(len(h) + len(p or ""), len(h), h + (p or ""), v) for h, p, v in rules if h and v and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
    if not fits:
        return host, path, None, "allow"
    top = max(f[:2] for f in fits)
    best = [f for f in fits if f[:2] == top]
    return host, path, best[0][2].lower() if best[0][2].lower().startswith(host[-1:]) else best[0][2], max(f[3] for f in best)


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("www.example.com", "/en/a/b", "block"), ("net", "/es/", "block"), ("net", "", "allow"), ("a.b.c.net", "/es/x", "allow"),
    ("example.com", "/en/", "allow"), ("net", None, "allow"), (None, "/", "block"), ("", "/", "block"), ("org", "/", None), ("x.org", "/abcde", "block"), ("yy.x.org", "/ab", "allow"),
]
URLS = [
    "http://example.com/en/1", "http://EXAMPLE.com/en/", "https://www.example.com/en/a/b?x=/", "http://www.example.com/en#/fr", "http://m.www.example.com/en/a", "http://com/", "http://com", "http://notexample.com/en/", "ftp://u@a.b.c.net/es/xy",
    "http://a.b.c.net", "http://net?q", "x", None, "", "://", "http://ÄB.Net/es/", "http://example.com:80/en/", "http://example.com./en/", "http://yy.x.org/abcdef", "http://q/a://b.com/", "http://.com/", "http://" + "a." * 3000 + "net/es/" + "p" * 3000,
]


def test_url_rules_against_every_rule(spark):
    rules = spark.createDataFrame([(h, p, v, 1) for h, p, v in RULES], "host string, path string, verdict string, page_id int")
    rows = [(i if i % 5 else None, u, "x") for i, u in enumerate(URLS * 3)] + [(LARGE, URLS[0], "x")] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(4)
    got = sorted((tuple(r) for r in urlrules.judge_urls(pages, rules).collect()), key=repr)
    assert got == sorted(((i, *judged(u, RULES)) for i, u, _ in rows), key=repr)
    assert urlrules.judge_urls(pages, rules, default="block").where("rule is null and verdict <> 'block'").count() == 0
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0
    assert urlrules.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0


def test_url_ranges_hold_rules_that_began_before(spark, monkeypatch):
    """Thousands of URLs under a few rules, so that rules reach over many ranges."""
    rng = np.random.default_rng(1)
    hosts = [f"h{i}.example.{t}" for i in range(20) for t in ("com", "net")]
    rules = [("com", "/", "allow"), ("example.com", "/a", "block"), ("example.net", "/a/b", "block"), *((h, f"/a/{'bc'[i % 2]}", "allow") for i, h in enumerate(hosts[:9]))]
    urls = [f"http://{hosts[int(rng.integers(0, 40)) if k % 3 else 0]}/a/{'bcd'[k % 3]}/{int(rng.integers(0, 500))}" for k in range(3000)]
    monkeypatch.setattr(urlrules, "BOUND", 20)
    found = urlrules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {tuple(r) for r in found.collect()} == {(i, *judged(u, rules)) for i, u in enumerate(urls)}


# ---- op 12 ------------------------------------------------------------------


def byte_decoder():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            table[chr(256 + n)] = b
            n += 1
    return table


@pytest.fixture(scope="module")
def reference_ids():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = byte_decoder()

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def aligned(tokens):
    a, b = map(spans, tokens)
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups = [([i for i, _, e in a if s < e <= c], [i for i, _, e in b if s < e <= c]) for s, c in zip([0, *cuts], cuts, strict=False)]
    links, start = [], 0
    for i, s, e in a:
        while start < len(b) and b[start][2] <= s:
            start += 1
        j = start
        while j < len(b) and b[j][1] < e:
            links.append((i, b[j][0]))
            j += 1
    text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""


@pytest.mark.parametrize("slice_", [2_000_000, 40])
def test_alignment_against_plain_python(spark, docs, empty, reference_ids, slice_):
    found = [(i, aligned(reference_ids(t))) for i, t in TEXTS]
    count = Counter(p for _, x in found for p in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = [(i, x[0], x[1], x[2], len(x[3]), sum(count[p] == most[p[0]] for p in x[3]), sum(count[p] for p in x[3]), x[4]) for i, x in found]
    got = [tuple(r) for r in alignment.alignment_counts(docs, slice_=slice_).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert alignment.alignment_counts(empty).count() == 0


def test_alignments_give_ids_and_cuts(docs, reference_ids):
    got = {r["doc_id"]: r for r in alignment.alignments(docs).collect()}
    for i, t in TEXTS:
        tokens = reference_ids(t)
        assert [x for x, _ in tokens[0]] == got[i]["a_ids"] and [x for x, _ in tokens[1]] == got[i]["b_ids"]
        ends = [[e for _, _, e in spans(x)] for x in tokens]
        shared = sorted(set(ends[0]) & set(ends[1]))
        assert got[i]["a_cuts"] == [ends[0].index(c) + 1 for c in shared] and got[i]["b_cuts"] == [ends[1].index(c) + 1 for c in shared]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t .\x1c\xa0Z1", max_size=40), max_size=4))
def test_remembered_stretches_give_the_ids_of_whole_texts(reference_ids, texts):
    v = alignment.vocabularies(*alignment._paths(None, None))
    for text, (a, b) in zip(texts, v.encode(texts), strict=True):
        x, y = reference_ids(text)
        assert np.frombuffer(a, "<u4").tolist() == [i for i, _ in x] and np.frombuffer(b, "<u4").tolist() == [i for i, _ in y]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 59)), st.sets(st.integers(1, 59)), st.booleans()), max_size=5))
def test_shared_cuts_are_all_common_ends(texts):
    ends_a, ends_b, first, at = [], [], [0], 0
    for a, b, some in texts:
        if some:  # else a text without tokens
            ends_a += [at + x for x in sorted({*a, 60})]
            ends_b += [at + x for x in sorted({*b, 60})]
            at += 60
        first.append(len(ends_a))
    cuts = alignment.shared_cuts(np.array(ends_a, np.int64), np.array(ends_b, np.int64), np.array(first))
    assert [ends_a[c] for c in cuts] == sorted(set(ends_a) & set(ends_b))


# ---- op 13 ------------------------------------------------------------------


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(rows, items, k):
    held = [(i, Counter(own), len(own)) for i, own in ((i, terms(t)) for i, t in rows) if own]
    many, length, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * many) // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "Words and some more"), (2, ""), (3, None), (None, "words"), (1, "die Frage"), (4, "nowhere9"), (5, " ".join(f"w{i}" for i in range(200))), (6, "日本 é 🎉"), (LARGE, "some " * 50)]


@pytest.mark.parametrize(("block_terms", "cells"), [(50_000, 1 << 22), (70, 64)])
def test_ranks_against_all_scores(spark, docs, empty, block_terms, cells):
    rng = np.random.default_rng(5)
    made = [(100 + i, " ".join(f"W{int(x)}" for x in rng.zipf(1.3, 40) % 300)) for i in range(150)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string")).repartition(2)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, score int")
    for k in (1, 10):
        found = lexical.ranked_documents(more, items, k, block_terms=block_terms, cells=cells)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == ranked(TEXTS + made, ITEMS, k)
    assert lexical.ranked_documents(empty, items).count() == 0
    assert lexical.ranked_documents(docs, items.limit(0)).count() == 0


def test_masks_group_documents_and_later_ones_are_left():
    rng = np.random.default_rng(2)
    table = rng.integers(1, 1000, (70, 900)) * (rng.random((70, 900)) < 0.02)
    weights = rng.integers(1, 9000, 70)
    masks, order, first = lexical.masks_of(np.packbits(table > 0, axis=1), 900)
    assert sorted(order) == list(range(900))
    for mask, own in zip(masks, np.split(order, first[1:]), strict=True):
        assert all(((table[:, d] > 0) == mask).all() for d in own)
    assert len({m.tobytes() for m in masks}) == len(masks)
    best = lexical.Best(10)
    scored = lexical.evaluate(best, np.packbits(table > 0, axis=1), table, weights, table.max(axis=1), np.arange(900), np.zeros(900, bool))
    want = sorted(zip((-(weights @ table)).tolist(), range(900), strict=True))[:10]
    assert list(zip((-best.score).tolist(), best.doc.tolist(), strict=True)) == want
    assert scored < 900
