"""Each corpus operator against a brute-force version, and on tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import collections
import math
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm import common, fmindex, labelled, language, merkle, mixing, neighbours, packing, quality, repeats, simhash, substring, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, part string, rank int"
FOLD = 3


def prose(seed, n=60, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))


def rows():
    shared = prose(99, 70)
    base = {
        1: prose(1), 2: prose(1), 3: "", 4: None, 5: "one", 6: "  \n\t ", 7: prose(7) + "\n" + shared, 8: shared + "\r\n" + prose(8), 9: "a b " * 80, 10: prose(1) + " extra",
        11: prose(11, 30_000, 5000), 12: "é ß ü ÄÖ 日本", 13: "A B\x0bC\x1cD a b", 14: "!!! *** 123",
    }
    out = [(k, v, ["en", "de", None][k % 3], [None, "src1", "src12"][k % 3], None if v is None else len(v), "x", "y", 1) for k, v in base.items()]
    out.append(out[0])  # a repeated row
    out.append((None, prose(5), None, None, None, None, None, None))
    return out


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 15)] + [(1, 0, 1), (500, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def texts():
    return {r[0]: r[1] or "" for r in rows() if r[0] is not None}


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---- op 1 -------------------------------------------------------------------


def test_merkle_against_plain_python(spark, messy, empty):
    got = {r["doc_id"]: r for r in merkle.edited_fingerprints(messy).collect()}
    order = sorted([(r[0], r[1] or "") for r in rows() if r[0] is not None])
    following = {order[i][0]: order[(i + 1) % len(order)][1] for i in range(len(order))}
    for doc, text in order:
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[doc][:cut]
        assert got[doc]["n_chars"] == len(text)
        if doc != 1:  # the repeated row has two results
            assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert got[doc]["edited_fingerprint"] == merkle.as_text(merkle.tree(edited))
        assert got[doc]["fingerprint"] == merkle.as_text(merkle.tree(text))
        assert got[doc]["near_edited"] == pytest.approx(merkle.likeness(got[doc]["fingerprint"], got[doc]["edited_fingerprint"]))
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[10]["fingerprint"]
    assert merkle.edited_fingerprints(empty).count() == 0
    assert merkle.fingerprints(messy).count() == len(rows())


def test_merkle_locates_edits():
    lines = [prose(i, 20) for i in range(60)]
    a = merkle.as_text(merkle.tree("\n".join(lines)))
    lines[30] = "something else here"
    b = merkle.as_text(merkle.tree("\n".join(lines)))
    assert len(merkle.differences(a, b)) == 1 and merkle.differences(a, a) == []
    assert 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1.0


@pytest.mark.parametrize("text", ["", "one", "\n\n", "\n".join(prose(i, 20) for i in range(60)), "a\r\nb \x0b c\n"])
def test_merkle_nodes_are_over_their_children(text):
    root, sections = merkle.tree(text)
    assert merkle.branches(merkle.as_text((root, sections))) == sections
    lines = text.encode().splitlines(keepends=True)
    pieces = [merkle._paragraph(x) for x in lines]
    assert [x[0].hex()[:16] for x in pieces] == [p for _, section in sections for p, _ in section]
    at, tops = 0, []
    for digest, section in sections:
        node = hashlib.sha256(b"".join(x[0] for x in pieces[at : at + len(section)]))
        assert node.hexdigest()[:16] == digest
        tops.append(node.digest())
        at += len(section)
    assert hashlib.sha256(b"".join(tops)).hexdigest() == root


# ---- op 2 -------------------------------------------------------------------


def plain_budgets(tokens, weights, budget, max_epochs):
    """Down the tree: whoever is full first keeps that, its siblings share the rest by weight."""
    out = {}

    def down(node, amount):
        if node in tokens:
            out[node] = int(amount + 1e-6)
            return
        below = sorted({k[: len(node) + 1] for k in tokens if k[: len(node)] == node})
        room = {c: max_epochs * sum(n for k, n in tokens.items() if k[: len(c)] == c) for c in below}
        weight, own, left = {c: weights.get(c, 1.0) for c in below}, dict.fromkeys(below, 0.0), amount
        live = [c for c in below if room[c] > 0]
        while live:
            per = left / sum(weight[c] for c in live)
            full = [c for c in live if per * weight[c] >= room[c]]
            own.update({c: room[c] for c in full} if full else {c: per * weight[c] for c in live})
            left -= sum(room[c] for c in full)
            live = [c for c in live if c not in full] if full else []
        for c in below:
            down(c, own[c])

    if tokens:
        down((), min(budget, max_epochs * sum(tokens.values())))
    return out


def test_budgets_share_shortages_with_siblings_first(spark):
    def spread(tokens, weights, share, epochs):
        leaves = spark.createDataFrame([(*k, n) for k, n in tokens.items()], "domain string, lang string, source string, tokens long")
        return {tuple(r)[:3]: r["quota"] for r in mixing.budgets(leaves, weights, share, epochs).collect()}

    tokens = {("web", "en", "a"): 100, ("web", "en", "b"): 1000, ("web", "de", "c"): 1000, ("books", "en", "d"): 1000}
    got = spread(tokens, {("web",): 3.0}, 1600 / 3100, 1.0)
    # web gets 1200, half of it each for en and de; a takes 100 of its 300 and leaves 200 to b, not to de
    assert got == {("web", "en", "a"): 100, ("web", "en", "b"): 500, ("web", "de", "c"): 600, ("books", "en", "d"): 400}
    assert spread({("x", "p", "1"): 10, ("x", "q", "2"): 50, ("y", "r", "3"): 500}, {}, 300 / 560, 1.0) == {("x", "p", "1"): 10, ("x", "q", "2"): 50, ("y", "r", "3"): 240}
    assert spread({}, {}, 0.5, 1.0) == {}
    rng = np.random.default_rng(5)
    many = {(f"d{a}", f"l{b}", f"s{c}"): int(rng.integers(0, 900)) for a in range(3) for b in range(3) for c in range(7)}
    weights = {("d1",): 4.0, ("d1", "l2"): 0.5, ("d2", "l0", "s3"): 9.0}
    for share, epochs in ((0.3, 1.0), (0.9, 2.0), (3.0, 1.5)):
        assert spread(many, weights, share, epochs) == plain_budgets(many, weights, share * sum(many.values()), epochs)


def test_mix_takes_prefixes_of_seeded_orders(spark, messy, empty):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 40), "en" if i % 3 else "de", "s1" if i % 2 else "s2") for i in range(2000)], "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, {("all", "de"): 4.0}, share=0.6, max_epochs=2.0).collect()
    n = {r["doc_id"]: 5 + r["doc_id"] % 40 for r in docs.collect()}
    leaf_of = lambda i: ("all", "en" if i % 3 else "de", "s1" if i % 2 else "s2")
    own = collections.Counter()
    for i in range(2000):
        own[leaf_of(i)] += n[i]
    quota = plain_budgets(own, {("all", "de"): 4.0}, 0.6 * sum(n.values()), 2.0)
    orders = [
        {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(2), F.lit(e).cast("long")), F.lit(1 << 40)).alias("p")).collect()} for e in range(2)
    ]
    assert sorted(orders[0], key=orders[0].get) != sorted(orders[1], key=orders[1].get)
    expect = set()
    for leaf, q in quota.items():
        left = q
        for epoch, place in enumerate(orders):
            for i in sorted((i for i in range(2000) if leaf_of(i) == leaf), key=place.get):
                left -= n[i]
                if left < 0:
                    break
                expect.add((i, epoch, place[i]))
            if left < 0:
                break
    assert {(r["doc_id"], r["epoch"], r["place"]) for r in got} == expect and len(got) == len(expect)
    assert mixing.mix(empty, {}).count() == 0
    assert mixing.mix(messy, {}, share=1.0, max_epochs=1.0, keep=True).columns == messy.columns


def test_mix_leaves_clashing_columns_alone(spark):
    clash = ["edge", "rest", "whole", "before", "_tokens", "_domain", "cell", "place", "id", "domain", "n_tokens", "row", "tokens", "taken", "within"]
    docs = spark.createDataFrame([(i, prose(i, 30), "en", None if i % 5 else "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    docs = docs.selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in clash))
    kept = mixing.mix(docs, {}, share=0.5, max_epochs=1.0, keep=True)
    plain = mixing.mix(docs.drop(*clash), {}, share=0.5, max_epochs=1.0, keep=True)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in plain.collect()}
    assert all(r[c] == f"{c}{r['doc_id']}" for r in kept.collect() for c in clash)


# ---- op 3 -------------------------------------------------------------------


def plain_fingerprint(text, k=4):
    w = text.encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_against_all_pairs(spark, messy, empty):
    got = simhash.simhash_components(messy).collect()
    fp = {k: plain_fingerprint(t) for k, t in texts().items()}
    ids = sorted(fp)
    comp = union_find([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4], ids)
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fp[r['doc_id']]:016x}" and r["component_id"] == comp[r["doc_id"]]
    assert simhash.simhash_components(empty).count() == 0


def test_hamming_components_in_one_dense_group(spark):
    rng = np.random.default_rng(5)
    center = rng.integers(0, 2**63)
    fps = {int(center)}
    for _ in range(1500):
        x = int(center)
        for b in rng.integers(0, 63, rng.integers(1, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(-(2**63), 2**63, 500)}
    fps = sorted(fps)
    got = {r["fp"]: r["component"] for r in simhash.hamming_components(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    u = np.array(fps, dtype=np.int64).view(np.uint64)
    pairs = np.argwhere(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4, 1))
    comp = union_find([(int(a), int(b)) for a, b in pairs], range(len(fps)))
    want = collections.defaultdict(set)
    have = collections.defaultdict(set)
    for i, x in enumerate(fps):
        want[comp[i]].add(x)
        have[got[x]].add(x)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_similar_groups_find_near_copies_and_leave_others(spark, messy):
    words = [prose(1000 + i, 300, 5000).split() for i in range(120)]
    data = []
    for i, w in enumerate(words):
        data.append((i, " ".join(w)))
        near = list(w)
        for at in (10, 150, 290):
            near[at] = "changed"
        data.append((1000 + i, " ".join(near)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[1000 + i] == i for i in range(120)) >= 114
    assert all(got[i] == i for i in range(120))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(messy).collect()}
    assert got[2] == 1 and got[3] == 3 and got[6] == 6 and got[None] is None


def test_similar_groups_against_all_pairs_at_the_limit(spark):
    """Families of one template at 0.5 to 0.9: the nearest places in an order hold others than the true copies."""
    rng, data = np.random.default_rng(5), []
    for family in range(3):
        base = prose(3000 + family, 150, 4000).split()
        for member in range(110):
            w = list(base)
            for at in rng.choice(150, int(rng.integers(2, 12)), replace=False):
                w[at] = f"own{family}x{member}x{at}"
            data.append((family * 1000 + member, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in data}
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    root = union_find(pairs, ids)
    for small in (32, 1):
        got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string"), small=small).collect()}
        assert got == {i: root[i] for i in ids}


# ---- op 4, 8, 10 ------------------------------------------------------------


def test_letter_evidence_against_plain_kneser_ney(spark):
    """Every letter's evidence against dictionaries of letters, whose probabilities sum to one in each context."""
    rng, size = np.random.default_rng(6), toxicity.ORDER
    rows = [(i, " ".join("".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(12)), int(i % 3 == 0), i % 2) for i in range(40)]
    counts = toxicity.sequence_counts(spark.createDataFrame(rows, "doc_id long, text string, label int, half int"))
    discount, start, end = 0.7, "<", ">"
    seen = {c: collections.Counter() for c in ("t0", "t1", "o0", "o1")}
    for _, text, label, half in rows:
        for w in text.split():
            padded = start * (size - 1) + w + end
            seen[("t" if label else "o") + str(half)].update(padded[i : i + size] for i in range(len(padded) - size + 1))
    every = set().union(*seen.values())
    level = {size: every}
    lower = {}
    for n in range(size - 1, 0, -1):
        lower[n] = collections.Counter(k[-n:] for k in level[n + 1])
        level[n] = set(lower[n])
    letters = sorted(level[1])

    def shared(context, letter, n):
        if n == 1:
            return (lower[1][letter] + 0.5) / sum(c + 0.5 for c in lower[1].values())
        own = {k[-1]: c for k, c in lower[n].items() if k[:-1] == context}
        below = shared(context[1:], letter, n - 1)
        return below if not own else (max(own.get(letter, 0) - discount, 0) + discount * len(own) * below) / sum(own.values())

    def prob(table, context, letter):
        own = {k[-1]: c for k, c in table.items() if k[:-1] == context}
        below = shared(context[1:], letter, size - 1)
        return below if not own else (max(own.get(letter, 0) - discount, 0) + discount * len(own) * below) / sum(own.values())

    toxic, ordinary = seen["t0"] + seen["t1"], seen["o0"] + seen["o1"]
    for context in sorted({k[:-1] for k in every})[:25]:
        for table in (toxic, ordinary):
            assert abs(sum(prob(table, context, x) for x in letters) - 1) < 1e-9
    words = ["abc", "cab", "a", "ccccccb", "bbbba", "xyz"]
    got = toxicity.word_evidence(spark.createDataFrame([(" ".join(words) + " abc",)], "text string"), *toxicity.letter_evidence(counts, discount))
    got = {r["w"]: r["e2"] for r in got.collect()}
    assert len(got) == len(words)
    for w, name in zip(words, toxicity._named(words).tolist(), strict=True):
        padded = start * (size - 1) + w + end
        want = 0.0
        for i in range(len(padded) - size + 1):
            k = padded[i : i + size]
            if not set(k) <= set("abc<>"):  # a letter of neither class: the same backoff in both
                t, o = ([c for x, c in table.items() if x[:-1] == k[:-1]] for table in (toxic, ordinary))
                want += math.log(discount * len(t) / sum(t) if t else 1) - math.log(discount * len(o) / sum(o) if o else 1)
            else:
                want += math.log(prob(toxic, k[:-1], k[-1])) - math.log(prob(ordinary, k[:-1], k[-1]))
        assert got[name] == pytest.approx(want, abs=1e-9), w


def synthetic(spark, n=600):
    out, lab = [], []
    for i in range(n):
        bad, tox = i % 4 == 0, i % 5 < 2
        words = prose(i, 80, 3000).split()
        if tox:
            for at in range(5, 80, 11):
                words[at] = ["vileword", "nastyish", "nastyness"][at % 3]
        text = " ".join(f"{w}***" if bad else w for w in words)
        out.append((i, text))
        lab.append((i, int(not bad), int(tox)))
    return spark.createDataFrame(out, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "column", "folds", "held"), [(quality.quality_scores, "quality", 3, 1), (toxicity.toxicity_scores, "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, messy, empty, labels, operator, column, folds, held):
    docs, lab = synthetic(spark)
    truth = {r["doc_id"]: r[column] for r in lab.collect()}
    got = operator(docs, lab).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in got)
    unseen = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert operator(messy, labels).count() == len(rows())
    assert operator(empty, labels).count() == 0
    none = operator(messy, labels.where("false")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_toxicity_by_joins_gives_the_same_scores(spark, messy, labels):
    docs, lab = synthetic(spark)
    for rows_, own in ((docs, lab), (docs.unionByName(messy.select("doc_id", "text"), allowMissingColumns=True), lab)):
        here, there = (sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.toxicity_scores(rows_, own, few=n).collect()) for n in (2_000_000, 0))
        assert here == there


def test_quality_threshold_against_every_cut():
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    x[:, 0] += 1.5 * y
    model = quality.BradleyTerry(x, y, 5000)
    s = model.binned(x) @ model.w
    right = [int(((s >= cut) == (y == 1)).sum()) for cut in [*np.unique(s), np.inf]]
    assert ((model.score(x) >= 0.5) == (y == 1)).sum() == max(right)
    assert (s < model.threshold).mean() == pytest.approx(model.quantile, abs=0.01)
    # The mean probability that the model gives to preferences is above that of scores turned round.
    margin = s[y == 1][:, None] - s[y == 0][None, :]
    assert (margin > 0).mean() > 0.75


def test_quality_weights_against_all_pairs(spark):
    """The weights are those of every pair of a good and a bad row, and the same where Spark adds up the rows."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 4)), (rng.random(300) < 0.7).astype(int)
    x[:, 0] += 1.5 * y
    x[:, 1] -= 0.7 * y
    model = quality.BradleyTerry(x, y, 5000)
    z = model.binned(x)
    pairs = (z[y == 1][:, None] - z[y == 0][None, :]).reshape(-1, z.shape[1])
    w = labelled.fit_logistic(pairs, np.ones(len(pairs)), 3.0 * len(pairs) / 5000)
    assert np.abs(w).max() > 0.5 and np.abs(model.w - w).max() < 0.002
    rows = spark.createDataFrame([(int(label), bytearray(b.tobytes())) for b, label in zip(model.bins(x), y, strict=True)], "label int, bins binary")
    there = quality.BradleyTerry.of(model.cuts, quality._summed(rows.repartition(5)), 5000)
    assert np.abs(model.w - there.w).max() < 1e-9 and there.threshold == pytest.approx(model.threshold) and there.quantile == model.quantile
    alike = quality.BradleyTerry(np.ones((4, 2)), np.array([1, 1, 0, 1]), 5000)
    assert alike.score(np.ones((2, 2))).tolist() == [0.5, 0.5]


def test_quality_learns_from_all_labelled_rows(spark):
    """What only rows outside of a sample of 20,000 show (a sign that all bad ones have) is learnt as well."""
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    sampled = labelled.at_most(ids.where(labelled.fold(F.col("doc_id"), 3) != 1), 20_000, 8).withColumn("in_sample", F.lit(True))
    rows = ids.join(sampled, "doc_id", "left").withColumn("fold", labelled.fold(F.col("doc_id"), 3))
    kind = F.when(F.col("doc_id") % 5 == 0, "AAAA.").otherwise("aaaa.")
    rows = rows.withColumn("text", F.when(F.col("fold") == 1, F.when(F.col("doc_id") % 2 == 0, "aaaa|").otherwise(kind)).when(F.col("in_sample"), kind).otherwise("aaaa|"))
    labels_ = rows.select("doc_id", (F.col("text") == "aaaa.").cast("int").alias("quality"))
    assert rows.where("text = 'aaaa|' and fold <> 1").count() > 1000
    got = quality.quality_scores(rows.select("doc_id", "text"), labels_).join(labels_, "doc_id")
    assert {(r["quality"], r["predicted"]) for r in got.select("quality", "predicted").distinct().collect()} == {(0, 0), (1, 1)}


def test_labels_by_majority(spark, labels):
    got = {r["doc_id"]: r["label"] for r in labelled.one_label(labels, "quality").collect()}
    assert got[1] == 1 and got[3] == 1 and None not in got


def test_language_within_and_across_families(spark, messy, empty):
    stems = {"en": "the of and this with that are for", "de": "der die und nicht mit ein auf für", "fr": "le les des une dans pour qui avec", "es": "el los del una en para que con"}
    data = []
    for i in range(800):
        lang = list(stems)[i % 4]
        rng = np.random.default_rng(i)
        data.append((i, " ".join(rng.choice(stems[lang].split(), 12)), lang if i % 50 else None))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.languages(docs).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert np.mean([got[i]["lang_pred"] == list(stems)[i % 4] for i in held]) >= 0.97
    out = {r["doc_id"]: r for r in language.languages(messy).collect()}
    assert {k for k in out if out[k]["lang_pred"] == "und"} == {3, 4, 6, 14} and out[4]["score"] == 0
    assert language.languages(empty).count() == 0
    assert {r["lang_pred"] for r in language.languages(messy.withColumn("lang", F.lit(None))).collect()} == {"und"}


def plain_profile(text):
    """N-grams one by one, with Python integers."""
    word, counts = 2**32 - 1, collections.Counter()
    codes = [0, *(ord(c) if c.isalpha() else 0 for c in (text or "").lower()), 0]
    grams = [c * 0x9E3779B1 for c in codes[1:-1] if c]
    pair = lambda a, b: (a * 0x85EBCA77 & word) ^ (b * 0xC2B2AE3D & word)
    grams += [pair(a, b) for a, b in zip(codes, codes[1:], strict=False) if a or b]
    grams += [pair(a, b) ^ ((c * 0x27D4EB2F & word) + 0x165667B1 & word) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False) if b]
    for g in grams:
        g &= word
        counts[((g ^ (g >> 15)) * 0x2C1B3C6D & word) >> 20] += 1
    if not any(c.isalpha() for c in text or ""):
        return {}
    return {k: math.sqrt(n / sum(counts.values())) for k, n in counts.items()}


def test_languages_against_plain_python():
    """Profiles, the choice of a family and the votes within it, from the fitted weights alone."""
    stems = {"en": "the of and this with", "de": "der die und nicht mit", "nl": "het een van niet met", "fr": "le les des une dans", "es": "el los del una en", "xx": "zq qz zzq qqz"}
    data = [(k, " ".join(np.random.default_rng(i).choice(stems[k].split(), 9))) for i in range(40) for k in stems]
    model = language.Languages(language.profiles([t for _, t in data]), [k for k, _ in data])
    asked = [t for _, t in data[::7]] + ["", None, "123 !", "Ünd der 日本", "the der le el zq", "a" * 50, "Straße 𝒜𝒷"]
    names, score = model.predict(language.profiles(asked))
    sure = lambda m: 1 / (1 + math.exp(-min(30, max(-30, 3 * m))))
    for text, name, found in zip(asked, names, score, strict=True):
        x = plain_profile(text)
        value = lambda w: sum(w[k] * v for k, v in x.items()) + w[-1]  # noqa: B023,E731
        assert np.allclose(language.profiles([text])[0], [x.get(k, 0) for k in range(language.DIMS)], atol=1e-6)
        if not x:
            continue
        chance = {f: sure(value(w)) for f, w in zip(model.families, model.first, strict=True)}
        family = max(model.families, key=lambda f: chance[f])  # noqa: B023
        own = [k for k in model.langs if model.family[k] == family]
        won = {k: math.prod(sure(value(w)) if a == k else 1 - sure(value(w)) for (a, b), w in model.pairs.items() if k in (a, b)) for k in own}
        best = max(own, key=lambda k: won[k])  # noqa: B023
        assert name == best
        assert found == pytest.approx(chance[family] / sum(chance.values()) * won[best] / sum(won.values()), rel=1e-3)


# ---- op 5 -------------------------------------------------------------------


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 16))
    vectors = [*base, *(base[:60] + 0.05 * rng.standard_normal((60, 16))), *base[:5], *(base[7] + 0.02 * rng.standard_normal((300, 16)))]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9001, [0.0] * 16), (9002, [1.0, None] + [0.0] * 14), (9003, [float("nan")] * 16), (9004, [1.0, 2.0]), (9005, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {r["vec_id"]: r for r in neighbours.embedding_components(df, leaf=60, tile=50).collect()}
    u = np.stack([v / np.linalg.norm(v) for v in vectors])
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    n = near.sum(axis=1)
    have = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (have <= n).all() and have.sum() >= 0.97 * n.sum()
    if have.sum() == n.sum():
        comp = union_find([(int(a), int(b)) for a, b in np.argwhere(near)], range(len(vectors)))
        assert all(got[i]["component_id"] == comp[i] for i in comp)
    for k, _ in odd[:6]:
        assert got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"]
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert neighbours.embedding_components(df.where("false")).count() == 0


def test_cosines_of_very_small_and_large_components(spark):
    data = [(1, [1e-200, 1e-200]), (2, [0.1, 1.0]), (3, [1e200, 1e200]), (4, [2e200, 2e200]), (5, [5e-324, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.embedding_components(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (0, 2), 3: (2, 1), 4: (2, 1), 5: (0, 5)}


# ---- op 6 and 7 -------------------------------------------------------------


def plain_removed(docs, window):
    seen, out = set(), {}
    for doc in sorted(docs):
        w = docs[doc].encode().split()
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            gone[i : i + window] |= key in seen
            seen.add(key)
        out[doc] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substrings_against_a_dictionary_of_windows(spark, messy, empty):
    want = plain_removed(texts(), 20)
    got = substring.dedup_substrings(messy).collect()
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    rng = np.random.default_rng(8)
    docs = {i: " ".join(rng.choice(["x", "y", "z"], rng.integers(0, 120))) for i in range(80)}
    small = substring.dedup_substrings(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), window=8)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in small.collect()} == plain_removed(docs, 8)
    cut = substring.removed_windows(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), window=8, most=3)
    whole = substring.removed_windows(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), window=8)
    spread = lambda df: {(r["doc_id"], x["start"] + i) for r in df.collect() for x in r["runs"] for i in range(x["n"])}
    assert spread(cut) == spread(whole) != set()
    assert substring.dedup_substrings(empty).count() == 0
    left = {r["doc_id"]: r["text"] for r in substring.dedup_substrings(messy, texts=True).collect()}
    assert left[6] == "  \n\t " and left[2] == ""


def test_matching_statistics_against_search():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sigma, depth = int(rng.integers(2, 6)), int(rng.integers(2, 9))
        own = [rng.integers(1, sigma + 1, rng.integers(1, 60)) for _ in range(4)]
        asked = [np.where((q := rng.integers(0, sigma + 1, rng.integers(1, 40))) == 0, -1, q) for _ in range(3)]
        index = fmindex.FMIndex(own, sigma + 1, depth)
        length, found = index.matching_statistics(asked)
        at = 0
        for q in asked:
            for i in range(len(q)):
                hits = lambda n, q=q, i=i: [s + x for s, t in zip(index.starts, own, strict=True) for x in range(len(t) - n + 1) if (t[x : x + n] == q[i : i + n]).all()]
                best = 0
                while best < min(depth, len(q) - i) and hits(best + 1):
                    best += 1
                assert length[at] == best and found[at] == (min(hits(best)) if best == depth else -1)
                at += 1


def test_the_index_decides_what_is_removed(monkeypatch):
    rows = [(1, 0, b"a b c d e f"), (2, 5, b"x b c d e"), (3, 0, b"b c d e q")]
    got = substring.search_shard(rows, 4)
    assert got == [[(0, 3, 1, 0)], [(0, 1, 2, 5), (1, 1, 1, 1)], [(0, 1, 1, 1), (1, 1, 3, 1)]]
    monkeypatch.setattr(fmindex.FMIndex, "step", lambda self, symbol, low, high: (low, low))
    assert substring.search_shard(rows, 4) == [[], [], []]


def test_minimisers_in_blocks():
    h = np.random.default_rng(4).integers(0, 9, 5000).astype(np.uint64)
    first = np.array([0, 1200, 1210, 5000])
    whole, cut = repeats.minimisers(h, first, 20), repeats.minimisers(h, first, 20, block=100)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_filter_misses_nothing_and_can_be_left_out(spark):
    h = np.random.default_rng(2).integers(-(2**63), 2**63, 5000)
    f = repeats.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert f.has(h.view(np.uint64)).all()
    other = np.random.default_rng(3).integers(-(2**63), 2**63, 5000).view(np.uint64)
    assert f.has(other).mean() < 0.2
    everything = repeats.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"), most_bits=64)
    assert everything.bits is None and everything.has(other).all()


def plain_repeated(docs, least):
    where = collections.defaultdict(list)
    words = {k: v.encode().split() for k, v in docs.items()}
    for k, w in words.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].append((k, i))
    want = {k: np.zeros(len(w), dtype=bool) for k, w in words.items()}
    for at in where.values():
        for k, i in at if len(at) > 1 else []:
            want[k][i : i + least] = True
    return want


def covered(row):
    have = np.zeros(row["n_words"], dtype=bool)
    for p in row["passages"]:
        have[p["start"] : p["end"]] = True
    assert row["n_repeated"] == have.sum()
    return have.tolist()


def test_passages_against_all_windows(spark, messy, empty):
    want = plain_repeated(texts(), 50)
    for r in suffixes.repeated_passages(messy).collect():
        if r["doc_id"] is not None:
            assert covered(r) == want[r["doc_id"]].tolist(), r["doc_id"]
    assert suffixes.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("group_rows", [suffixes.GROUP_ROWS, 5])
def test_passages_between_frequent_neighbours(spark, group_rows):
    """Few texts share head, body and tail together; many share the body and one of the two, which alone is too short."""
    body, heads, tails = prose(500, 40), [prose(600 + i, 6) for i in range(9)], [prose(700 + i, 6) for i in range(9)]
    rng = np.random.default_rng(4)
    pairs = [(i, j) for i in range(9) for j in range(9)] + [(int(i), int(j)) for i, j in rng.integers(0, 9, (12, 2))]
    docs = {n: " ".join([prose(800 + n, 30), heads[i], body, tails[j], prose(900 + n, 30)]) for n, (i, j) in enumerate(pairs)}
    want = plain_repeated(docs, 50)
    assert 12 < sum(x.any() for x in want.values()) < 40
    got = suffixes.repeated_passages(spark.createDataFrame([*docs.items(), (0, docs[0])], "doc_id long, text string"), group_rows=group_rows)
    assert {r["doc_id"]: covered(r) for r in got.collect()} == {k: v.tolist() for k, v in want.items()}
    # Very repetitive texts: windows that overlap themselves.
    small = {i: " ".join(rng.choice(["x", "y"], rng.integers(0, 90))) for i in range(60)}
    got = suffixes.repeated_passages(spark.createDataFrame(list(small.items()), "doc_id long, text string"), least=12, key=6, group_rows=group_rows)
    assert {r["doc_id"]: covered(r) for r in got.collect()} == {k: v.tolist() for k, v in plain_repeated(small, 12).items()}


# ---- op 9 -------------------------------------------------------------------


def test_packing_places_every_token(spark, messy, empty):
    got = packing.pack(messy).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc, text in texts().items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        own = got[got["doc_id"] == doc].drop_duplicates("piece").sort_values("piece")
        assert own["length"].sum() == len(ids) and own["length"].max() <= 1024 and (own["length"].iloc[1:] == 1024).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id")["length"].cumsum() - placed["length"] == placed["offset"]).all()
    assert placed.groupby("sequence_id")["length"].sum().max() <= 1024
    assert packing.pack(empty).count() == 0


def test_histogram_plan_is_whole_and_tight():
    rng = np.random.default_rng(4)
    h = np.bincount(np.minimum(1024, rng.gamma(2.0, 150.0, 20_000).astype(int) + 1), minlength=1025)
    used = np.zeros(1025, dtype=int)
    plan = packing.pack_histogram(h)
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for x in lengths:
            used[x] += times
    assert (used == h).all()
    assert sum(t for _, t in plan) <= 1.01 * np.ceil((h * np.arange(1025)).sum() / 1024)


def test_ranks_give_the_tokenizer_ids():
    known = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json"), None)
    for text in ["a\x1c b\x1f\x85c d    e\n\n f'll 12x²½", "<|endoftext|> hi", "日本語 １２３ ⅷ", "​ x﻿", "don't I'LL '  '", "\U0001f600 \U0001f468‍", " ", "x" * 5000, prose(3)]:
        assert known.encode(text).tolist() == plain.encode(text).tolist()


# ---- shared -----------------------------------------------------------------


def test_components_of_paths_stars_and_cliques(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(a, b) for a in range(2000, 2020) for b in range(2000, a)] + [(5000, 5000), (None, 3)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[i] for i in range(1000, 1400)} == {1000} and {got[i] for i in range(2000, 2020)} == {2000} and got[5000] == 5000
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_and_their_hashes():
    buf, start, end, h, first = common.words_of([b"a b\n a", b"", b"\x0b\x1c b"])
    words = [bytes(buf[s:e]) for s, e in zip(start, end, strict=True)]
    assert words == [b"a", b"b", b"a", b"\x1c", b"b"] and first.tolist() == [0, 3, 3, 5]
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert common.run_hashes(h, 2)[0] != common.run_hashes(h, 2)[1]


# ---- ids --------------------------------------------------------------------

LARGE = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), None]


@pytest.fixture(scope="module")
def large(spark):
    """Ids that a float cannot hold, beside a null one; the first two texts are equal."""
    texts = [prose(1), prose(1), prose(2), prose(3), prose(4)]
    out = [(i, t, "en", "src1", len(t), "x", "y", 1) for i, t in zip(LARGE, texts, strict=True)]
    return spark.createDataFrame(out, SCHEMA).coalesce(1).cache()


def test_ids_stay_whole_beside_null(large, labels):
    order = lambda ids: sorted(ids, key=repr)
    ids = lambda df: order(r["doc_id"] for r in df.select("doc_id").collect())
    scored = [toxicity.toxicity_scores(large, labels), quality.quality_scores(large, labels), language.languages(large, sample=2)]
    taught = labels.sparkSession.createDataFrame([(i, n % 2, n % 2) for n, i in enumerate(LARGE)], "doc_id long, quality int, toxic int")
    scored += [toxicity.toxicity_scores(large, taught), quality.quality_scores(large, taught)]
    assert ids(merkle.edited_fingerprints(large)) == order(LARGE[:-1])  # a row without an id has no next one
    for df in [merkle.fingerprints(large), packing.pack(large), *scored]:
        assert ids(df) == order(LARGE)
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(large).collect()}
    assert groups == dict(zip(LARGE, [LARGE[0], LARGE[0], *LARGE[2:]], strict=True))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(large).collect()} == groups
    left = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substring.dedup_substrings(large, window=20, texts=True, carry=("lang", "n_chars")).collect()}
    given = {r["doc_id"]: r["text"] for r in large.collect()}
    assert left == {i: (60, "") if i == LARGE[1] else (0, given[i]) for i in LARGE}
    assert ids(suffixes.repeated_passages(large, least=50)) == order(LARGE)
