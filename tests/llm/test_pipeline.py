"""The stages of the pipeline on a small corpus, each against what its decisions should be."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from memloom.llm.mixing import word_count
from memloom.llm.repeats import Filter
from memloom.llm.substring import minimiser_counts, stretches, window_counts

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, DATA))
        out.append((docs, after))
        docs = after
    return out


def test_stages_keep_the_columns_and_narrow_the_rows(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "mixing sources", "best-fit packing"]
    for before, after in stages[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}


def test_one_of_equal_texts_stays(stages):
    before, after = stages[1]
    kept = [r["text"] for r in after.select("text").collect()]
    assert len(kept) == len(set(kept))
    first = {}
    for r in before.collect():
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert gone.isdisjoint({i for t, i in first.items() if t and len(t.split()) > 400 and len([x for x in first if x[:80] == t[:80]]) == 1})


def test_no_long_window_is_left_twice(stages):
    _, after = stages[2]
    seen = set()
    for r in sorted(after.collect(), key=lambda r: r["doc_id"]):
        assert r["n_chars"] == len(r["text"])
        w = r["text"].split()
        for i in range(0, len(w) - 50):
            key = tuple(w[i : i + 50])
            assert key not in seen
        seen |= {tuple(w[i : i + 50]) for i in range(len(w) - 50)}


def test_the_mixture_meets_its_budget(stages):
    before, after = stages[3]
    total = lambda df: df.select(word_count(df["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert 0.6 * total(before) <= total(after) <= 0.8 * total(before) + 1


def test_sequences_hold_all_pieces(stages):
    before, after = stages[4]
    p = after.toPandas().sort_values(["sequence_id", "offset"])
    assert set(p["doc_id"]) == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert (p.groupby("sequence_id")["length"].cumsum() - p["length"] == p["offset"]).all()
    assert p["sequence_id"].nunique() <= np.ceil(1.1 * p["length"].sum() / 1024) + 1


LARGE = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63)]


def messy_rows():
    """Null and empty texts, ids beside null that a float cannot hold, equal and nearly equal texts, repeated rows, a long text."""
    prose = lambda seed, n: " ".join(f"w{int(x)}" for x in np.random.default_rng(seed).integers(0, 3000, n))
    texts = [(LARGE[0], prose(1, 90)), (LARGE[1], prose(1, 90)), (LARGE[2], prose(2, 80)), (LARGE[3], prose(3, 80)), (None, prose(4, 60)), (None, None), (1, ""), (2, None), (3, "  \n"), (4, prose(5, 20_000))]
    texts += [(5, prose(6, 70)), (5, prose(6, 70)), (6, prose(6, 70) + " more"), (7, prose(8, 40) + " " + prose(2, 80)[:300])]
    return [(i, t, ["en", None, "de"][n % 3], [None, "src1", "src12"][n % 3], None if t is None else len(t), "x", 1, "y") for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (5, 1, 0), (LARGE[0], 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank string, number int, label string"
    return spark.createDataFrame(messy_rows(), schema).coalesce(2).cache(), str(folder)


def counted(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("number", range(4))
def test_stages_on_messy_rows(spark, messy, number):
    docs, folder = messy
    name, stage = corpus_pipeline.STAGES[number]
    after = corpus_pipeline.materialize(stage(spark, docs, folder))
    assert after.columns == corpus_pipeline.COLUMNS
    before, kept = counted(docs), counted(after)
    ids = [r[0] for r in kept]
    if name == "quality classifier":
        assert all(r in before for r in kept) and ids.count(None) == 2
    elif name == "SimHash near-dedup":
        gone = {LARGE[1], 6}  # an equal text, and one of similarity above 0.8
        assert kept == sorted((r for r in before if r[0] not in gone), key=repr)
    elif name == "substring dedup":
        left = {(r[0], r[1]) for r in kept}
        given = {(r[0], r[1]) for r in before}
        stay = {LARGE[0], LARGE[3], 4, 7}
        assert LARGE[1] not in ids and {x for x in given if x[0] in stay} <= left  # the later of equal texts is all gone; others stand under their own ids
        short = dict(x for x in left if x[0] == LARGE[2])  # its beginning is in text 7, whose id is smaller
        assert dict(given)[LARGE[2]].endswith(short[LARGE[2]]) and len(short[LARGE[2]]) < 200
        assert {r["n_chars"] for r in after.where("doc_id = 4").collect()} == {len(dict(given)[4])}
    else:
        assert all(kept.count(r) <= before.count(r) for r in kept) and ids.count(5) in (0, 2)
    assert corpus_pipeline.materialize(stage(spark, docs.limit(0), folder)).count() == 0


def test_packing_on_messy_rows(spark, messy):
    docs, folder = messy
    whole = sorted((r[0] for r in messy_rows()), key=repr)
    exact = [r["doc_id"] for r in corpus_pipeline.packing(spark, docs, folder).where("piece = 0").collect()]
    assert sorted(exact, key=repr) == whole
    assert corpus_pipeline.packing(spark, docs.limit(0), folder).count() == 0


class Given:
    """Batches in place of a frame: mapInPandas runs over them here and now."""

    def __init__(self, parts):
        self.parts = parts

    def select(self, *columns):
        return Given([p[list(columns)] for p in self.parts])

    def mapInPandas(self, run, schema):
        return list(run(iter(self.parts)))


def test_repeated_passages_hands_over_small_frames():
    """An executor holds a whole frame from Python outside of its heap, so frames must not grow with the batch, nor lose or part what is in it."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 200)) for _ in range(3000)]
    texts[2000:2100] = texts[:100]
    part = pd.DataFrame({"doc_id": np.arange(len(texts)), "text": texts})
    whole, halves = Given([part]), Given([part[:1500], part[1500:]])
    everything = Filter(None)
    for counted in (minimiser_counts, lambda t, w: window_counts(t, w, everything)):
        a, b = counted(whole, 20), counted(halves, 20)
        assert max(map(len, a)) <= 1 << 16
        sums = [pd.concat(x).groupby("h")["n"].sum() for x in (a, b)]
        assert sums[0].equals(sums[1]) and sums[0].max() == 2
    assert sums[0].sum() == len(texts) * 181
    a, b = stretches(whole, 20, everything), stretches(halves, 20, everything)
    assert max(map(len, a)) <= 1 << 13
    members = [sorted((s, w, m) for f in x for s, w, ms in zip(f["shard"], f["words"], f["members"], strict=True) for m in ms) for x in (a, b)]
    assert members[0] == members[1] and len({m for _, _, m in members[0]}) == len(members[0])


def test_written_frames_take_small_batches(spark):
    sizes = spark.range(0, 1000, 1, 1).mapInPandas(lambda parts: (p.assign(n=len(p)) for p in parts), "id long, n int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    written = corpus_pipeline.materialize(sizes, 64)
    assert written.count() == 1000 and written.groupBy().max("n").first()[0] == 64
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
