"""Toxicity: class-conditional Kneser-Ney models of letters within words.

Two interpolated Kneser-Ney models, one for toxic and one for ordinary documents, predict each letter of a
word (and its end) from the ORDER - 1 before it. They differ in what was counted at full order; below that
both back off to the same counts, in how many different contexts a sequence occurs in either class, so rare
expressions are judged by their parts. A letter's evidence is its toxic less its ordinary log-likelihood. A
document is scored by its evidence normalised by length (by letter, and that of its telling words by word);
a logistic curve with these, the number of words and an offset is fitted on rows that the model they are
scored by had not learnt from.

Counts cover every labelled row outside of the held-out fold and stay in Spark, however many sequences there
are. The tables made from them are sent to the tasks if they are few (a checked bound), else the evidence
of each different word of the documents is found by joins. Words are letters only,
so an expression of several words counts by its words. Null, empty and letterless texts have no evidence
either way and get the score of that. Rows with a null id are scored and never learnt from; rows that repeat
an id are scored each. Without labels of both classes every score is 0.5. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.llm.common import documents_of, map_frames, materialize
from memloom.llm.labelled import at_most, fit_logistic, fold, one_label, with_labels

ORDER = 5
BITS = 10
#: A word tells something from the first evidence on, and never more than the second.
TELLING = (2.5, 6.0)
#: Factors that bring the columns of x to like sizes for the fit.
SCALE = (10.0, 0.2, 10.0, 1.0)
WORDS = re.compile(r"[^\W\d_]+")


def letter_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each letter of each word (and its end) with the letters before it, packed in ORDER times BITS bits; and its word's number.

    Code 1 pads before a word, 2 ends it; letters are code points modulo the rest, so that only rare scripts' letters coincide.
    """
    codes = np.frombuffer("".join(f"{w}\0" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    ends = codes == 0
    number = np.cumsum(ends) - ends
    codes = np.where(ends, 2, 3 + codes % ((1 << BITS) - 3))
    first = np.searchsorted(number, np.arange(len(words)))
    depth = np.arange(len(codes)) - first[number]
    runs = codes.copy()
    for back in range(1, ORDER):
        before = np.ones_like(codes)
        before[back:] = codes[:-back]
        runs |= np.where(depth >= back, before, 1) << np.int64(BITS * back)
    return runs, number


def word_counts(text: str | None) -> Counter:
    return Counter(WORDS.findall(text.lower())) if text else Counter()


def sequence_counts(rows: DataFrame) -> DataFrame:
    """(run, t0, t1, o0, o1): how often each sequence of letters occurs in toxic and ordinary rows of either half."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kinds = {}
            for text, label, half in zip(part["text"], part["label"], part["half"], strict=True):
                kinds.setdefault((1 - label) * 2 + half, Counter()).update(word_counts(text))
            words = list(set().union(*kinds.values())) if kinds else []
            if not words:
                continue
            runs, number = letter_runs(words)
            keys, at = np.unique(runs, return_inverse=True)
            out = {"run": keys}
            for k, name in enumerate(("t0", "t1", "o0", "o1")):
                had = kinds.get(k, Counter())
                out[name] = np.bincount(at, weights=np.array([had[w] for w in words], dtype=np.float64)[number], minlength=len(keys)).astype(np.int64)
            yield pd.DataFrame(out)

    counted = rows.mapInPandas(run, "run long, t0 long, t1 long, o0 long, o1 long")
    return counted.groupBy("run").agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "o0", "o1")))


def _shorter(run: str, n: int) -> Column:
    """The last n letters of a packed sequence."""
    return F.col(run).bitwiseAND(F.lit((1 << BITS * n) - 1))


def backoff(runs: DataFrame, discount: float) -> DataFrame:
    """(key, p): the shared probability of the last letter of each sequence of ORDER - 1 letters in runs.run, given those before."""
    keys = {ORDER: runs.select(F.col("run").alias("key"))}
    for n in range(ORDER - 1, 0, -1):  # a sequence counts as often as it has different letters before it
        keys[n] = materialize(keys[n + 1].groupBy(_shorter("key", n).alias("key")).agg(F.count("*").alias("c")))
    total = keys[1].agg(F.coalesce(F.sum(F.col("c") + 0.5), F.lit(1.0))).first()[0]
    p = keys[1].select("key", ((F.col("c") + 0.5) / total).alias("p"))
    for n in range(2, ORDER):
        alike = Window.partitionBy(F.shiftright("key", BITS))
        own = keys[n].select("key", "c", F.sum("c").over(alike).alias("mass"), F.count("*").over(alike).alias("kinds"), _shorter("key", n - 1).alias("low"))
        lower = p.select(F.col("key").alias("low"), F.col("p").alias("below"))
        p = materialize(own.join(lower, "low").select("key", ((F.greatest(F.col("c") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("below")) / F.col("mass")).alias("p")))
    return p


def letter_evidence(counts: DataFrame, discount: float) -> tuple[DataFrame, DataFrame]:
    """((run, e0, e1, e2), (context, f0, f1, f2)): evidence of sequences that were seen, and of unseen letters after seen contexts.

    By the model of the first half of the rows, of the second, and of all. A context that a class has not
    seen gives its letters the shared probability, as an unseen letter has in both: elsewhere there is no evidence.
    """
    low = backoff(counts, discount).select(F.col("key").alias("low"), "p")
    own = counts.withColumns({"t2": F.expr("t0 + t1"), "o2": F.expr("o0 + o1"), "low": _shorter("run", ORDER - 1), "context": F.shiftright("run", BITS)})
    names = [f"{c}{m}" for c in "to" for m in range(3)]
    sums = own.groupBy("context").agg(*(F.sum(x).alias(f"mass_{x}") for x in names), *(F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for x in names))
    sums = materialize(sums)
    mass, rest = lambda x: F.col(f"mass_{x}"), lambda x: F.when(F.col(f"mass_{x}") > 0, discount * F.col(f"kinds_{x}") / F.col(f"mass_{x}")).otherwise(1.0)
    prob = lambda x: F.when(mass(x) > 0, F.greatest(F.col(x) - discount, F.lit(0.0)) / mass(x)).otherwise(0.0) + rest(x) * F.col("p")
    seen = own.join(sums, "context").join(low, "low")
    ratios = seen.select("run", *((F.log(prob(f"t{m}")) - F.log(prob(f"o{m}"))).alias(f"e{m}") for m in range(3)))
    after = sums.select("context", *((F.log(rest(f"t{m}")) - F.log(rest(f"o{m}"))).alias(f"f{m}") for m in range(3)))
    return materialize(ratios), materialize(after)


def _named(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), 4) for w in words], dtype=np.uint64).view(np.int64)


def word_evidence(texts: DataFrame, ratios: DataFrame, after: DataFrame) -> DataFrame:
    """(w, e0, e1, e2): the evidence of each different word of the texts; w is its hash."""

    def distinct(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            words = list(set().union(*(WORDS.findall(t.lower()) for t in part["text"] if t)))
            yield pd.DataFrame({"w": _named(words), "word": words})

    def letters(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                runs, number = letter_runs(list(part["word"]))
                yield pd.DataFrame({"w": part["w"].to_numpy()[number], "run": runs})

    words = texts.select("text").mapInPandas(distinct, "w long, word string").dropDuplicates(["w"])
    each = words.mapInPandas(letters, "w long, run long").withColumn("context", F.shiftright("run", BITS))
    met = each.join(ratios, "run", "left").join(after, "context", "left")
    return materialize(met.groupBy("w").agg(*(F.sum(F.coalesce(f"e{m}", f"f{m}", F.lit(0.0))).alias(f"e{m}") for m in range(3))))


class Letters:
    """Evidence of letters by one model, from the tables of letter_evidence."""

    def __init__(self, ratios: DataFrame, after: DataFrame, model: int) -> None:
        self.tables = []
        for df, key, value in ((ratios, "run", f"e{model}"), (after, "context", f"f{model}")):
            t = df.select(key, value).toArrow()
            k, v = t[key].to_numpy(), t[value].to_numpy()
            order = np.argsort(k)
            self.tables.append((k[order], v[order]))

    def of_words(self, words: list[str]) -> np.ndarray:
        runs, number = letter_runs(words)
        out, open_ = np.zeros(len(runs)), np.arange(len(runs))
        for (keys, values), shift in zip(self.tables, (0, BITS), strict=True):
            if len(keys):
                asked = runs[open_] >> np.int64(shift)
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[at] == asked
                out[open_[hit]] = values[at[hit]]
                open_ = open_[~hit]
        return np.bincount(number, weights=out, minlength=len(words))


def _words_of(texts: pd.Series, step: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """For some texts at a time: where they are, and by text and different word how often: (start, end, text, word's number, words, times)."""
    for start in range(0, len(texts), step):
        found = [WORDS.findall(t.lower()) if t else [] for t in texts.iloc[start : start + step]]
        code, different = pd.factorize(np.array([w for f in found for w in f] + [""], dtype=object))  # "" keeps the array from being empty
        doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
        pair, n = np.unique(doc * len(different) + code[:-1], return_counts=True)
        doc, code = np.divmod(pair, len(different))
        yield start, start + len(found), doc, code, list(different), n


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")


def described_in_place(rows: DataFrame, letters: list[Letters], model: str) -> DataFrame:
    """As described, with the tables at hand in every task; rows.model says by which of them a row is judged."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.zeros((len(part), len(SCALE)))
            which = part[model].to_numpy()
            for start, end, doc, code, words, n in _words_of(part["text"]):
                size = np.array([len(w) for w in words], dtype=np.int64) + 1
                add = lambda v, doc=doc, k=end - start: np.bincount(doc, weights=v, minlength=k)
                for m, own in enumerate(letters):
                    if not (which[start:end] == m).any():
                        continue
                    e = own.of_words(words)[code]
                    telling, count = add(n * np.clip(e - TELLING[0], 0, TELLING[1] - TELLING[0])), add(n)
                    some = np.maximum(count, 1)
                    rows_ = np.column_stack([add(n * e) / np.maximum(add(n * size[code]), 1), np.log(some), telling / some, np.log1p(telling)])
                    x[start:end] = np.where((which[start:end] == m)[:, None], rows_, x[start:end])
            yield part.drop(columns="text").assign(x=list(x))

    return map_frames(rows, run, f"{_schema(rows)}, x array<double>")


def described(rows: DataFrame, evidence: DataFrame, model: str) -> DataFrame:
    """rows without text, with x: evidence by letter, log number of words, telling evidence by word, and log of its sum.

    By joins on words, for tables of any size; rows.model says which of e0, e1 and e2 judges a row.
    """
    kept = [c for c in rows.columns if c != "text"]

    def words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for start, end, doc, code, different, n in _words_of(part["text"]):
                none = np.setdiff1d(np.arange(end - start), doc)  # these need a row as well
                size, names, zero = np.array([len(w) for w in different], dtype=np.int64), _named(different), np.zeros(len(none), np.int64)
                out = part[[*kept, "row"]].iloc[np.concatenate([doc, none]) + start].reset_index(drop=True)
                yield out.assign(w=np.concatenate([names[code], zero]), n=np.concatenate([n, zero]), letters=np.concatenate([size[code] + 1, zero]))

    each = map_frames(rows.withColumn("row", F.monotonically_increasing_id()), words, f"{_schema(rows)}, row long, w long, n long, letters long")
    met = each.join(evidence, "w", "left")
    e = F.coalesce(F.when(F.col(model) == 0, F.col("e0")).when(F.col(model) == 1, F.col("e1")).otherwise(F.col("e2")), F.lit(0.0))
    telling = F.greatest(F.least(e, F.lit(TELLING[1])) - TELLING[0], F.lit(0.0))
    sums = met.groupBy(*kept, "row").agg(
        F.sum(F.col("n") * e).alias("all"), F.sum(F.col("n") * F.col("letters")).alias("size"), F.sum("n").alias("words"), F.sum(F.col("n") * telling).alias("telling")
    )
    some = F.greatest(F.col("words"), F.lit(1))
    x = F.array(F.col("all") / F.greatest(F.col("size"), F.lit(1)), F.log(some.cast("double")), F.col("telling") / some, F.log1p("telling"))
    return sums.select(*kept, x.alias("x"))


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, sample: int = 20_000, few: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted). The curve is fitted on about `sample` labelled rows.

    few: tables of up to so many sequences (32 bytes each) are sent to the tasks; larger ones are joined with
    the different words of the texts, to the same scores.
    """
    texts = documents_of(docs, id_col, text_col)
    taught = with_labels(texts.where(fold(F.col("doc_id"), folds) != held_out), one_label(labels, "toxic", id_col))
    taught = taught.select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(2)).cast("int").alias("half"))
    counts = materialize(sequence_counts(taught))
    total = F.expr("t0 + t1 + o0 + o1")
    facts = counts.agg(F.count_if(total == 1).alias("once"), F.count_if(total == 2).alias("twice"), *(F.sum(c).alias(c) for c in ("t0", "t1", "o0", "o1"))).first()
    scored = texts.select("doc_id", F.lit(0.5).alias("score"))
    if all(facts[c] for c in ("t0", "t1", "o0", "o1")):
        discount = min(0.95, max(0.3, facts["once"] / max(1, facts["once"] + 2 * facts["twice"])))
        ratios, after = letter_evidence(counts, discount)
        if ratios.count() + after.count() <= few:
            letters = [Letters(ratios, after, m) for m in range(3)]
            describe = lambda rows: described_in_place(rows, letters, "model")
        else:
            evidence = word_evidence(texts, ratios, after)
            describe = lambda rows: described(rows, evidence, "model")
        fit = describe(at_most(taught, sample, 44).select("doc_id", "text", "label", (1 - F.col("half")).alias("model"))).collect()
        fit = sorted((r["doc_id"], r["label"], r["x"]) for r in fit)
        x = np.column_stack([np.ones(len(fit)), np.array([r[2] for r in fit]) * SCALE])
        curve = fit_logistic(x, np.array([r[1] for r in fit], dtype=np.float64), 1.0)
        z = F.lit(float(curve[0]))
        for i, (w, k) in enumerate(zip(curve[1:], SCALE, strict=True)):
            z = z + F.col("x")[i] * float(w * k)
        scored = describe(texts.withColumn("model", F.lit(2))).select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
