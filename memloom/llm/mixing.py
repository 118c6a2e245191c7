"""Mixing sources to target weights by hierarchical budgets.

Weights go down a tree (domain, language, source). A node's budget is shared among its children by weight;
a child that has too few tokens, even when read `max_epochs` times, keeps what it has and its shortage goes
to its siblings first, and only what they cannot take to those of its ancestors. Each leaf then takes whole
epochs and a prefix of one more, each epoch in an order of its own, by a hash of seed, epoch and id.

Tokens are words. Null labels are the leaf `unknown`; a null or empty text has no tokens and comes with
each whole epoch, and in a prefix whose place covers it. Rows that repeat an id within a leaf share a place
and come together or not at all. A row without an id has a place like others, but is left out of the last
cell of a prefix (below), as nothing names it. An empty table gives an empty result; whatever other columns
the input has, their names and values are left alone.

The tree is a DataFrame: levels are shared out by windows over siblings, so leaves may be many (a source may
be a host). No leaf is sorted whole: sums over CELLS ranges of its order find the one range in which the
prefix ends, and only that one's rows are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import materialize

CELLS = 4096
LEVELS = ["domain", "lang", "source"]
Path = tuple[str, ...]
#: Rows (about 60 bytes) of a plan or of chosen ids that are sent to every task; more are joined by shuffle.
SMALL = 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def share_out(nodes: DataFrame, siblings: list[str]) -> DataFrame:
    """nodes (siblings' columns, weight, room, budget of the parent) with `own`, each one's part of the budget.

    Under a common level of budget by weight, nodes of little room are full; in ascending order of room by
    weight a node is full as long as what those before it leave would fill it and all behind it.
    """
    by = ", ".join(siblings) or "1"
    asked = nodes.withColumn("ratio", F.when((F.col("weight") > 0) & (F.col("room") > 0), F.col("room") / F.col("weight")))
    live = asked.where("ratio is not null").selectExpr(
        "*", f"sum(room) over (partition by {by} order by ratio rows between unbounded preceding and current row) - room as before",
        f"sum(weight) over (partition by {by} order by ratio rows between current row and unbounded following) as behind",
    )
    live = live.withColumn("full", F.col("budget") - F.col("before") >= F.col("ratio") * F.col("behind") * (1 - 1e-12))
    live = live.selectExpr(
        "*", f"sum(if(full, room, 0D)) over (partition by {by}) as taken", f"sum(if(full, 0D, weight)) over (partition by {by}) as open",
    )
    live = live.withColumn("own", F.when(F.col("full"), F.col("room")).otherwise((F.col("budget") - F.col("taken")) * F.col("weight") / F.col("open")))
    return live.select(*nodes.columns, "own").unionByName(asked.where("ratio is null").select(*nodes.columns, F.lit(0.0).alias("own")))


def budgets(leaves: DataFrame, weights: Mapping[Path, float], share: float, max_epochs: float) -> DataFrame:
    """(domain, lang, source, tokens, quota) of leaves (domain, lang, source, tokens): tokens to take. Nodes without a weight weigh 1."""
    spark = leaves.sparkSession
    total = float(leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    above = leaves.withColumn("budget", F.lit(min(share, max_epochs) * total))
    above = above.withColumn("room", F.col("tokens") * float(max_epochs))
    for depth, level in enumerate(LEVELS, 1):
        path = LEVELS[:depth]
        given = [(*k, float(v)) for k, v in weights.items() if len(k) == depth]
        given = spark.createDataFrame(given, ", ".join(f"{c} string" for c in path) + ", weight double")
        nodes = above.groupBy(*path).agg(F.sum("room").alias("room"), F.first("budget").alias("budget"))
        nodes = nodes.join(F.broadcast(given), path, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        own = share_out(nodes, path[:-1]).select(*path, "own")
        above = materialize(above.drop("budget").join(own.withColumnRenamed("own", "budget"), path))
    return above.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("quota"))


def mix(
    docs: DataFrame, weights: Mapping[Path, float], share: float = 0.5, max_epochs: float = 4.0, seed: int = 2,
    domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: bool = False,
) -> DataFrame:
    """A row for each document and epoch that takes it: (doc_id, domain, lang, source, n_tokens, epoch, place).

    Read by epoch and place, the rows of a leaf are its token-prefix of seeded epochs. With keep=True: the
    taken rows of docs as they are, each once. share: the budget as a share of all tokens.
    """
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    labels = [known(domain if domain is not None else F.lit("all")).alias("domain"), known(F.col(lang_col)).alias("lang"), known(F.col(source_col)).alias("source")]
    key = F.col(id_col).cast("long").alias("id")
    place = lambda epoch: F.pmod(F.xxhash64("id", F.lit(seed), epoch.cast("long")), F.lit(1 << 40))
    facts = materialize(docs.select(key, *labels, word_count(F.col(text_col)).alias("n_tokens")))
    quota = budgets(materialize(facts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))), weights, share, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(0).cast("long")
    plan = materialize(quota.select(*LEVELS, whole.alias("whole"), F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).alias("rest")))
    cell = F.shiftright(place(F.col("whole")), 28).cast("int").alias("cell")
    placed = facts.join(_small(plan), LEVELS)
    sums = materialize(placed.groupBy(*LEVELS, cell).agg(F.sum("n_tokens").alias("n")))
    upto = sums.selectExpr(*LEVELS, "cell", "n", f"sum(n) over (partition by {', '.join(LEVELS)} order by cell) - n as before")
    ends = upto.join(_small(plan), LEVELS).where("before <= rest and rest < before + n").select(*LEVELS, F.col("cell").alias("edge"), "before")
    plan = materialize(plan.join(ends, LEVELS, "left"))  # one row a leaf
    side = _small(plan)
    # Cells before the edge are in; without an edge the rest is 0 or all.
    last = facts.join(side, LEVELS).where(F.col("edge") == cell).select("id", *LEVELS, place(F.col("whole")).alias("place"), "n_tokens", "rest", "before")
    last = last.selectExpr("id", *LEVELS, f"before + sum(n_tokens) over (partition by {', '.join(LEVELS)} order by place, id) <= rest as taken")
    taken = materialize(last.where("taken and id is not null").select("id", *LEVELS).distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key, *labels) if keep else facts
    joined = rows.join(side, LEVELS).join(_small(taken.withColumn("within", F.lit(1))), ["id", *LEVELS], "left")
    more = F.when(cell < F.col("edge"), 1).when(cell == F.col("edge"), F.coalesce("within", F.lit(0))).otherwise(0)
    chosen = joined.withColumn("times", F.col("whole") + more).where("times > 0")
    if keep:
        return chosen.select("row.*")
    each = chosen.select("id", *LEVELS, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch"))
    return each.select(F.col("id").alias("doc_id"), *LEVELS, "n_tokens", F.col("epoch").cast("int").alias("epoch"), place(F.col("epoch")).alias("place"))
