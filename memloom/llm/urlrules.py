"""URL rules: which of many (host, path prefix) rules judges a URL, by a sort-merge join of keys with intervals.

A rule fits its host and all subdomains, if the URL's path starts with the rule's. A URL stands for one key for each
host suffix: the suffix with its labels reversed, a slash, and the path. A rule's key is made alike, so the
keys that a rule fits are an interval that begins at its key, and two intervals are nested or apart. URLs'
keys and rules are dealt by range of the key; within a range a sweep in key order keeps the stack of rules
that are open, whose top is the longest that fits. A rule also goes to each later range that begins inside
its interval: at most one for each prefix of the range's first key.

Of a URL's suffixes the longest rule (host and path together) wins, of equal ones that with the longer host.
Rules of the same host and path are one rule, which blocks if any of them does. Rules with an empty or null host or a
null verdict fit nothing; a null path is an empty one. Null URLs and those without `://` have an empty host
and path and take the default. Repeated rows come back repeated, rows with a null id are judged alike.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.llm.common import map_frames

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A range's bound is at most so long; 16 keys a range are looked at to find the bounds.
BOUND, LOOKED_AT = 256, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: from there up to `?`, `#` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: str, path: str) -> str:
    return f"{'.'.join(reversed(host.split('.')))}/{path}"


def suffixes(host: str, depth: int) -> list[str]:
    """The host's suffixes of up to depth labels, the longest first; of an empty host the empty one, whose key no rule has."""
    labels = host.rsplit(".", depth)
    labels = labels[1:] if len(labels) > depth else labels
    return [".".join(labels[i:]) for i in range(len(labels))]


def _bounds(rows: DataFrame, ranges: int, depth: int) -> list[tuple[str, int]]:
    """Up to ranges - 1 ascending (key, salt) that cut the keys of (host, path, salt) into about equal ranges. They decide the work, not the result."""
    many = rows.count()
    share = min(1.0, ranges * LOOKED_AT / max(1, many))
    seen = rows.where(F.pmod(F.xxhash64("salt", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select(F.right("host", F.lit(BOUND)).alias("host"), F.left("path", F.lit(BOUND)).alias("path"), "salt")
    keys = sorted((key_of(s, r["path"])[:BOUND], r["salt"]) for r in seen.limit(4 * ranges * LOOKED_AT).collect() for s in suffixes(r["host"], depth))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row; rules: (host, path, verdict). The driver sees the ranges' bounds, eight ranges for each shuffle partition, 4096 at most."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("salt", F.xxhash64("page_id", "host", "path"))
    known = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), "verdict")
    known = known.where("host <> '' and verdict in ('allow', 'block')").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    depth = known.agg(F.max(F.size(F.split("host", "[.]")))).first()[0] or 1  # labels of a rule's host
    ranges = min(4096, max(64, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = _bounds(urls.where("host <> ''"), ranges, depth)
    firsts, last_of = [k for k, _ in bounds], "\U0010ffff" * (BOUND + 1)

    def candidates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out, row = [], []
            # Repeated rows of a batch are one, with their number.
            same = part.groupby(["page_id", "host", "path", "salt"], dropna=False, sort=False).size().reset_index(name="times")
            for i, (h, p, salt) in enumerate(zip(same["host"], same["path"], same["salt"].tolist(), strict=True)):
                for j, s in enumerate(suffixes(h, depth)):
                    key = key_of(s, p)
                    out.append((bisect_right(bounds, (key, salt)), key, 1, j == 0))
                    row.append(i)
            made = pd.DataFrame(out, columns=["r", "key", "kind", "own"])
            own = same.iloc[row].reset_index(drop=True)
            yield made.assign(page_id=own["page_id"].astype("Int64"), host=own["host"], path=own["path"], times=own["times"], rule=None, verdict=None, size=0, host_size=0)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each rule to the range of its key and to those that begin inside its interval."""
        for part in parts:
            keys = [key_of(h, p) for h, p in zip(part["host"], part["path"], strict=True)]
            first = [bisect_left(firsts, k) for k in keys]
            last = [bisect_right(firsts, k + last_of, lo=f) for k, f in zip(keys, first, strict=True)]
            row = np.repeat(np.arange(len(part)), [b - a + 1 for a, b in zip(first, last, strict=True)])
            own = part.iloc[row].reset_index(drop=True)
            yield pd.DataFrame({
                "r": [r for a, b in zip(first, last, strict=True) for r in range(a, b + 1)], "key": [keys[i] for i in row], "kind": 0, "own": False, "page_id": pd.array([None] * len(row), "Int64"),
                "host": own["host"], "path": own["path"], "times": 0, "rule": own["host"] + own["path"], "verdict": own["verdict"], "size": (own["host"] + own["path"]).str.len(), "host_size": own["host"].str.len(),
            })

    schema = "r int, key string, kind int, own boolean, page_id long, host string, path string, times long, rule string, verdict string, size long, host_size long"
    both = map_frames(urls, candidates, schema).unionByName(map_frames(known, spread, schema))
    dealt = both.repartition("r").sortWithinPartitions("r", "key", "kind")

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[str, str, str, int, int]] = []
        at = None
        for part in parts:
            best, some = [], np.zeros(len(part), bool)
            for i, (r, key, kind, own, rule, verdict, size, host_size) in enumerate(zip(*(part[c] for c in ("r", "key", "kind", "own", "rule", "verdict", "size", "host_size")), strict=True)):
                if r != at:
                    at, stack = r, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((key, rule, verdict, size, host_size))
                elif own or stack:
                    some[i] = True
                    best.append(stack[-1][1:] if stack else (None, None, -1, -1))
            found = part[some][["page_id", "host", "path", "times", "own"]].reset_index(drop=True)
            found[["rule", "verdict", "size", "host_size"]] = pd.DataFrame(best, columns=["rule", "verdict", "size", "host_size"])
            yield found.astype({"size": "int64", "host_size": "int64"})

    met = map_frames(dealt, match, "page_id long, host string, path string, times long, own boolean, rule string, verdict string, size long, host_size long")
    best = met.groupBy("page_id", "host", "path").agg(F.sum(F.when(F.col("own"), F.col("times"))).alias("times"), F.max(F.struct("size", "host_size", "rule", "verdict")).alias("top"))
    # Repeats in portions of a batch, so that no array is longer.
    best = best.withColumn("portion", F.explode(F.sequence(F.lit(1), F.col("times"), F.lit(10_000))))
    best = best.withColumn("one", F.explode(F.sequence(F.col("portion"), F.least("times", F.col("portion") + 9_999))))
    return best.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
