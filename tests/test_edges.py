"""Hand-made rows with the cases that tables lack."""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.functions import text as tx
from memloom.operators import brief, enrich, lifecycle, parsing, search, skills, tags, trigrams, writes
from memloom.sources import transcripts as tr

T0 = dt.datetime(2024, 3, 31, 10, 30)


def one(df):
    return [r.asDict() for r in df.collect()]


def test_lines_offsets_and_partial_tail(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    text = 'é1\n\n   \n{"a":1}\nhalf'
    (tmp_path / "sub" / "s1.jsonl").write_text(text, encoding="utf-8")
    (tmp_path / "note.txt").write_text("x\n")
    got = tr.read_jsonl_lines(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["session_id"], r["pos"], r["byte_offset"], r["line"]) for r in got] == [("s1", 0, 0, "é1"), ("s1", 3, 9, '{"a":1}')]
    new, after = tr.delta_lines(tr.read_jsonl_lines(spark, str(tmp_path)), spark.createDataFrame([(got[0]["path"], 9), ("gone", 5)], "path string, cursor long"))
    assert [r["byte_offset"] for r in new.collect()] == [9]
    assert {r["path"][-8:]: r["cursor"] for r in after.collect()} == {"s1.jsonl": 17, "gone": 5}
    files = tr.list_files(spark, str(tmp_path), "*.jsonl").collect()
    assert [f["length"] for f in files] == [len(text.encode())]


def test_session_documents(spark, tmp_path):
    (tmp_path / "session-2024-ab12.json").write_text(json.dumps({"messages": [{"type": "user", "content": [{"text": "a"}, {"text": "b"}]}, {"type": "info", "content": "x"}]}))
    (tmp_path / "session-2024-ff.json").write_text('{"sessionId": "S", "mess')
    rows = parsing.parse_gemini(tr.read_session_json(spark, str(tmp_path))).collect()
    assert [(r["session_id"], r["message"], r["external_uuid"]) for r in rows] == [("ab12", "a\nb", "gemini:ab12:ab12-0")]


def lines(spark, *texts):
    return spark.createDataFrame([("p", "s", i, 100 * i, t) for i, t in enumerate(texts)], "path string, session_id string, pos int, byte_offset long, line string")


def test_claude_edges(spark):
    user = lambda content, **more: json.dumps({"type": "user", "uuid": "u", "message": {"content": content}, **more})
    rows = lines(
        spark, user("  hi ﻿"), user([{"type": "tool_use", "id": 1}]), user([{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]), user("x", isMeta=True),
        "not json", user("<system-reminder>only\nnoise</system-reminder>"), user("[Request interrupted by user]"), user("<command-name>a</command-args>"), json.dumps({"type": "assistant", "message": {"content": "no uuid"}}),
    )
    got = parsing.parse_claude(rows).orderBy("pos").collect()
    assert [r["message"] for r in got] == ["hi", "a\nb", "<command-name>a</command-args>", "no uuid"]
    assert got[0]["external_uuid"] == "claude-code:s:u" and len(got[3]["external_uuid"]) > 64
    assert parsing.parse_claude(rows).orderBy("pos").collect()[3]["external_uuid"] == got[3]["external_uuid"]


def test_codex_edges(spark):
    event = lambda kind, m: json.dumps({"type": "event_msg", "payload": {"type": kind, "message": m}})
    turn = lambda m: json.dumps({"type": "turn_context", "payload": {"model": m}})
    rows = lines(spark, event("agent_message", "early"), turn("m1"), event("agent_message", "a"), event("user_message", " q "), turn("m2"), event("agent_message", "[external_agent_tool_call: x"), event("agent_message", "b"), event("token_count", "n"))
    got = parsing.normalize_messages(parsing.parse_codex(rows)).orderBy("pos").collect()
    assert [(r["message"], r["agent_model"]) for r in got] == [("early", "unknown"), ("a", "m1"), ("q", None), ("b", "m2")]
    assert one(spark.createDataFrame([("/a/rollout-x-y.jsonl",)], "p string").select(tx.session_id_of(F.col("p"), "codex").alias("s"))) == [{"s": None}]


def test_date_ranges(spark):
    given = ["2024-02-30", "2024-02-03 and more", "LAST_MONTH", "3 days ago", "3_days_ago", "12days_ago", "", None, "soon"]
    df = spark.createDataFrame([(g,) for g in given], "s string")
    at = dt.datetime(2024, 3, 31, 10, 30)
    got = [r["d"] for r in df.select(tx.parse_date_range(F.col("s"), at).alias("d")).collect()]
    assert got == [None, dt.datetime(2024, 2, 3), dt.datetime(2024, 3, 2, 10, 30), None, at - dt.timedelta(3), at - dt.timedelta(12), None, None, None]


def test_changes_in_order(spark):
    schema = "id long, user_id long, role string, message string, p_tag_id long, d_tag array<string>, embedding array<float>, is_active boolean, is_pinned boolean, archived_at timestamp_ntz, cold_error string, tag_processed boolean, external_uuid string, agent_platform string, agent_model string, created_at timestamp_ntz, updated_at timestamp_ntz"
    memory = spark.createDataFrame([(i, 1, "user", f"m{i}", 1, ["a"], [1.0], True, i == 3, None, None, True, None, "p", None, T0, T0) for i in (1, 2, 3)], schema)
    log = [(1, 1, "update", 1, "new"), (2, 1, "update", 1, "newer"), (3, 1, "remove", 1, None), (4, 1, "remove", 1, None), (5, 1, "remove", 3, None), (6, 2, "remove", 2, None), (7, 1, "add", None, "kept"),
           (8, 1, "update", None, "x"), (9, 1, "update", 2, ""), (10, 1, "remove", 99, None), (11, 1, "update", 3, "pinned text")]
    after, status = writes.apply_memory_changes(memory, spark.createDataFrame(log, "seq long, user_id long, action string, memory_id long, content string"), F.lit(T0).cast("timestamp_ntz"))
    assert [r["status"] for r in status.orderBy("seq").collect()] == [
        "updated", "updated", "removed", "removed", "pinned", "another user", "added", "memory_id required", "content required", "not found", "updated",
    ]
    rows = {r["id"]: r for r in after.collect()}
    assert rows[1]["message"] == "newer" and not rows[1]["is_active"] and rows[1]["embedding"] is None and not rows[1]["tag_processed"]
    assert rows[2]["message"] == "m2" and rows[3]["message"] == "pinned text" and rows[4]["is_pinned"] and rows[4]["message"] == "kept"


def test_upsert_keeps_null_uuids_apart(spark):
    memory = spark.createDataFrame([(7, "a", True)], "id long, external_uuid string, is_active boolean")
    incoming = spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,)], "external_uuid string")
    table, outcome = writes.upsert_memory(memory, incoming)
    assert sorted(r["id"] for r in table.collect()) == [7, 8, 9, 10]
    assert sorted((r["external_uuid"] or "", r["inserted"]) for r in outcome.collect()) == [("", True), ("", True), ("a", False), ("b", True)]


def test_alias_cycles_have_no_root(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 4), (4, "d", 3), (5, "e", 99)], "id long, name string, alias_of long")
    assert {r["name"]: r["root_id"] for r in tags.resolve_aliases(t).collect()} == {"a": 1, "b": 1, "c": None, "d": None, "e": None}


def test_tag_replies(spark):
    t = spark.createDataFrame([(1, "alpha", None), (2, "old", 1)], "id long, name string, alias_of long")
    raw = ['```json\n{"p_tag": "Alpha ", "d_tag": ["", "X", 5, "' + "y" * 51 + '", "a","b","c","d","e"]}\n```', '{"p_tag": "NEW: ", "d_tag": null}', '{"p_tag": "NEW:old"}', '{"p_tag": "NEW:My Proj", "d_tag": []}', '{"p_tag": "other"}', "[]", None]
    out, whole = enrich.parse_tag_output(spark.createDataFrame(list(enumerate(raw)), "id long, raw string"), t, tags.resolve_aliases(t))
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["p_tag_id"] for i in range(7)] == [1, None, 1, 3, None, None, None]
    assert got[0]["d_tag"] == ["x", "5", "a", "b", "c"] and [got[i]["error"] is None for i in range(7)] == [True] * 5 + [False, False]
    assert {r["name"] for r in whole.collect()} == {"alpha", "old", "my proj"}


def test_model_function_fails_by_row(spark):
    calls = spark.createDataFrame([("a",), ("bad",), ("c",)], "v string")

    def fn(values):
        if "bad" in values:
            raise RuntimeError("boom")
        return [v * 2 for v in values]

    got = {r["v"]: (r["o"], r["error"]) for r in enrich.with_model_fn(calls, fn, "v", "o").collect()}
    assert got == {"a": ("aa", None), "bad": (None, "boom"), "c": ("cc", None)}


def test_model_function_waits_and_keeps_order(spark):
    calls = spark.sparkContext.accumulator(0)
    lost = spark.sparkContext.accumulator(0)

    class Busy(Exception):
        status = 429

    seen: dict = {}

    def fn(values):
        calls.add(len(values))
        if "gone" in values:
            raise ValueError("no such thing")
        if values[0] in ("5", "lost"):  # "5" answers at the third time
            seen[values[0]] = seen.get(values[0], 0) + 1
            if values[0] == "lost" or seen["5"] < 3:
                lost.add(1)
                raise Busy("slow down")
        time.sleep(0.002 * (int(values[0]) % 3) if values[0].isdigit() else 0)
        return [v + "!" for v in values]

    given = spark.createDataFrame([(str(i),) for i in range(40)] + [("gone",), ("lost",)], "v string").coalesce(1)
    began = time.time()
    got = [tuple(r) for r in enrich.with_model_fn(given, fn, "v", "o", batch=1, parallel=8, wait=0.2, longest=0.3).collect()]
    assert got == [(str(i), f"{i}!", None) for i in range(40)] + [("gone", None, "no such thing"), ("lost", None, "slow down")]
    assert calls.value == 39 + 3 + 1 + 3 and lost.value == 2 + 3 and time.time() - began > 0.5


def test_replies_are_asked_for_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    given = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "bad"), (None, "c")], "id long, v string")

    def fn(values):
        calls.add(len(values))
        if "bad" in values:
            raise ValueError("boom")
        return [v * 2 for v in values]

    for number, asked in ((0, 4), (0, 4), (1, 5)):  # run again: nothing new; the next round: the failed one
        got = enrich.answered(given, fn, "v", "o", store=str(tmp_path / "r"), number=number, batch=1)
        for _ in range(2):
            assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", "aa", None), (1, "a", "aa", None), (2, "a", "aa", None), (3, "bad", None, "boom"), (None, "c", "cc", None)], key=repr)
        assert calls.value == asked
    assert {r["o"] for r in enrich.answered(given.withColumn("v", F.lit("z")), fn, "v", "o", store=str(tmp_path / "r"), number=1).collect()} == {"zz"}


def test_a_round_asks_once_a_row_and_again_for_none(spark, tmp_path):
    from memloom.streaming.capture import enrich_once

    tagged, embedded = (spark.sparkContext.accumulator(0) for _ in range(2))
    schema = "id long, user_id long, message string, role string, agent_platform string, agent_model string, is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz, cold_error string, tag_processed boolean, p_tag_id long, d_tag array<string>, embedding array<float>"
    rows = [(i, 1, f"m{i}", "user", "p", None, True, T0, T0, None, i % 10 == 0, None, None, [1.0, 1.0] if i % 4 == 3 else None) for i in range(100)]
    memory = spark.createDataFrame(rows, schema)
    t = spark.createDataFrame([(1, "alpha", None)], "id long, name string, alias_of long")

    def tag(values):
        tagged.add(len(values))
        return ['{"p_tag": "NEW:beta", "d_tag": ["k"]}'] * len(values)

    def embed(values):
        embedded.add(len(values))
        return [[0.5, 0.5]] * len(values)

    for _ in range(2):  # the second is the same batch again
        changed, whole = enrich_once(memory, t, tag, embed, 2, T0, replies=str(tmp_path / "replies"))
        assert {(r["p_tag_id"], r["tag_processed"], len(r["embedding"])) for r in changed.where("id % 10 <> 0").collect()} == {(2, True, 2)}
        assert changed.count() == sum(not r[10] or r[13] is None for r in rows) and whole.count() == 2
        assert (tagged.value, embedded.value) == (90, 75)


def test_merging_rewrites_touched_days_only(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(id % 10 as int)) as created_at", "'a' as message")
    path = str(tmp_path / "m")
    tr.write_memory(rows, path)
    files = lambda: {p.relative_to(path).as_posix(): p.stat().st_mtime_ns for p in (tmp_path / "m").rglob("*.parquet")}
    before = files()
    tr.merge_memory(spark, rows.where("id in (3, 13)").withColumn("message", F.lit("b")).union(spark.createDataFrame([(500, dt.datetime(2024, 1, 4), "c")], rows.schema)), path)
    after = files()
    assert {k.split("/")[0] for k in before.items() ^ after.items() for k in [k[0]]} == {"day=2024-01-04"}
    assert {r["message"]: r["count"] for r in tr.read_memory(spark, path).groupBy("message").count().collect()} == {"a": 98, "b": 2, "c": 1}


def test_upserts_leave_the_stored_table_where_it_is(spark, tmp_path):
    from memloom.sources import keyed

    memory = spark.range(5000).selectExpr("id", "concat('u', id) as external_uuid", "'m' as message")
    keyed.save_keyed(memory, "stored_memory", buckets=16, path=str(tmp_path / "t"))
    try:
        files = lambda: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("*.parquet")}
        before = files()
        new = spark.createDataFrame([("u7", "x"), ("new", "y"), ("new", "z"), (None, "w")], "external_uuid string, message string")
        auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = writes.new_memory_rows(spark.table("stored_memory"), new)[1]._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        scan = next(x for x in plan.split("Join")[1].splitlines() if "stored_memory" in x)
        own = plan[: plan.index(scan)].splitlines()[-4:]  # sort and filters between the join and the scan
        assert "Bucketed: true" in plan and not any("Exchange" in x for x in own)
        for _ in range(2):
            got = {(r["external_uuid"], r["inserted"]) for r in keyed.upsert_keyed(spark, "stored_memory", new).collect()}
        assert got == {("u7", False), ("new", False), (None, True)}
        assert before.items() <= files().items() and spark.table("stored_memory").count() == 5003
    finally:
        spark.sql("DROP TABLE stored_memory")


@pytest.mark.parametrize(("importance", "kind", "access", "days", "score"), [(5, "learning", 0, 0, 5), (10, "state", 0, 14, 10 / math.e), (5, "state", 0, 25, 5 * math.exp(-25 / 14)), (4, "state", 9, 50, 4 * math.exp(-50 / 28))])
def test_decay(spark, importance, kind, access, days, score):
    at = T0 - dt.timedelta(days=days)
    df = spark.createDataFrame([(importance, kind, access, None, at)], "importance int, fact_type string, access_count int, last_accessed_at timestamp_ntz, created_at timestamp_ntz")
    assert lifecycle.decay_score(df, T0).first()["score"] == pytest.approx(score)


def test_forget_and_restore(spark):
    old = T0 - dt.timedelta(days=60)
    rows = [(1, "state", 4, None), (2, "profile", 1, None), (3, "learning", 3, "pending"), (4, "state", 10, None)]
    data = [(i, k, imp, 0, None, (T0 if i == 4 else old), v, True, None) for i, k, imp, v in rows] + [(5, "state", 5, 0, None, old, None, False, None)]
    facts = spark.createDataFrame(data, "id long, fact_type string, importance int, access_count int, last_accessed_at timestamp_ntz, created_at timestamp_ntz, validation_status string, is_active boolean, metadata map<string,string>")
    gone = lifecycle.forget(facts, T0)
    assert {r["id"] for r in gone.where("forgotten_now").collect()} == {1}
    again = lifecycle.forget(gone.drop("forgotten_now"), T0)
    assert again.where("forgotten_now").count() == 0
    assert lifecycle.forget(facts, T0, dry_run=True).where("not is_active").count() == 1
    back = lifecycle.restore(gone.drop("forgotten_now"), T0, id=1)
    row = back.where("id = 1").first()
    assert row["is_active"] and row["metadata"]["forgotten_at"] and row["metadata"]["restored_at"] and row["last_accessed_at"] == T0
    assert lifecycle.forget(back.drop("restored_now"), T0).where("forgotten_now").count() == 0
    assert lifecycle.restore(gone, T0, id=5).where("restored_now").count() == 0
    with pytest.raises(ValueError):
        lifecycle.restore(gone, T0)
    with pytest.raises(ValueError):
        lifecycle.restore(gone, T0, id=1, since_minutes=5)


def test_pages_compare_in_nfc(spark):
    src = spark.createDataFrame([("p", "1", None, T0), ("p", "9", "h", T0)], "provider string, external_id string, content_hash string, last_synced_at timestamp_ntz")
    known = lifecycle.normalized(spark.createDataFrame([("p", "1", "café  x")], "provider string, external_id string, plaintext string")).first()["content_hash"]
    src = src.withColumn("content_hash", F.when(F.col("external_id") == "1", known).otherwise(F.col("content_hash")))
    pages = spark.createDataFrame([("p", "1", " café x\n"), ("p", "2", "new")], "provider string, external_id string, plaintext string")
    registry, judged = lifecycle.sync_pages(src, pages, T0)
    assert {r["external_id"]: r["status"] for r in judged.collect()} == {"1": "unchanged", "2": "new"} and registry.count() == 3


def test_search_wildcards_zero_vectors_and_many_queries(spark, monkeypatch):
    memory = spark.createDataFrame(
        [(1, 1, "user", "p", None, True, T0, "100% sure", [1.0, 0.0]), (2, 1, "user", "p", None, True, T0, "1000 times", [0.0, 0.0]), (3, 1, "user", "p", None, False, T0, "100%", [1.0, 1.0])],
        "id long, user_id long, role string, agent_platform string, p_tag_id long, is_active boolean, created_at timestamp_ntz, message string, embedding array<float>",
    )
    t = spark.createDataFrame([(1, "alpha", None)], "id long, name string, alias_of long")
    schema = "query_id long, user_id long, text string, vector array<float>, p_tag string, date_range string, role string, platform string, include_archived boolean, k int"
    asked = spark.createDataFrame([(1, 1, "100%", None, None, None, None, None, None, None), (2, 1, "x", [1.0, 0.0], None, None, None, None, True, 1), (3, 1, "x", [1.0, 0.0], "nope", None, None, None, None, None), (4, 2, None, None, None, None, None, None, None, None)], schema)
    for most in (4000, 0):
        monkeypatch.setattr(search, "MAX_QUERIES", most)
        got = sorted(((r["query_id"], r["used"], r["id"]) for r in search.search_hybrid(memory, asked, tags.resolve_aliases(t), T0).collect()), key=repr)
        assert got == [(1, "ilike", 1), (1, "ilike", 2), (2, "vector", 1), (3, "none", None), (4, "recency", None)]


def test_skill_routing(spark):
    s = spark.createDataFrame([(1, "active", [1.0, 0.0]), (2, "inactive", [0.0, 1.0])], "id long, status string, embedding array<float>")
    c = spark.createDataFrame([(10, [1.0, 0.1]), (11, [1.0, 0.8]), (12, [0.0, 1.0])], "candidate_id long, embedding array<float>")
    got = {r["candidate_id"]: (r["action"], r["skill_id"], r["parent_skill_id"]) for r in skills.route_skill_candidates(s, c).collect()}
    assert got == {10: ("accumulate", 1, None), 11: ("branch", 1, 1), 12: ("create", None, None)}


def test_keyword_index_gives_the_rows_of_the_scan(spark):
    rng = np.random.default_rng(6)
    words = ["alpha", "beta", "100%", "a_b", "Größe", "back\\\\slash", "日本語", "x", "ab", "İstanbul"]
    made = [(i, i % 3, "user", "p", None, i % 7 != 0, T0 - dt.timedelta(minutes=i), None if i % 50 == 0 else " ".join(words[j] for j in rng.integers(0, len(words), 1 + i % 4))) for i in range(600)]
    memory = spark.createDataFrame(made, "id long, user_id long, role string, agent_platform string, p_tag_id long, is_active boolean, created_at timestamp_ntz, message string")
    texts = ["alpha", "ALPHA beta", "l%a", "alp%beta", "a_b", "100%", "ab", "x", "größe", "日本語", "本", "back\\\\\\\\sl", "istanbul", "no such", "%", "alpha_beta", "", None]
    schema = "query_id long, user_id long, text string, vector array<float>, p_tag string, date_range string, role string, platform string, include_archived boolean, k int"
    t = spark.createDataFrame([(1, "alpha", None)], "id long, name string, alias_of long")
    q = search.prepare_queries(spark.createDataFrame([(n, n % 3, x, None, None, None, None, None, n % 2 == 0, 50) for n, x in enumerate(texts)], schema), tags.resolve_aliases(t), T0)
    index = trigrams.keyword_index(memory, 64).cache()
    got, want = (sorted(map(tuple, f.collect())) for f in (trigrams.search_keyword_indexed(memory, q, index), search.search_keyword(memory, q)))
    assert got == want and len(want) > 100
    assert index.agg(F.max(F.size("ids"))).first()[0] <= 64
    rare = trigrams.keyword_candidates(index, q.where("query_id = 8"))  # `größe`
    mine = {m[0] for m in made if m[1] == 8 % 3 and m[7] and "Größe" in m[7]}
    assert {r["id"] for r in rare.collect()} == mine and len(mine) < 150


def test_nearest_of_blocks_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 4 if i % 9 else 5).tolist() if i % 17 else [0.0] * 4) for i in range(3000)] + [(5000, None), (5001, []), (5002, [1.0, None, 1.0, 1.0])]
    asked = [(i, rng.integers(-3, 4, 4 if i % 5 else 5).tolist() if i % 11 else [0.0] * 4) for i in range(90)] + [(200, None), (201, [1.0])]
    x = spark.createDataFrame([(i, None if v is None else [c if c is None else float(c) for c in v]) for i, v in rows], "id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in asked], "query_id long, vector array<float>")
    cosine = lambda a, b: sum(s * t for s, t in zip(a, b, strict=True)) / math.sqrt(sum(s * s for s in a)) / math.sqrt(sum(t * t for t in b))
    want = {}
    for i, v in asked:
        best = [(-round(cosine(v, w), 9), j) for j, w in rows if v and w and len(v) == len(w) and None not in w and any(v) and any(w)]
        if best:
            want[i] = min(best)
    for limit in (None, 300):  # one block, and many
        got = {r["query_id"]: (-round(r["similarity"], 9), r["id"]) for r in search.nearest_in_blocks(x, q, limit=limit).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    plan = search.nearest_in_blocks(x, q)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and "Exchange hashpartitioning(id" not in plan


def test_models_are_carried_over_segments(spark):
    rows = [("p", "s", i, 100 * i, turn(f"m{i}").strip() if i in (3, 4, 40) else event("agent_message", "x").strip()) for i in range(100)] + [("q", "s", 0, 0, event("agent_message", "x").strip())]
    given = spark.createDataFrame(rows, "path string, session_id string, pos int, byte_offset long, line string").repartition(3)
    want = {("q", 0): None} | {("p", i): None if i < 3 else "m3" if i < 4 else "m4" if i < 40 else "m40" for i in range(100)}
    for segment in (1, 250, 8 << 20):
        assert {(r["path"], r["pos"]): r["carried"] for r in parsing.carry_forward_model(given, segment).collect()} == want


def test_token_windows_in_segments_are_those_of_a_window(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)) or None, T0 - dt.timedelta(seconds=int(rng.zipf(1.2)) % 200_000), bool(i % 13), None if i % 50 == 0 else "x" * int(rng.integers(0, 30))) for i in range(4000)]
    memory = spark.createDataFrame(rows, "id long, user_id long, created_at timestamp_ntz, is_active boolean, message string").repartition(4)
    for budget in (0, 5, 300, 10_000):
        cum, want = {}, []
        for i, u, at, active, m in sorted((r for r in rows if r[3]), key=lambda r: (-r[2].timestamp(), r[0])):
            if m is not None:
                cum[u] = cum.get(u, 0) + len(m)
            if u in cum and cum[u] / 1.7 <= budget and at >= T0 - dt.timedelta(days=3):
                want.append((i, round(cum[u] / 1.7, 6)))
        got = [(r["id"], round(r["tokens"], 6)) for r in brief.short_term_window(memory, T0, 3, budget).collect()]
        assert sorted(got) == sorted(want)


def test_noise_is_removed_once_per_element(spark):
    df = spark.createDataFrame([("a <system-reminder>x</system-reminder> b <system-reminder>y\nz</system-reminder>",), ("<hook>k</hook>",)], "t string")
    assert [r["o"] for r in df.select(tx.strip_noise(F.col("t")).alias("o")).collect()] == ["a  b", "<hook>k</hook>"]


def user(u, m):
    return json.dumps({"type": "user", "uuid": u, "message": {"content": m}}) + "\n"


def event(kind, m):
    return json.dumps({"type": "event_msg", "payload": {"type": kind, "message": m}}) + "\n"


def turn(m):
    return json.dumps({"type": "turn_context", "payload": {"model": m}}) + "\n"


@pytest.fixture
def capture(spark, tmp_path):
    from memloom.streaming.capture import stream_ingest

    landing = tmp_path / "in"
    landing.mkdir()

    def run(kind, **more):
        stream_ingest(spark, str(landing), str(tmp_path / "table"), str(tmp_path / "check"), kind, availableNow=True, **more).awaitTermination(120)
        return [r.asDict() for r in spark.read.parquet(str(tmp_path / "table")).collect()]

    run.landing, run.table, run.state = landing, tmp_path / "table", tmp_path / "check" / "files"
    return run


def test_capture_follows_files_that_grow(capture):
    (capture.landing / "a.jsonl").write_text(user("1", "x") + user("2", "x") + user("3", "y") + '{"half')
    capture("claude")
    (capture.landing / "b.jsonl").write_text(user("1", "x"))
    os.utime(capture.landing / "b.jsonl", (1, 1))  # older than all that is known
    (capture.landing / "copy").mkdir()
    (capture.landing / "copy" / "a.jsonl").write_text(user("3", "y") + user("4", "z"))
    capture("claude")
    with (capture.landing / "a.jsonl").open("r+") as f:  # grown: the half line completed, a text said before, a new one
        f.seek(0, 2)
        f.seek(f.tell() - 6)
        f.write(user("5", "y") + user("6", "new"))
    capture("claude")
    batches, rounds = (sorted(p.name for p in x.iterdir() if p.name[0] in "br") for x in (capture.table, capture.state))
    got = sorted(r["external_uuid"] for r in capture("claude"))
    assert got == ["claude-code:a:1", "claude-code:a:3", "claude-code:a:4", "claude-code:a:6", "claude-code:b:1"]
    assert (batches, rounds) == tuple(sorted(p.name for p in x.iterdir() if p.name[0] in "br") for x in (capture.table, capture.state))  # nothing was written when nothing was new


def test_capture_of_codex(spark, capture):
    uid = "0123abcd-0000-1111-2222-333344445555"
    log = capture.landing / f"rollout-2024-{uid}.jsonl"
    log.write_text(turn("m1") + event("user_message", "hello") + event("user_message", "hello"))
    threads = spark.createDataFrame([(uid, "vscode")], "id string, source string")
    capture("codex", threads=threads)
    with log.open("a") as f:
        f.write(event("agent_message", "answer") + event("user_message", "hello") + turn("m2") + event("agent_message", "answer"))
    got = capture("codex", threads=threads, split_bytes=50)
    assert sorted((r["role"], r["message"], r["agent_model"] or "") for r in got) == [("assistant", "answer", "m1"), ("assistant", "answer", "m2"), *[("user", "hello", "")] * 3]
    assert {r["agent_platform"] for r in got} == {"codex-desktop"} and len({r["external_uuid"] for r in got}) == 5


def test_capture_of_gemini(capture):
    doc, lines = capture.landing / "session-2024-ab12.json", capture.landing / "session-2024-cd.jsonl"
    messages = [{"id": "1", "type": "user", "content": "hi"}, {"type": "user", "content": "hi"}, {"type": "user", "content": "else"}]
    doc.write_text(json.dumps({"sessionId": "s", "messages": messages}))
    lines.write_text(json.dumps({"sessionId": "t"}) + "\n" + json.dumps({"$set": {}}) + "\n" + json.dumps({"type": "user", "content": "hi"}) + "\n")
    assert sorted(r["external_uuid"] for r in capture("gemini")) == ["gemini:s:1", "gemini:s:s-2"]
    messages.append({"id": "9", "type": "gemini", "content": "hi", "model": "g"})
    doc.write_text(json.dumps({"sessionId": "s", "messages": messages}))
    with lines.open("a") as f:
        f.write(json.dumps({"type": "user", "content": "hi"}) + "\n")
    assert sorted(r["external_uuid"] for r in capture("gemini")) == ["gemini:cd:cd-3", "gemini:s:1", "gemini:s:9", "gemini:s:s-2"]


def test_small_files_are_written_and_read_together(spark, tmp_path):
    """Very many short transcripts: a task writes its files itself, whole and in order, and hands their lines on in few batches."""
    from memloom.sources import appended

    top = str(tmp_path / "in")
    rows = spark.createDataFrame([(f"{i:03}.jsonl", n, f"{i} {n} ü") for n in (2, 0, 1) for i in range(300)], "file string, turn int, line string")
    for _ in range(2):  # a second run leaves the same
        assert appended.write_files(rows, top, "turn") == 300
    assert sorted(str(p.relative_to(top)) for p in tmp_path.glob("in/*/*")) == [f"file={i:03}.jsonl/lines" for i in range(300)]
    assert (tmp_path / "in" / "file=007.jsonl" / "lines").read_text() == "7 0 ü\n7 1 ü\n7 2 ü\n"
    assert appended.write_files(rows.limit(0), str(tmp_path / "none")) == 0
    reader = appended._Appended({"path": top, "state": str(tmp_path / "state"), "kindofpath": "folder", "pattern": "*.jsonl"})
    parts = reader.partitions({"round": 0}, reader.latestOffset())
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) == len(parts) <= appended.TASKS
    got = sorted((r["path"][-15:-6], r["nth"], r["line"]) for b in batches for r in b.to_pylist())
    assert got == sorted((f"{i:03}.jsonl", n, f"{i} {n} ü") for i in range(300) for n in range(3))


def test_small_files_do_not_fill_a_batch(tmp_path, monkeypatch):
    from memloom.sources import appended

    monkeypatch.setattr(appended, "LINES", 10)
    for i in range(40):
        (tmp_path / f"{i}.jsonl").write_text("x\n" * 3)
    reader = appended._Appended({"path": str(tmp_path), "state": str(tmp_path / "_state"), "pattern": "*.jsonl"})
    part = appended.InputPartition([(str(tmp_path / f"{i}.jsonl"), 0, 6, False) for i in range(40)])
    assert [b.num_rows for b in reader.read(part)] == [12] * 10


def test_capture_without_backfill_and_in_portions(spark, capture):
    for name in "ab":
        (capture.landing / f"{name}.jsonl").write_text("".join(user(str(i), f"{name}{i}") for i in range(20)))
    os.utime(capture.landing / "a.jsonl", (1_000_000_000, 1_000_000_000))
    begin = dt.datetime(2020, 1, 1)
    assert {r["session_id"] for r in capture("claude", start=begin)} == {"b"}
    with (capture.landing / "a.jsonl").open("a") as f:
        f.write("".join(user(str(i), f"a{i}") for i in range(20, 40)))
    for _ in range(60):  # a round takes 100 bytes at most, wherever that ends
        have = capture("claude", start=begin, max_bytes=500)
        if len(have) == 40:
            break
    assert sorted(r["external_uuid"] for r in have) == sorted([f"claude-code:b:{i}" for i in range(20)] + [f"claude-code:a:{i}" for i in range(20, 40)])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_ranges_give_each_line_once(spark, tmp_path, size, monkeypatch):
    from memloom.sources import appended

    monkeypatch.setattr(appended, "BACK", 4)
    monkeypatch.setattr(appended, "CHUNK", 5)
    text = "é1\n\n   \nlonger than a range or two\n{}\nhalf".encode()
    (tmp_path / "x y#.jsonl").write_bytes(text)
    system, name = appended.opened(f"file:{tmp_path}/x y#.jsonl")
    got = []
    with system.open_input_file(name) as f:
        for start in range(0, len(text), size):
            got += appended.lines_in(f, start, min(len(text), start + size))
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert got == want


def test_long_files_are_spread_and_tails_are_read_alone(spark, tmp_path, monkeypatch):
    from memloom.sources import appended

    rows = [f'{{"n":{i},"pad":"{"x" * (i % 90)}"}}' if i % 7 else "" for i in range(5000)]
    log = tmp_path / "s.jsonl"
    log.write_text("\n".join(rows) + "\n")
    cursors = tr.read_new_lines(spark, str(tmp_path), split_bytes=10_000)[1].cache()
    assert tr.read_jsonl_lines(spark, str(tmp_path), split_bytes=10_000).rdd.getNumPartitions() > 1
    assert cursors.first()[1:] == (log.stat().st_size, 5000)
    with log.open("a") as f:
        f.write('{"new":1}\n\n{"new":2}\nhalf')
    ranges = appended.file_ranges(tr.list_files(spark, str(tmp_path), "*.jsonl"), cursors, 10_000).collect()
    assert [(r["start"], r["stop"]) for r in ranges] == [(cursors.first()["cursor"], log.stat().st_size)]  # as many bytes as were appended
    new, after = tr.read_new_lines(spark, str(tmp_path), cursors, split_bytes=10_000)
    assert [(r["pos"], r["line"]) for r in new.orderBy("pos").collect()] == [(5000, '{"new":1}'), (5002, '{"new":2}')]
    assert after.first()[1:] == (log.stat().st_size - 4, 5003)
    assert [r["pos"] for r in tr.read_jsonl_lines(spark, str(tmp_path), split_bytes=999).orderBy("byte_offset").collect()] == [*(i for i in range(5000) if i % 7), 5000, 5002]


def test_numbers_are_whole_and_unique_at_size(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            made = writes.numbered(spark.range(4_000_000).select((F.col("id") * 7919 % 4_000_037).alias("x")), ["x"], 10)
            assert made.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (4_000_000, 4_000_000, 11, 4_000_010)
        assert made.orderBy("id").where("id % 1000 = 0").selectExpr("x").collect() == made.orderBy("x").where("id % 1000 = 0").selectExpr("x").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_long_alias_chains(spark):
    t = spark.createDataFrame([(i, f"t{i}", i - 1 if i else None) for i in range(300)] + [(1000, "c", 1001), (1001, "d", 1000)], "id long, name string, alias_of long")
    got = {r["id"]: r["root_id"] for r in tags.resolve_aliases(t).collect()}
    assert got == dict.fromkeys(range(300), 0) | {1000: None, 1001: None}


def test_streams_continue_over_restarts(spark, tmp_path):
    from memloom.streaming.capture import stream_carry_model

    rows = "session_id string, byte_offset long, line string"
    turn, said = json.dumps({"type": "turn_context", "payload": {"model": "m"}}), json.dumps({"type": "event_msg"})
    for batch in ([("s", 0, turn), ("s", 5, said), ("t", 0, said)], [("s", 9, said)]):
        spark.createDataFrame(batch, rows).write.mode("append").parquet(str(tmp_path / "lines"))
        stream = stream_carry_model(spark.readStream.schema(rows).parquet(str(tmp_path / "lines")), keep_hours=None)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(60)
    got = {(r["session_id"], r["byte_offset"]): r["carried"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("s", 0): "m", ("s", 5): "m", ("t", 0): None, ("s", 9): "m"}
