"""Continuous capture and enrichment with Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.functions.text import session_id_of
from memloom.operators.enrich import answered, apply_outcomes, build_tag_prompts, check_embedding, claim_pending, merge_outcomes, parse_tag_output, prepare_embedding_input, tag_candidates
from memloom.operators.parsing import RAW, normalize_messages, parse_claude, parse_codex, parse_gemini, platform_of_session
from memloom.operators.tags import cluster_totals, dtag_frequency, promote_tags, resolve_aliases, retrotag
from memloom.operators.writes import dedup_content
from memloom.sources.appended import appended_lines, opened
from memloom.sources.shared import fresh_path, written
from memloom.sources.transcripts import SESSION

PATTERNS = {"claude": "*.jsonl", "codex": "*.jsonl", "gemini": "*.json*"}
#: What a query is started with. There is a store for each partition of each keyed step; without the last one each of them reserves 4 MB of local disk.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
CARRIED = "path string, session_id string, byte_offset long, pos long, line string, whole boolean, carried string"


class _Carry(StatefulProcessor):
    """By file: the model named last, and how many lines or messages were taken. Rows come in order of place, new ones only."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.file = handle.getValueState("file", "model string, taken long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        model, taken = self.file.get() or (None, 0)
        at, pos = taken, None
        for r in sorted(rows, key=lambda r: (r.byte_offset, r.nth)):
            # A document gives all its messages again, a file of lines only those that were appended.
            if r.whole and r.nth < taken:
                continue
            pos, at = (r.nth if r.whole else at), at + 1
            model = model if r.model is None else r.model
            yield Row(path=key[0], session_id=r.session_id, byte_offset=r.byte_offset, pos=pos, line=r.line, whole=r.whole, carried=model)
        if pos is not None:
            self.file.update((model, pos + 1))

    def close(self) -> None:
        pass


class _Seen(StatefulProcessor):
    """By session: rows whose uuid, or whose text by the same role if texts count, came before within the time that state is kept are dropped.

    A batch's hashes are one entry of the state, which expires on its own: a session is read and written once a batch.
    """

    def __init__(self, columns: list[str], texts: bool, keep_ms: int | None) -> None:
        self.columns, self.texts, self.keep_ms = columns, texts, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "batch long", "hashes binary", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = list(self.seen.iterator())
        known = set(np.frombuffer(b"".join(bytes(v[0]) for _, v in held), "<i8").tolist())
        new: list[int] = []
        for r in sorted(rows, key=lambda r: (r.path, r.pos)):
            own = {r.uuid_hash, r.text_hash} if self.texts else {r.uuid_hash}
            if known.isdisjoint(own):
                known |= own
                new += own
                yield Row(**{c: r[c] for c in self.columns})
        if new:
            self.seen.updateValue((1 + max((k[0] for k, _ in held), default=0),), (np.array(new, "<i8").tobytes(),))

    def close(self) -> None:
        pass


def captured(lines: DataFrame, kind: str, kind_of_path: str = "file", keep_hours: float | None = 168) -> DataFrame:
    """A stream of new messages (RAW) of a stream of lines, each once by its uuid; for `claude` each text once by role and session as well.

    State is kept by file (the model named last, the number of lines) and by session (hashes of what was seen), over restarts,
    and dropped so many hours after it was written. Sessions and files are spread over tasks; what is added to one
    of them in one batch is put in order in one task, so `maxBytes` of the source bounds it.
    """
    keep = None if keep_hours is None else int(keep_hours * 3_600_000)
    name = F.col("path") if kind_of_path == "file" else F.regexp_extract("path", "file=([^/]+)/", 1)
    rows = lines.withColumn("session_id", session_id_of(name, kind))
    if kind == "gemini":
        doc = F.from_json("line", SESSION)
        many = F.when(F.col("whole"), doc["messages"]).otherwise(F.array("line"))
        rows = rows.withColumn("session_id", F.when(F.col("whole"), session_id_of(name, kind, doc["sessionId"])).otherwise(F.col("session_id")))
        rows = rows.select("path", "session_id", "byte_offset", "nth", "whole", F.posexplode(many).alias("_at", "line"))
        rows = rows.withColumn("nth", F.when(F.col("whole"), F.col("_at").cast("long")).otherwise(F.col("nth")))
    rows = rows.where("session_id is not null")
    if kind == "claude":
        raw = parse_claude(rows.where("trim(line) <> ''").withColumn("pos", F.col("byte_offset")))
    else:
        e = F.from_json("line", "type string, payload struct<model:string>")
        model = F.when(e["type"] == "turn_context", e["payload"]["model"]) if kind == "codex" else F.lit(None).cast("string")
        rows = rows.select("path", "session_id", "byte_offset", "nth", "line", "whole", model.alias("model"))
        carried = rows.groupBy("path").transformWithState(_Carry(keep), CARRIED, "Append", "ProcessingTime")
        if kind == "codex":
            raw = parse_codex(carried)
        else:
            own = F.from_json("line", "sessionId string, type string")
            skip = ~F.col("whole") & (((F.col("pos") == 0) & F.coalesce(own["sessionId"] != "", F.lit(False))) | F.get_json_object("line", "$['$set']").isNotNull())
            raw = parse_gemini(carried.where(~skip).select("path", "session_id", F.col("pos").alias("idx"), F.col("line").alias("message")))
    hashed = raw.withColumns({"pos": F.col("pos").cast("long"), "uuid_hash": F.xxhash64("external_uuid"), "text_hash": F.xxhash64("role", F.sha2("message", 256))})
    schema = ", ".join(f"{c} {'long' if c == 'pos' else 'string'}" for c in RAW)
    return hashed.groupBy("session_id").transformWithState(_Seen(RAW, kind == "claude", keep), schema, "Append", "ProcessingTime")


def stream_ingest(
    spark: SparkSession, landing: str, table: str, checkpoint: str, kind: str = "claude", kind_of_path: str = "file", threads: DataFrame | None = None,
    start: dt.datetime | None = None, keep_hours: float | None = 168, split_bytes: int | None = None, max_bytes: int | None = None, **trigger: Any,
) -> StreamingQuery:
    """Follow growing transcripts of one kind (claude, codex, gemini): each batch appends the messages of what was added.

    Files are found by path and length (documents by time as well), whatever their age; only appended bytes are read,
    in ranges of split_bytes. kind_of_path: `folder` where the session's name is that of the file's folder (file=<name>).
    Texts said twice count once within a session for `claude`, within a batch over all files for `gemini`, and each
    time for `codex`, whose platform is that of its thread (threads: id, source). start: files last changed before it are taken as read ("no
    backfill"). A batch is written to <table>/batch=<number> and replaces itself if it is run again; where nothing was
    added no batch is run.
    """
    lines = appended_lines(
        spark, landing, f"{checkpoint}/files", pattern=PATTERNS[kind], kindOfPath=kind_of_path, splitBytes=split_bytes, maxBytes=max_bytes, start=start and start.isoformat()
    )

    def write(batch: DataFrame, number: int) -> None:
        rows = dedup_content(batch, [], ["path", "pos"]) if kind == "gemini" else batch
        if kind == "codex" and threads is not None:
            rows = platform_of_session(rows, threads)
        normalize_messages(rows).write.mode("overwrite").parquet(f"{table}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)  # the query keeps what it was started with
    try:
        query = captured(lines, kind, kind_of_path, keep_hours).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return query.trigger(**(trigger or {"processingTime": "3 seconds"})).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_dedup(stream: DataFrame, time_col: str = "created_at", late: str = "1 hour") -> DataFrame:
    """Rows whose external_uuid was not seen within the lateness; state older than that is dropped."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["external_uuid"])


def stream_carry_model(stream: DataFrame, keep_hours: float | None = 24) -> DataFrame:
    """(session_id, byte_offset, line, carried) of lines: the model named last in the session, kept across batches.

    State is dropped so many hours after a session's last line; with None it stays, as a run over what is
    at hand (availableNow) needs, which would wait for timeouts without end.
    """

    def carry(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        model = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values("byte_offset", kind="stable")
        carried = []
        for named in rows["model"]:
            model = named if isinstance(named, str) else model
            carried.append(model)
        rows["carried"] = carried
        state.update((model,))
        if keep_hours is not None:
            state.setTimeoutDuration(int(keep_hours * 3_600_000))
        yield rows[["session_id", "byte_offset", "line", "carried"]]

    e = F.from_json("line", "type string, payload struct<model:string>")
    named = stream.select("session_id", "byte_offset", "line", F.when(e["type"] == "turn_context", e["payload"]["model"]).alias("model"))
    schema = "session_id string, byte_offset long, line string, carried string"
    timeout = GroupStateTimeout.NoTimeout if keep_hours is None else GroupStateTimeout.ProcessingTimeTimeout
    return named.groupBy("session_id").applyInPandasWithState(carry, schema, "model string", "append", timeout)


def enrich_once(
    memory: DataFrame, tags: DataFrame, tag_fn: Callable, embed_fn: Callable, dim: int, as_of: dt.datetime, limit: int | None = None, replies: str | None = None, number: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(changed rows of memory, tags) of one round: claim, ask, parse, merge. The functions take lists of texts and are asked once a row.

    replies: a folder in which replies are written before they are used (see `answered`), by round number.
    """
    spark, now = memory.sparkSession, F.lit(as_of).cast("timestamp_ntz")
    replies = replies or fresh_path(spark)
    pending = written(claim_pending(memory, now, limit))
    prompts = build_tag_prompts(pending.where("needs_tag"), tag_candidates(tags))
    told = answered(prompts, tag_fn, "prompt", "raw", store=f"{replies}/tags", number=number)
    parsed, whole = parse_tag_output(told.where("error is null").select("id", "raw"), tags, resolve_aliases(tags))
    failed = told.where("error is not null").select("id", F.lit(None).cast(parsed.schema["p_tag_id"].dataType).alias("p_tag_id"), F.lit(None).cast("array<string>").alias("d_tag"), "error")
    vectors = answered(prepare_embedding_input(pending.where("needs_embed")), embed_fn, "input", "embedding", "array<float>", store=f"{replies}/vectors", number=number)
    checked = check_embedding(vectors.select("id", "embedding"), dim)
    embedded = checked.join(vectors.select("id", F.col("error").alias("_e")), "id").select("id", "embedding", F.coalesce("_e", "error").alias("error"))
    outcomes = merge_outcomes(pending, parsed.unionByName(failed), embedded)
    changed = memory.join(pending.select("id"), "id", "left_semi")
    return written(apply_outcomes(changed, outcomes, now)), written(whole)


def promote_once(memory: DataFrame, tags: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(changed rows of memory, tags) after frequent keywords became tags and were filled in."""
    whole, promoted = promote_tags(tags, cluster_totals(dtag_frequency(memory, as_of)))
    filled = retrotag(memory.where("tag_processed and p_tag_id is null"), written(promoted)).where("p_tag_id is not null")
    return written(filled), written(whole)


def stream_enrich(ticks: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], save: Callable[[DataFrame, DataFrame, int], None], tag_fn: Callable, embed_fn: Callable, dim: int,
                  clock: Callable[[], dt.datetime], checkpoint: str, every: int = 10, limit: int | None = None, **trigger: Any) -> StreamingQuery:
    """Each batch of `ticks` (a rate stream, say) enriches what is pending; every tenth also promotes.

    load gives the memory table and tags; save gets the rows of memory that changed, all tags and the batch's number (merge_memory
    rewrites only the days of such rows). Replies are kept beside the checkpoint for the batch that is run and the one before.
    """
    def round_(batch: DataFrame, number: int) -> None:
        memory, tags = load()
        replies = f"{checkpoint}/replies"
        changed, tags = enrich_once(memory, tags, tag_fn, embed_fn, dim, clock(), limit, f"{replies}/{number}", number)
        if not changed.isEmpty():
            save(changed, tags, number)
        if number % every == every - 1:
            changed, tags = promote_once(load()[0], tags, clock())
            save(changed, tags, number)
        system, top = opened(replies)
        for old in system.get_file_info(FileSelector(top, allow_not_found=True)):
            if old.base_name.isdigit() and int(old.base_name) < number - 1:
                system.delete_dir(old.path)

    return ticks.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
