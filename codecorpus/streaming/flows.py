"""Structured Streaming twins: traces, runs, event de-duplication, file changes."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupStateTimeout

from codecorpus.operators import runs, traces
from codecorpus.operators.delta import incremental_plan
from codecorpus.operators.extract_text import parse_trace_markers
from codecorpus.operators.storage import stored
from codecorpus.sources.index import FileIndex


def marker_stream(lines: DataFrame, symbols: DataFrame, prefix: str = "@trace ") -> tuple[DataFrame, DataFrame]:
    """(events, warnings) of raw lines (repo, session_id, ordinal, ms, line): parsed, allow-listed, joined to the static symbols."""
    parsed = parse_trace_markers(lines, prefix)
    good = parsed.filter("warning is null").select("repo", "session_id", "ordinal", "ms", "marker.*")
    s = symbols.select("repo", "path", F.col("name").alias("symbol"), "symbol_id", F.col("line").alias("s_line"), F.col("end_line").alias("s_end"))
    s = s.withColumn("n", F.count("*").over(W.partitionBy("repo", "path", "symbol"))).filter("n = 1").drop("n")
    found = good.join(s, ["repo", "path", "symbol"], "left").withColumn("symbol_id", F.when(F.col("line").isNull() | F.col("line").between(F.col("s_line"), F.col("s_end")), F.col("symbol_id")))
    return found.select("session_id", "ordinal", "ms", "phase", "symbol_id", "outcome"), parsed.filter("warning is not null").select("session_id", "warning")


def trace_stream(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Trace events of a stream (session_id, ordinal, ms, phase, symbol_id, outcome): the call stack is the state, keyed by session.

    Rows of one micro-batch are put in order; a session idle for ``idle`` (our rule) ends with a warning if calls are open.
    """
    seconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, frames, state):
        if state.hasTimedOut:
            stack = json.loads(state.get[0])
            state.remove()
            yield traces.event_frame(key[0], [{"sequence": None, "phase": None, "symbol_id": stack[-1][0], "warning": "TRACE_STACK_INCOMPLETE"}] if stack else [])
            return
        stack, begun, sequence, warned = (json.loads(state.get[0]), *state.get[1:]) if state.exists else ([], None, 0, 0)
        rows = [r for f in frames for r in traces.event_rows(f)]
        out, stack, begun, sequence, warned = traces.reduce_stack([tuple(x) for x in stack], rows, begun, sequence, warned)
        state.update((json.dumps(stack), begun, sequence, warned))
        state.setTimeoutDuration(seconds)
        yield traces.event_frame(key[0], out)

    return events.groupBy("session_id").applyInPandasWithState(step, traces.EVENT_DDL, "stack string, begun long, sequence long, warned long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def trace_sessions(marks: DataFrame) -> DataFrame:
    """Session life cycles of a stream or table (session_id, event_time, mark start, end, fail or interrupt): status, start, end.

    In a stream give a watermark on event_time before; the group is the session.
    """
    ends = {"end": "completed", "fail": "failed", "interrupt": "interrupted"}
    status = F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])
    last = F.max(F.when(F.col("mark") != "start", F.struct("event_time", "mark")))
    return marks.groupBy("session_id").agg(F.min(F.when(F.col("mark") == "start", F.col("event_time"))).alias("started_at"), last.alias("last")).select("session_id", "started_at", F.col("last.event_time").alias("completed_at"), F.coalesce(status[F.col("last.mark")], F.lit("running")).alias("status"))


def run_stream(events: DataFrame) -> DataFrame:
    """``run_state`` of a stream of run events: the projection is the state, nothing is replayed."""

    def step(key, frames, state):
        now = json.loads(state.get[0]) if state.exists else None
        rows = [r for f in frames for r in f.to_dict("records")]
        now = runs.reduce_run(now, rows)
        state.update((json.dumps(now),))
        yield runs.state_frame([now])

    cols = ["event_id", "run_id", "sequence", "ts", "type", "payload", "payload_hash"]
    return events.select(*cols).groupBy("run_id").applyInPandasWithState(step, runs.STATE_DDL, "projection string", "update", GroupStateTimeout.NoTimeout)


def latest_index(spark: SparkSession, index_path: str, before: int | None = None, analyzer_version: str = "1") -> DataFrame | None:
    """The index that apply_file_changes keeps, as of its last batch (before the given one); None without any."""
    return FileIndex(spark, index_path, analyzer_version).rows(before)


def fold_file_changes(batch: DataFrame, number: int, index_path: str, parse: Callable[[DataFrame], DataFrame], analyzer_version: str = "1") -> None:
    """Batch ``number`` of changed files (repo, path, size, mtime, content, changed_at) into the index: one segment with the rows of what has changed.

    Of a burst only the last change of a path counts, of equal times the larger one; a null content is a file that is gone; a file of
    known size and mtime is left alone. Where the batch has a ``root``, so have the rows.
    """
    index = FileIndex(batch.sparkSession, index_path, analyzer_version)
    last = batch.groupBy("repo", "path").agg(F.max_by(F.struct(*[c for c in batch.columns if c not in ("repo", "path", "changed_at")]), F.struct("changed_at", F.col("content").isNotNull(), "size", "mtime")).alias("x")).select("repo", "path", "x.*")
    last = stored(last, "changed-files")
    there = last.filter("content is not null")
    old = index.rows(number)
    if old is not None:
        known = old.select("repo", "path", "size", "mtime").distinct().join(last.select("repo", "path"), ["repo", "path"], "left_semi")
        same = incremental_plan(there, known).filter("action = 'reuse'").select("repo", "path")
        last, there = last.join(same, ["repo", "path"], "left_anti"), there.join(same, ["repo", "path"], "left_anti")
    rows = parse(there)
    if "root" in last.columns and "root" not in rows.columns:
        rows = rows.join(there.select("repo", "path", "root"), ["repo", "path"])
    index.commit(number, rows, last)


def apply_file_changes(changes: DataFrame, index_path: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str, analyzer_version: str = "1"):
    """Query that folds bursts of changed files into the index at ``index_path``, a segment for each batch (fold_file_changes); read it with latest_index."""
    return changes.writeStream.foreachBatch(lambda batch, number: fold_file_changes(batch, number, index_path, parse, analyzer_version)).option("checkpointLocation", checkpoint)
