"""Runtime traces: markers to symbols, call stacks per session, observed relations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEYS = ["repo", "revision"]
MAX_EVENTS, MAX_WARNINGS = 10_000, 100
EVENT_DDL = "session_id string, sequence long, phase string, symbol_id string, parent_symbol_id string, offset_ms long, duration_ms long, outcome string, opened long, warning string"
_EVENT_COLUMNS = [x.split()[0] for x in EVENT_DDL.split(", ")]


def resolve_trace_symbols(markers: DataFrame, symbols: DataFrame) -> DataFrame:
    """Markers (repo, path, symbol, line, ..) with ``symbol_id``: of the same path, named so or ending in ``.symbol`` or ``::symbol``, around the line if one is given; null unless exactly one is.

    Absolute paths and paths with ``..`` resolve to nothing. Distinct marker names are looked up once.
    """
    path = F.regexp_replace("path", r"\\", "/")
    asked = markers.withColumns({"_path": F.when(~F.col("path").rlike(r"^[/\\]|^[A-Za-z]:") & ~F.array_contains(F.split(path, "/"), ".."), path), "_last": F.regexp_extract("symbol", r"([^.:]+)$", 1)})
    names = asked.select("repo", "_path", "_last", "symbol", "line").distinct()
    s = symbols.select("repo", F.col("path").alias("_path"), F.col("name").alias("_last"), F.coalesce("qualified_name", "name").alias("label"), "symbol_id", F.col("line").alias("s_line"), F.coalesce("end_line", "line").alias("s_end"))
    hit = names.join(s, ["repo", "_path", "_last"]).filter((F.col("label") == F.col("symbol")) | F.col("label").endswith(F.concat(F.lit("."), F.col("symbol"))) | F.col("label").endswith(F.concat(F.lit("::"), F.col("symbol"))))
    hit = hit.filter("line is null or line between s_line and s_end")
    one = hit.groupBy("repo", "_path", "_last", "symbol", "line").agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id")).filter("n = 1").drop("n")
    one = one.select(*[F.col(c).alias(f"_1_{c}") for c in ("repo", "_path", "_last", "symbol", "line")], "symbol_id")
    cond = F.lit(True)
    for c in ("repo", "_path", "_last", "symbol", "line"):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_1_{c}"))
    return asked.join(one, cond, "left").select(*markers.columns, "symbol_id")


def reduce_stack(stack: list[tuple[str, int, int]], events: list[tuple[int, int, str, str | None, str | None]], begun: int | None, sequence: int, warned: int) -> tuple[list[dict], list[tuple[str, int, int]], int | None, int, int]:
    """One session's further events (order, ms, phase, symbol, outcome) against its open calls (symbol, ms entered, sequence).

    Enter opens a call; exit and error close the nearest open call of the symbol and all above it. An event without
    a symbol, or a close without an open call, gives a warning row. A close carries ``opened``, the sequence of the enter
    row that it closes. Returns rows, stack, start, sequence, warnings.
    """
    rows = []
    for _, ms, phase, symbol, outcome in sorted(events, key=lambda e: e[0]):
        begun = ms if begun is None else begun
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == symbol), -1)
        problem = "TRACE_SYMBOL_UNRESOLVED" if symbol is None else "TRACE_EVENT_LIMIT_REACHED" if sequence >= MAX_EVENTS else "TRACE_STACK_MISMATCH" if phase != "enter" and at < 0 else None
        if problem:
            warned += 1
            if warned <= MAX_WARNINGS:
                rows.append({"sequence": None, "phase": phase, "symbol_id": symbol, "warning": problem})
            continue
        sequence += 1
        row = {"sequence": sequence, "phase": phase, "symbol_id": symbol, "offset_ms": max(0, ms - begun)}
        if phase == "enter":
            row |= {"parent_symbol_id": stack[-1][0] if stack else None, "outcome": "unknown"}
            stack.append((symbol, ms, sequence))
        else:
            row |= {"parent_symbol_id": stack[at - 1][0] if at else None, "duration_ms": max(0, ms - stack[at][1]), "outcome": "error" if phase == "error" or outcome == "error" else "ok", "opened": stack[at][2]}
            del stack[at:]
        rows.append(row)
    return rows, stack, begun, sequence, warned


def event_frame(session: str, rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame([{"session_id": session, **r} for r in rows], columns=_EVENT_COLUMNS)
    return df.astype({"sequence": "Int64", "offset_ms": "Int64", "duration_ms": "Int64", "opened": "Int64"}).astype(object).where(lambda d: d.notna(), None)


def event_rows(pdf: pd.DataFrame) -> list[tuple]:
    clean = lambda v: None if v is None or v != v else v
    return [(int(o), int(t), p, clean(s), clean(c)) for o, t, p, s, c in zip(pdf["ordinal"], pdf["ms"], pdf["phase"], pdf["symbol_id"], pdf["outcome"])]


def trace_stacks(events: DataFrame) -> DataFrame:
    """Batch twin of the stream: events (session_id, ordinal, ms, phase, symbol_id, outcome) as trace events and warnings; open calls at the end give one warning.

    A session is at most MAX_EVENTS events by contract; what is past them is a warning, not an event.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows, stack, *_ = reduce_stack([], event_rows(pdf), None, 0, 0)
        if stack:
            rows.append({"sequence": None, "phase": None, "symbol_id": stack[-1][0], "warning": "TRACE_STACK_INCOMPLETE"})
        return event_frame(key[0], rows)

    return events.select("session_id", "ordinal", "ms", "phase", "symbol_id", "outcome").groupBy("session_id").applyInPandas(one, EVENT_DDL)


def with_durations(events: DataFrame) -> DataFrame:
    """Enter rows take duration and outcome of the row that closes them; a call that an outer one closes has neither."""
    e = events.filter("warning is null")
    w = W.partitionBy("session_id", F.coalesce("opened", "sequence"))
    closing = F.max(F.when(F.col("opened").isNotNull(), F.struct("duration_ms", "outcome"))).over(w)
    e = e.withColumn("_c", F.when(F.col("phase") == "enter", closing))
    return e.withColumns({"duration_ms": F.coalesce("duration_ms", F.col("_c.duration_ms")), "outcome": F.coalesce(F.col("_c.outcome"), F.col("outcome"))}).drop("_c")


def observed_relations(events: DataFrame) -> DataFrame:
    """Per session and pair: how often the parent entered the symbol, and for how long in total."""
    e = events.filter("phase = 'enter' and parent_symbol_id is not null")
    return e.groupBy("session_id", F.col("parent_symbol_id").alias("from_id"), F.col("symbol_id").alias("to_id")).agg(F.count("*").alias("count"), F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("duration_ms"))


def sequence_gaps(events: DataFrame, group: str, first_type: str | None = None) -> DataFrame:
    """Events with ``gap`` (not the previous sequence + 1, or not 1 at the start), ``restart`` (1 again) and ``bad_start``."""
    w = W.partitionBy(group).orderBy("sequence", "event_id")
    e = events.withColumn("previous", F.lag("sequence").over(w))
    start = F.col("previous").isNull()
    bad = start & (F.col("type") != first_type) if first_type else F.lit(False)
    return e.withColumns({"gap": F.when(start, F.col("sequence") != 1).otherwise(F.col("sequence") != F.col("previous") + 1), "restart": ~start & (F.col("sequence") == F.col("previous")), "bad_start": bad})


def trace_freshness(sessions: DataFrame, revisions: DataFrame, most: int = 100) -> DataFrame:
    """Sessions, newest ``most`` of each repository, with ``stale``: made for another semantic revision than the current one."""
    j = sessions.join(revisions.select("repo", F.col("semantic_revision").alias("current_revision")), "repo", "left")
    j = j.withColumn("stale", ~F.col("semantic_revision").eqNullSafe(F.col("current_revision")))
    return j.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("started_at"), F.desc("session_id")))).filter(F.col("place") <= most)
