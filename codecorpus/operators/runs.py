"""Journals of agent runs: checks, de-duplication, reduction to a state, usage against budgets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions.texts import canonical, payload_hash

# States, their successors, and types of events with the payload fields that each needs.
END = ["failed", "interrupted", "attention-required"]
TRANSITIONS = {
    "created": ["context-planning", *END],
    "context-planning": ["planning", "executing", *END],
    "planning": ["awaiting-approval", "executing", *END],
    "awaiting-approval": ["executing", *END],
    "executing": ["verifying", "review-ready", "completed", *END],
    "verifying": ["repairing", "review-ready", "completed", *END],
    "repairing": ["executing", "verifying", *END],
    "review-ready": ["applied", "archived", *END],
    "attention-required": ["awaiting-approval", "executing", "verifying", "repairing", "review-ready", "failed", "interrupted"],
    "completed": [],
    "applied": [],
    "archived": [],
    "failed": [],
    "interrupted": [],
}
EVENT_TYPES = {
    "run.created": ["runId", "createdAt", "budget"],
    "context.selected": ["evidenceIds"],
    "plan.created": ["plan"],
    "plan.evaluated": ["evaluation"],
    "state.changed": ["from", "to"],
    "approval.requested": ["requestId", "capability", "reason"],
    "approval.resolved": [],
    "provider.session": ["session"],
    "provider.message": ["text", "completed"],
    "tool.requested": ["request"],
    "tool.started": ["requestId", "startedAt"],
    "tool.completed": ["requestId", "status", "completedAt"],
    "file.changed": ["paths"],
    "checkpoint.created": ["checkpointId", "label", "manifestHash", "changedPaths", "totalBytes"],
    "verification.completed": ["receipt"],
    "repair.started": ["receipt"],
    "repair.completed": ["receipt"],
    "repair.stopped": ["fingerprint", "attempts", "reason", "stoppedAt"],
    "analysis.updated": ["receipt"],
    "review.created": ["reviewId", "changeSetIds", "changedPaths"],
    "run.completed": ["response", "completedAt"],
    "run.failed": ["error", "completedAt"],
}
BUDGETS = [
    ("wall time", "wall_time_ms", "wallTimeMs"),
    ("provider turns", "provider_turns", "providerTurns"),
    ("changed files", "changed_files", "maxChangedFiles"),
    ("changed bytes", "changed_bytes", "maxChangedBytes"),
    ("concurrent processes", "processes", "maxProcesses"),
    ("repair attempts", "repair_attempts", "maxRepairAttempts"),
    ("tool requests", "tool_requests", "maxToolRequests"),
]
STATE_DDL = (
    "run_id string, state string, provider_id string, wall_time_ms long, provider_turns long, changed_files long, changed_bytes long, processes long, repair_attempts long, tool_requests long, "
    "changed_paths array<string>, checkpoint_ids array<string>, review_id string, event_count long, last_sequence long, event_digest string, error string, digests array<string>"
)
STATE_COLUMNS = [x.split()[0] for x in STATE_DDL.split(", ")]


def validate_run_events(events: DataFrame) -> DataFrame:
    """Events with ``problem``: the first of missing id or run, sequence under 1, bad timestamp, unknown type, missing payload field, payload that isn't canonical JSON, hash that isn't the payload's."""
    keys = F.json_object_keys("payload")
    needed = F.create_map(*[x for t, names in EVENT_TYPES.items() for x in (F.lit(t), F.array(*map(F.lit, names)).cast("array<string>"))])
    hashed = payload_hash(F.col("payload"))
    e = events.withColumn("_hash", hashed)
    problem = (
        F.when(F.coalesce("event_id", F.lit("")) == "", "ID_MISSING")
        .when(F.coalesce("run_id", F.lit("")) == "", "RUN_MISSING")
        .when(F.coalesce("sequence", F.lit(0)) < 1, "SEQUENCE")
        .when(F.try_to_timestamp("ts").isNull(), "TIMESTAMP")
        .when(needed[F.col("type")].isNull(), "TYPE_UNKNOWN")
        .when(F.col("_hash").isNull(), "PAYLOAD_NOT_CANONICAL")
        .when(keys.isNull() | (F.size(F.array_except(needed[F.col("type")], keys)) > 0), "PAYLOAD_SHAPE")
        .when(F.col("_hash") != F.col("payload_hash"), "PAYLOAD_HASH")
    )
    return e.withColumn("problem", problem).drop("_hash")


def dedupe_events(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events once for each run and id. In a stream give ``watermark``, which bounds the state (column ``event_time``)."""
    if watermark:
        return events.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["run_id", "event_id"])
    return events.dropDuplicates(["run_id", "event_id"])


def conflicting_events(events: DataFrame) -> DataFrame:
    """Ids that one run uses with different contents."""
    return events.groupBy("run_id", "event_id").agg(F.count_distinct("payload_hash", "sequence", "type").alias("variants"), F.count("*").alias("n")).filter("variants > 1")


def _identity(e: dict) -> str:
    return hashlib.sha256(canonical(json.dumps([e["event_id"], e["run_id"], e["sequence"], e["ts"], e["type"], e["payload_hash"]])).encode()).hexdigest()


def _chained(before: str, identity: str) -> str:
    return hashlib.sha256(f"{before}:{identity}".encode()).hexdigest()


def _ms(a: str, b: str) -> int:
    return max(0, int((datetime.fromisoformat(b.replace("Z", "+00:00")) - datetime.fromisoformat(a.replace("Z", "+00:00"))).total_seconds() * 1000))


class Rule(NamedTuple):
    """What an event type asks of the state, as (code, predicate of state and payload), and what it writes to it."""

    asks: tuple = ()
    gives: Callable[[dict, dict], dict] = lambda s, p: {}


def _touching(paths: Callable[[dict], list], more: Callable[[dict, dict], dict] = lambda s, p: {}):
    """An update that adds to the changed paths."""

    def gives(s, p):
        changed = sorted({*s["changed_paths"], *paths(p)})
        return {"changed_paths": changed, "changed_files": len(changed), **more(s, p)}

    return gives


def _marked(table: str, key: Callable[[dict], str], value: Callable[[dict], object], more: Callable[[dict, dict], dict] = lambda s, p: {}):
    """An update that writes one entry of a table of the state."""
    return lambda s, p: {table: {**s[table], key(p): value(p)}, **more(s, p)}


def _attempt(p):
    return str(p["receipt"].get("attempt"))


def _tool(s, p):
    return s["tools"].get(p["requestId"])


#: What each type of event does; types without a rule only count.
RULES = {
    "run.created": Rule((("CREATED_TWICE", lambda s, p: False),)),
    "state.changed": Rule(
        (("STATE_MISMATCH", lambda s, p: s["state"] == p["from"]), ("TRANSITION_NOT_ALLOWED", lambda s, p: p["to"] in TRANSITIONS.get(s["state"], ()))),
        lambda s, p: {"state": p["to"], "provider_turns": s["provider_turns"] + (p["to"] == "executing")},
    ),
    "provider.session": Rule((("PROVIDER_MISMATCH", lambda s, p: s["provider_id"] == p["session"].get("providerId")),)),
    "tool.requested": Rule(
        (("TOOL_REPEATED", lambda s, p: p["request"].get("id") not in s["tools"]),),
        _marked("tools", lambda p: p["request"].get("id"), lambda p: "requested", lambda s, p: {"tool_requests": s["tool_requests"] + 1}),
    ),
    "tool.started": Rule(
        (("TOOL_NOT_REQUESTED", lambda s, p: _tool(s, p) == "requested"),),
        _marked("tools", lambda p: p["requestId"], lambda p: "running", lambda s, p: {"processes": s["processes"] + 1}),
    ),
    "tool.completed": Rule(
        (("TOOL_NOT_ACTIVE", lambda s, p: _tool(s, p) in ("requested", "running")),),
        _marked("tools", lambda p: p["requestId"], lambda p: p["status"], lambda s, p: {"processes": max(0, s["processes"] - (_tool(s, p) == "running"))}),
    ),
    "file.changed": Rule(gives=_touching(lambda p: p["paths"])),
    "checkpoint.created": Rule(
        gives=_touching(lambda p: p["changedPaths"], lambda s, p: {"checkpoint_ids": sorted({*s["checkpoint_ids"], p["checkpointId"]}), "changed_bytes": max(s["changed_bytes"], p["totalBytes"])}),
    ),
    "repair.started": Rule(
        (("REPAIR_OUT_OF_STATE", lambda s, p: s["state"] == "repairing"), ("REPAIR_REPEATED", lambda s, p: _attempt(p) not in s["repairs"])),
        _marked("repairs", _attempt, lambda p: ["started", p["receipt"].get("fingerprint")], lambda s, p: {"repair_attempts": s["repair_attempts"] + 1}),
    ),
    "repair.completed": Rule(
        (("REPAIR_NOT_STARTED", lambda s, p: s["repairs"].get(_attempt(p)) == ["started", p["receipt"].get("fingerprint")]),),
        _marked("repairs", _attempt, lambda p: [p["receipt"].get("status", "completed"), p["receipt"].get("fingerprint")]),
    ),
    "review.created": Rule((("REVIEW_OUT_OF_STATE", lambda s, p: s["state"] == "review-ready"),), _touching(lambda p: p["changedPaths"], lambda s, p: {"review_id": p["reviewId"]})),
    "run.completed": Rule((("RECEIPT_OUT_OF_STATE", lambda s, p: s["state"] == "completed"),)),
    "run.failed": Rule((("RECEIPT_OUT_OF_STATE", lambda s, p: s["state"] == "failed"),)),
}
_EMPTY = {c: 0 for c in ("wall_time_ms", "provider_turns", "changed_files", "changed_bytes", "processes", "repair_attempts", "tool_requests", "event_count", "last_sequence")}
_EMPTY |= {"state": "invalid", "event_digest": "", "error": None, "provider_id": None, "review_id": None}


def _first(e: dict, payload: dict) -> tuple[str | None, dict]:
    """(code, state) of the event that opens a run."""
    code = "FIRST_NOT_CREATED" if e["type"] != "run.created" else "FIRST_SEQUENCE" if e["sequence"] != 1 else None
    state = {**_EMPTY, "run_id": e["run_id"], "changed_paths": [], "checkpoint_ids": [], "tools": {}, "repairs": {}, "seen": {}}
    if code is None:
        state |= {"state": "created", "provider_id": payload.get("providerId"), "created": payload.get("createdAt", e["ts"]), "budget": payload.get("budget") or {}}
    return code, state


def _later(s: dict, e: dict, payload: dict) -> tuple[str | None, dict]:
    """(code, what is new in the state) of a further event."""
    expected = s["last_sequence"] + 1
    if e["sequence"] != expected:
        return f"SEQUENCE_GAP: {expected} expected, {e['sequence']} found", {}
    rule = RULES.get(e["type"], Rule())
    code = next((name for name, holds in rule.asks if not holds(s, payload)), None)
    if code:
        return f"{code}: {e['type']} at {e['sequence']} in state {s['state']}", {}
    new = {"wall_time_ms": max(s["wall_time_ms"], _ms(s["created"], e["ts"])), **rule.gives(s, payload)}
    over = next((label for label, used, limit in BUDGETS if s["budget"].get(limit) is not None and new.get(used, s[used]) > s["budget"][limit]), None)
    return (f"BUDGET_EXCEEDED: {over}" if over else None), new


def reduce_run(state: dict | None, events: list[dict], digests: list[str] | None = None) -> dict | None:
    """Events in order of sequence on a state; the first that isn't admitted ends the run with ``error``, the last good state stays.

    An event that came before changes nothing; its id with other contents is an error. ``digests`` collects the digest
    after each event.
    """
    for e in sorted(events, key=lambda x: (x["sequence"], x["event_id"])):
        if state is not None and state["error"]:
            break
        try:
            payload, identity = json.loads(e["payload"]), _identity(e)
            known = state["seen"].get(e["event_id"]) if state else None
            if known == identity[:32]:
                continue
            new = {}
            if known:
                code = "EVENT_ID_REUSED"
            elif state is None:
                code, state = _first(e, payload)
            else:
                code, new = _later(state, e, payload)
        except (KeyError, TypeError, ValueError, AttributeError) as problem:
            code, new = f"PAYLOAD: {problem!r}"[:300], {}
            state = state or {**_EMPTY, "run_id": e["run_id"], "changed_paths": [], "checkpoint_ids": [], "seen": {}}
        if code:
            state["error"] = code
            continue
        state |= new
        state |= {"last_sequence": e["sequence"], "event_count": state["event_count"] + 1, "event_digest": _chained(state["event_digest"], identity)}
        state["seen"][e["event_id"]] = identity[:32]
        if digests is not None:
            digests.append(state["event_digest"])
    return state


def state_frame(states: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{c: s.get(c) for c in STATE_COLUMNS} for s in states], columns=STATE_COLUMNS)


def run_states(events: DataFrame) -> DataFrame:
    """``run_state``: one row per run, its events reduced in order, with the digest after each. A run is a bounded journal; budgets end it."""
    cols = ["event_id", "run_id", "sequence", "ts", "type", "payload", "payload_hash"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        digests: list[str] = []
        return state_frame([{**reduce_run(None, pdf[cols].to_dict("records"), digests), "digests": digests}])

    return events.select(*cols).groupBy("run_id").applyInPandas(one, STATE_DDL)


def journal_manifest_check(events: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifests (run_id, event_count, event_digest) with ``verdict``: current, prefix, or corrupt when the digest at that count differs or the count isn't reached."""
    s = run_states(events).select("run_id", F.col("event_count").alias("replayed"), "digests")
    j = manifests.join(s, "run_id", "left")
    at = F.when((F.col("event_count") >= 1) & (F.col("event_count") <= F.size("digests")), F.element_at("digests", F.col("event_count").cast("int")))
    verdict = F.when(~F.coalesce(at == F.col("event_digest"), F.lit(False)), "corrupt").when(F.col("event_count") == F.col("replayed"), "current").otherwise("prefix")
    return j.select("run_id", "event_count", "event_digest", "replayed", verdict.alias("verdict"))


def run_usage(events: DataFrame) -> DataFrame:
    """Per run by aggregation and a running sum, without replay: wall time, turns, files, bytes, repairs, tool requests, most concurrent processes.

    ``events`` (run_id, sequence, ts timestamp, type, payload).
    """
    g = lambda path: F.get_json_object("payload", path)
    w = W.partitionBy("run_id").orderBy("sequence").rowsBetween(W.unboundedPreceding, 0)
    delta = F.when(F.col("type") == "tool.started", 1).when(F.col("type") == "tool.completed", -1).otherwise(0)
    paths = F.from_json(F.coalesce(g("$.paths"), g("$.changedPaths")), "array<string>")
    e = events.withColumns({"open": F.sum(delta).over(w), "paths": F.when(F.col("type").isin("file.changed", "checkpoint.created", "review.created"), paths)})
    return e.groupBy("run_id").agg(
        (F.unix_millis(F.max(F.col("ts").cast("timestamp"))) - F.unix_millis(F.min(F.col("ts").cast("timestamp")))).alias("wall_time_ms"),
        F.count_if((F.col("type") == "state.changed") & (g("$.to") == "executing")).alias("provider_turns"),
        F.size(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("changed_files"),
        F.coalesce(F.max(F.when(F.col("type") == "checkpoint.created", g("$.totalBytes").cast("long"))), F.lit(0)).cast("long").alias("changed_bytes"),
        F.count_if(F.col("type") == "repair.started").alias("repair_attempts"),
        F.count_if(F.col("type") == "tool.requested").alias("tool_requests"),
        F.greatest(F.max("open"), F.lit(0)).cast("long").alias("max_processes"),
    )


def repair_stops(receipts: DataFrame, budget: int) -> DataFrame:
    """Verification receipts (run_id, sequence, failed_intents[], changed_hashes[]) with ``fingerprint`` and ``stop``: same-fingerprint when the failure was seen before in the run, budget-exhausted from attempt ``budget`` on."""
    fp = F.sha2(F.to_json(F.struct(F.array_sort("failed_intents").alias("failed"), F.array_sort("changed_hashes").alias("changed"))), 256)
    r = receipts.withColumn("fingerprint", fp)
    seen = F.row_number().over(W.partitionBy("run_id", "fingerprint").orderBy("sequence"))
    attempt = F.row_number().over(W.partitionBy("run_id").orderBy("sequence"))
    return r.withColumns({"attempt": attempt, "seen": seen}).withColumn("stop", F.when(F.col("seen") > 1, "same-fingerprint").when(F.col("attempt") >= budget, "budget-exhausted"))
