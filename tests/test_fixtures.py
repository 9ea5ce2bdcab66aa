"""Small hand-made inputs with exact expected rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codecorpus.operators import behavior, extract_text, filters, graph, metrics, parse, project, resolve, runs, semantic, traces
from codecorpus.plans import workloads
from codecorpus.sources import corpus

FILES = "repo string, revision string, path string, content string"


@pytest.fixture(scope="module")
def files(spark):
    def make(tree):
        return spark.createDataFrame([("r", "1", p, c) for p, c in tree.items()], FILES)

    return make


AGENT = '''from src.targets import exact_call
from src.base import BaseAgent

def run_agent(flag, client):
    if flag:
        exact_call()
    else:
        exact_call()
    # ignored_call()
    note = "ignored_call()"
    for attempt in range(1, 3):
        exact_call()
    client.dynamic_call()

class TradingAgent(BaseAgent):
    def execute(self):
        return self.helper()

    def helper(self):
        return 1
'''
LIB = '''use crate::targets::exact_call;
// ignored_call()
pub fn run(x: i32) {
    let s = "ignored_call()";
    match x {
        1 => exact_call(),
        _ => exact_call(),
    }
    for attempt in 1..=4 {
        exact_call();
    }
}
'''
TREE = {
    "src/__init__.py": "",
    "src/targets.py": "def exact_call():\n    return 1\n",
    "src/base.py": "class BaseAgent:\n    def execute(self):\n        return 0\n",
    "src/agent.py": AGENT,
    "src/targets.rs": "pub fn exact_call() -> i32 { 1 }\n",
    "src/lib.rs": LIB,
    "src/types.rs": "pub trait Runner { fn run(&self); }\npub struct Worker {}\nimpl Runner for Worker {\n    fn run(&self) {\n        self.go();\n    }\n    fn go(&self) {}\n}\n",
}


def test_calls_branches_and_types(spark, files):
    t = workloads.architecture(files(TREE))
    calls = {(r.from_id.split("#")[1].split(":")[0], r.to_id.split("#")[1].split(":")[0], r.from_id.split("#")[0]): r for r in t["calls"].collect()}
    py = calls["run_agent", "exact_call", "src/agent.py"]
    assert [e.line for e in py.evidence] == [6, 8, 12] and py.trust == "inferred" and py.confidence == 0.92
    rs = calls["run", "exact_call", "src/lib.rs"]
    assert [e.line for e in rs.evidence] == [6, 7, 10]
    assert ("execute", "helper", "src/agent.py") in calls and ("run", "go", "src/types.rs") in calls
    assert not any("dynamic_call" in k or "ignored_call" in k for k in calls)
    types = {(r.from_id.split("#")[1].split(":")[0], r.kind, r.to_id.split("#")[1].split(":")[0]) for r in t["relations"].collect()}
    assert {("TradingAgent", "extends", "BaseAgent"), ("execute", "overrides", "execute"), ("Worker", "implements", "Runner")} <= types
    layer = workloads.semantic_layer(t)
    kinds = {(r.kind, r.workflow_id.split("#")[0]) for r in layer["control"].collect()}
    assert ("retries", "src/lib.rs") in kinds and ("branches-to", "src/lib.rs") in kinds
    sites = {(r.path, r.max_attempts) for r in t["sites"].filter("retry_id is not null").collect()}
    assert {("src/agent.py", 2), ("src/lib.rs", 4)} <= sites


def test_typescript_imports_and_component(files):
    tree = {"src/model.ts": "export const model = 1\n", "src/View.tsx": '// import "./gone"\nimport { model } from "./model"\nexport function View() {\n  return <div>{model}</div>\n}\n', "src/index.ts": 'export { View } from "./View"\nimport React from "react"\n'}
    t = workloads.architecture(files(tree))
    edges = {(r.from_id, r.kind, r.to_id, r.evidence[0].line) for r in t["edges"].collect()}
    assert edges == {("src/View.tsx", "imports", "src/model.ts", 2), ("src/index.ts", "exports", "src/View.tsx", 1), ("src/index.ts", "imports", "external:react", 2)}
    assert {(r.name, r.kind) for r in t["symbols"].collect()} >= {("View", "component"), ("model", "variable")}


def test_callables_passed_on(spark):
    keys = "repo string, revision string, "
    invocations = spark.createDataFrame([("r", "1", "invoke", 0, None, "callback", None, None), ("r", "1", "outer", 0, None, "other", None, None), ("r", "1", "invoke", 0, None, None, "outer", "cb")], keys + "callee_id string, position int, name string, symbol_id string, param_owner string, param_name string")
    params = spark.createDataFrame([("r", "1", "invoke", 0, "action"), ("r", "1", "outer", 0, "cb")], keys + "owner_id string, position int, name string")
    through = spark.createDataFrame([("r", "1", "invoke", "action")], keys + "owner_id string, param_name string")
    _, calls = resolve.propagate_callables(invocations, params, through)
    assert {(r.from_id, r.to_id) for r in calls.collect()} == {("invoke", "callback"), ("invoke", "other")}


FLOW = """import functools

def leaf():
    return True

def factory():
    return leaf

def invoke():
    selected = factory()
    selected()
    factory()()

def d1(fn):
    def wrapper1():
        return fn()
    return wrapper1

def d2(fn):
    def wrapper2():
        return fn()
    return wrapper2

@d1
@d2
def decorated():
    return leaf()

def run_decorated():
    decorated()

@functools.cache
def cached():
    return leaf()

def use_cached():
    cached()

class A:
    def run(self):
        return 1

class B:
    def other(self):
        return 2

class C(A, B):
    def go(self):
        super().run()

class E(B, A):
    def go(self):
        super().run()

class Base:
    def execute(self):
        self.hook()

class D1(Base):
    pass

class D2(D1):
    pass

class D3(D2):
    pass

class D4(D3):
    def hook(self):
        return True

    def relay(self):
        super().execute()

class Near(Base):
    def relay(self):
        super().execute()

class Holder:
    def __init__(self):
        self.tool = A()

    def work(self, given: B):
        self.tool.run()
        given.other()
        mine = A()
        mine.run()
        short = leaf
        short()
        me = self
        me.extra()

    def extra(self):
        return 0

def apply(action):
    action()

def start():
    apply(leaf)
    apply(action=factory)
"""


def test_calls_through_values(files):
    t = workloads.architecture(files({"main.py": FLOW}))
    short = {r.symbol_id: r.qualified_name for r in t["symbols"].collect()}
    calls = {(short[r.from_id], short[r.to_id]): ([e.line for e in r.evidence], r.confidence) for r in t["calls"].collect()}
    assert calls["invoke", "leaf"] == ([11, 12], 0.70) and calls["invoke", "factory"][0] == [10, 12]
    assert calls["run_decorated", "d1.wrapper1"][1] == 0.72 and ("run_decorated", "decorated") not in calls
    assert calls["d1.wrapper1", "d2.wrapper2"][1] == 0.76 and calls["d2.wrapper2", "decorated"][1] == 0.76
    assert calls["use_cached", "cached"] == ([FLOW.splitlines().index("    cached()") + 1], 0.72)
    assert calls["C.go", "A.run"][1] == 0.92 and calls["Near.relay", "Base.execute"][1] == 0.92 and calls["Base.execute", "D4.hook"][1] == 0.64
    assert ("E.go", "A.run") not in calls and ("D4.relay", "Base.execute") not in calls  # only the first base is asked
    lines = FLOW.splitlines()
    at = lambda text: lines.index("        " + text) + 1
    assert calls["Holder.work", "A.run"] == ([at("self.tool.run()"), at("mine.run()")], 0.90) and calls["Holder.work", "B.other"][0] == [at("given.other()")]
    assert calls["Holder.work", "leaf"][0] == [at("short()")] and calls["Holder.work", "Holder.extra"][0] == [at("me.extra()")]
    assert calls["apply", "leaf"][1] == 0.76 and calls["apply", "factory"][1] == 0.76


EDGES = [("e-z", "a", "c"), ("e-a", "a", "b"), ("e-b", "b", "d"), ("e-c", "c", "d"), ("e-loop", "d", "a")]


def test_reach_and_route(spark):
    e = spark.createDataFrame([("r", "1", *x) for x in EDGES], "repo string, revision string, edge_id string, from_id string, to_id string")
    start = spark.createDataFrame([("r", "1", "b"), ("r", "1", "nowhere")], "repo string, revision string, start string")
    nodes, edges = graph.reach(e, start, "up")
    assert {r.node for r in nodes.filter("start = 'b'").collect()} == {"a", "b", "c", "d"}
    assert {r.edge_id for r in edges.collect()} == {"e-a", "e-loop", "e-b", "e-c", "e-z"}
    pairs = spark.createDataFrame([("r", "1", "q", "a", "d"), ("r", "1", "same", "a", "a"), ("r", "1", "none", "a", "x")], "repo string, revision string, query_id string, start string, target string")
    got = {r.query_id: (r.nodes, r.edge_ids) for r in graph.route(e, pairs).collect()}
    assert got == {"q": (["a", "b", "d"], ["e-a", "e-b"]), "same": (["a"], [])}


def backbone_by_rule(edges, score, k=12, m=11, d=3):
    """The rule in plain loops: edges (id, a, b, weight)."""
    order = sorted(edges, key=lambda e: (-e[3], e[0]))
    if len(score) <= k and len(edges) <= m:
        return set(score), {e[0] for e in edges}
    shown = set()
    for _, a, b, _ in order:
        if len(shown) + (a not in shown) + (b not in shown) <= k:
            shown |= {a, b}
    for n in sorted(score, key=lambda n: (-score[n], n)):
        if len(shown) < k:
            shown.add(n)
    group, degree, pairs, kept = {n: {n} for n in shown}, dict.fromkeys(shown, 0), set(), set()
    for i, a, b, _ in order:
        if len(kept) < m and {a, b} <= shown and frozenset((a, b)) not in pairs and group[a] is not group[b] and degree[a] < d and degree[b] < d:
            kept.add(i)
            pairs.add(frozenset((a, b)))
            degree[a] += 1
            degree[b] += 1
            both = group[a] | group[b]
            for n in both:
                group[n] = both
    return shown, kept


def test_backbone(spark):
    r = random.Random(3)
    rows = [("r", "1", f"{a}>{b}", f"n{a}", f"n{b}", (100 if a < b else 50) - abs(a - b)) for a in range(20) for b in range(20) if a != b]
    rows += [("few", "1", f"e{i}", f"x{i}", f"x{i + 1}", 5) for i in range(4)] + [("loop", "1", "self", "a", "a", 9)]
    star = [("star", "1", f"h{i:04d}", "hub", "hub2", 10_000) for i in range(3000)] + [("star", "1", f"p{i}", f"p{i}", f"q{i}", 900 - i) for i in range(400)]
    star += [("star", "1", f"c{i}", f"p{i}", f"p{i + 1}", 3) for i in range(4)] + [("star", "1", "far", "hub", "z", 1)]
    mixed = [("mixed", v, f"m{i}", f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.randrange(1, 40)) for v in ("1", "2") for i in range(120)]
    every = rows + star + mixed
    e = spark.createDataFrame(every, "repo string, revision string, edge_id string, from_id string, to_id string, weight long")
    for bounds in ((12, 11, 3), (5, 4, 2), (7, 3, 3)):
        nodes, kept = (x.collect() for x in project.readable_backbone(e, None, *bounds))
        for repo, revision in {(x[0], x[1]) for x in every}:
            own = [x[2:] for x in every if x[:2] == (repo, revision)]
            score: dict = {}
            for _, a, b, w in own:
                score[a], score[b] = score.get(a, 0) + 16 * w, score.get(b, 0) + (16 * w if a != b else 16 * w)
            want_nodes, want_edges = backbone_by_rule(own, score, *bounds)
            got_nodes = [x for x in nodes if (x.repo, x.revision) == (repo, revision)]
            got_edges = [x for x in kept if (x.repo, x.revision) == (repo, revision)]
            assert {x.node_id for x in got_nodes} == want_nodes and {x.edge_id for x in got_edges} == want_edges, (repo, bounds)
            assert all(x.omitted_nodes == len(score) - len(want_nodes) for x in got_nodes) and all(x.omitted_edges == len(own) - len(want_edges) for x in got_edges)
    given = spark.createDataFrame([("r", "1", f"n{i}", float(i)) for i in range(20)] + [("alone", "1", "n", 1.0)], "repo string, revision string, node_id string, score double")
    nodes, kept = project.readable_backbone(e.filter("repo = 'r' and edge_id = '0>1'"), given, 6)
    assert {x.node_id for x in nodes.filter("repo = 'r'").collect()} == {"n0", "n1", "n16", "n17", "n18", "n19"} and nodes.filter("repo = 'alone'").count() == 1


def test_claims(spark):
    doc = json.dumps({"schemaVersion": 1, "claims": [{"subjectId": "component:src", "key": "responsibility", "value": "B", "reason": "x"}]})
    docs = spark.createDataFrame([("r", "1", doc), ("r", "1", doc.replace('"schemaVersion": 1', '"schemaVersion": 2')), ("r", "1", "{"), ("r", "1", None)], "repo string, revision string, document string")
    authored = corpus.parse_authored_claims(docs)
    assert authored.count() == 1
    inferred = spark.createDataFrame([("r", "1", "component:src", "responsibility", "A")], "repo string, revision string, subject_id string, key string, value string")
    claims, questions = semantic.reconcile_claims(inferred, authored)
    assert {(r.trust, r.value, r.status) for r in claims.collect()} == {("inferred", "A", "conflicting"), ("authored", "B", "conflicting")}
    assert [r.recommendation for r in questions.collect()] == ["A"]


def test_traces(spark):
    raw = ["noise", '@trace {"phase":"enter","path":"m.py","symbol":"outer","args":[1]}', '@trace {"phase":"enter","path":"m.py","symbol":"outer"}', '@trace {"phase":"enter","path":"m.py","symbol":"inner"}', '@trace {"phase":"exit","path":"m.py","symbol":"inner","outcome":"ok"}', '@trace {"phase":"exit","path":"m.py","symbol":"outer","outcome":"ok"}', '@trace {"phase":"exit","path":"m.py","symbol":"outer"}']
    lines = spark.createDataFrame([("r", "s", i, i * 10, t) for i, t in enumerate(raw)], "repo string, session_id string, ordinal long, ms long, line string")
    parsed = extract_text.parse_trace_markers(lines)
    assert [r.warning for r in parsed.filter("warning is not null").collect()] == ["WIRE_FIELD_FORBIDDEN"]
    symbols = spark.createDataFrame([("r", "m.py", n, n, "id-" + n, i, i + 5) for i, n in ((1, "outer"), (10, "inner"))], "repo string, path string, name string, qualified_name string, symbol_id string, line int, end_line int")
    markers = parsed.filter("warning is null").select("repo", "session_id", "ordinal", "ms", "marker.*")
    found = traces.resolve_trace_symbols(markers, symbols)
    events = traces.trace_stacks(found)
    good = sorted((r for r in events.collect() if r.warning is None), key=lambda r: r.sequence)
    assert [(r.phase, r.symbol_id, r.parent_symbol_id, r.duration_ms) for r in good] == [("enter", "id-outer", None, None), ("enter", "id-inner", "id-outer", None), ("exit", "id-inner", "id-outer", 10), ("exit", "id-outer", None, 30)]
    assert [r.warning for r in events.collect() if r.warning] == ["TRACE_STACK_MISMATCH"]
    seen = traces.observed_relations(traces.with_durations(events)).collect()
    assert [(r.from_id, r.to_id, r["count"], r.duration_ms) for r in seen] == [("id-outer", "id-inner", 1, 10)]


def test_durations_of_recursive_calls(spark):
    rows = [("s", i, ms, phase, symbol, None) for i, (ms, phase, symbol) in enumerate([(0, "enter", "A"), (10, "enter", "A"), (15, "exit", "A"), (20, "enter", "B"), (100, "exit", "A"), (110, "enter", "B"), (140, "error", "B")])]
    events = traces.trace_stacks(spark.createDataFrame(rows, "session_id string, ordinal long, ms long, phase string, symbol_id string, outcome string"))
    got = {r.sequence: (r.symbol_id, r.duration_ms, r.outcome) for r in traces.with_durations(events).filter("phase = 'enter'").collect()}
    assert got == {1: ("A", 100, "ok"), 2: ("A", 5, "ok"), 4: ("B", None, "unknown"), 6: ("B", 30, "error")}


def _event(n, kind, payload, run="run"):
    text = runs.canonical(json.dumps(payload))
    import hashlib

    return {"event_id": f"{run}-{n}", "run_id": run, "sequence": n, "ts": f"2026-01-01T00:00:{n:02d}Z", "type": kind, "payload": text, "payload_hash": hashlib.sha256(text.encode()).hexdigest()}


def journal(run="run"):
    move = lambda a, b: ("state.changed", {"from": a, "to": b})
    steps = [
        ("run.created", {"runId": run, "createdAt": "2026-01-01T00:00:01Z", "budget": {"maxChangedFiles": 5}, "providerId": "p"}), move("created", "context-planning"), move("context-planning", "planning"), ("plan.created", {"plan": {}}), move("planning", "executing"),
        ("file.changed", {"paths": ["b", "a", "b"]}), move("executing", "verifying"), ("verification.completed", {"receipt": {}}), move("verifying", "review-ready"), ("review.created", {"reviewId": "rv", "changeSetIds": [], "changedPaths": ["a"]}),
    ]
    return [_event(i, k, p, run) for i, (k, p) in enumerate(steps, 1)]


EVENT_DDL = "event_id string, run_id string, sequence long, ts string, type string, payload string, payload_hash string"
EVENT_COLUMNS = [x.split()[0] for x in EVENT_DDL.split(", ")]


def frame(spark, events):
    return spark.createDataFrame([tuple(e[c] for c in EVENT_COLUMNS) for e in events], EVENT_DDL)


def test_run_states(spark):
    events = journal()
    bad = journal("bad")
    bad[4] = _event(5, "state.changed", {"from": "planning", "to": "completed"}, "bad")
    gap = [e for e in journal("gap") if e["sequence"] != 3]
    df = frame(spark, events + events[:1] + bad + gap)
    got = {r.run_id: r for r in runs.run_states(df).collect()}
    r = got["run"]
    assert (r.state, r.event_count, r.changed_paths, r.provider_turns, r.wall_time_ms, r.error) == ("review-ready", 10, ["a", "b"], 1, 9000, None) and len(r.event_digest) == 64
    assert got["bad"].error.startswith("TRANSITION_NOT_ALLOWED") and got["bad"].last_sequence == 4
    assert got["gap"].error.startswith("SEQUENCE_GAP")
    assert runs.validate_run_events(frame(spark, events)).filter("problem is not null").count() == 0
    tampered = [{**events[1], "payload": '{"from":"created","to":"failed"}'}, {**events[2], "type": "odd"}]
    assert sorted(x.problem for x in runs.validate_run_events(frame(spark, tampered)).collect()) == ["PAYLOAD_HASH", "TYPE_UNKNOWN"]
    manifests = spark.createDataFrame([("run", 10, r.digests[9]), ("run", 4, r.digests[3]), ("run", 4, "x")], "run_id string, event_count long, event_digest string")
    assert [x.verdict for x in runs.journal_manifest_check(df, manifests).orderBy("event_digest").collect()].count("corrupt") == 1


def test_run_rules(spark):
    def ending(*steps, budget=None):
        first = ("run.created", {"runId": "x", "createdAt": "2026-01-01T00:00:01Z", "budget": budget or {}, "providerId": "p"})
        return runs.reduce_run(None, [_event(i, k, p, "x") for i, (k, p) in enumerate([first, *steps], 1)])

    move = lambda *states: [("state.changed", {"from": a, "to": b}) for a, b in zip(states, states[1:])]
    tool = [("tool.requested", {"request": {"id": "t"}}), ("tool.started", {"requestId": "t", "startedAt": ""}), ("tool.completed", {"requestId": "t", "status": "ok", "completedAt": ""})]
    done = ending(*tool)
    assert (done["tool_requests"], done["processes"], done["tools"], done["error"]) == (1, 0, {"t": "ok"}, None)
    assert ending(tool[1])["error"].startswith("TOOL_NOT_REQUESTED") and ending(tool[0], tool[0])["error"].startswith("TOOL_REPEATED")
    assert ending(*tool, tool[2])["error"].startswith("TOOL_NOT_ACTIVE")
    to_repair = move("created", "context-planning", "executing", "verifying", "repairing")
    start, good, other = (("repair." + k, {"receipt": {"attempt": 1, "fingerprint": f}}) for k, f in (("started", "f"), ("completed", "f"), ("completed", "g")))
    assert ending(*to_repair, start, good)["repair_attempts"] == 1 and ending(*to_repair, start, good)["error"] is None
    assert ending(*to_repair, start, other)["error"].startswith("REPAIR_NOT_STARTED") and ending(start)["error"].startswith("REPAIR_OUT_OF_STATE")
    assert ending(("provider.session", {"session": {"providerId": "q"}}))["error"].startswith("PROVIDER_MISMATCH")
    assert ending(("file.changed", {"paths": ["a", "b"]}), budget={"maxChangedFiles": 1})["error"] == "BUDGET_EXCEEDED: changed files"
    failed = ending(*move("created", "failed"), ("run.failed", {"error": "e", "completedAt": ""}))
    assert (failed["state"], failed["error"], failed["event_count"]) == ("failed", None, 3)
    assert ending(("run.completed", {"response": "", "completedAt": ""}))["error"].startswith("RECEIPT_OUT_OF_STATE")
    assert ending(("file.changed", {}))["error"].startswith("PAYLOAD") and ending()["state"] == "created"
    again = [_event(1, "run.created", {"runId": "x", "createdAt": "2026-01-01T00:00:01Z", "budget": {}}, "x")]
    assert runs.reduce_run(None, again * 2)["event_count"] == 1
    assert runs.reduce_run(None, [*again, {**_event(2, "plan.created", {"plan": {}}, "x"), "event_id": "x-1"}])["error"] == "EVENT_ID_REUSED"


def test_streams_agree_with_batch(spark, tmp_path):
    from codecorpus.streaming import flows

    events = journal() + journal("two")
    for i in (0, 1):
        frame(spark, events[i::2]).coalesce(1).write.mode("append").json(str(tmp_path / "runs"))
    whole = frame(spark, events)
    stream = flows.run_stream(spark.readStream.schema(EVENT_DDL).json(str(tmp_path / "runs")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("run_rows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    assert q.awaitTermination(60)
    cols = ["run_id", "state", "event_count", "event_digest"]
    assert sorted(map(tuple, spark.table("run_rows").select(*cols).collect())) == sorted(map(tuple, runs.run_states(whole).select(*cols).collect()))
    rows = [("s", i, i * 5, p, s, None) for i, (p, s) in enumerate([("enter", "a"), ("enter", "b"), ("exit", "b"), ("error", "a")])]
    ddl = "session_id string, ordinal long, ms long, phase string, symbol_id string, outcome string"
    calls = spark.createDataFrame(rows, ddl)
    calls.coalesce(1).write.json(str(tmp_path / "calls"))
    writer = flows.trace_stream(spark.readStream.schema(ddl).json(str(tmp_path / "calls"))).writeStream.outputMode("append").format("memory").queryName("trace_rows")
    q = writer.trigger(once=True).option("checkpointLocation", str(tmp_path / "c2")).start()  # its timeout would keep availableNow going
    assert q.awaitTermination(60)
    key = lambda r: (r.sequence or 0, r.phase or "")
    assert sorted(map(tuple, sorted(spark.table("trace_rows").collect(), key=key)), key=str) == sorted(map(tuple, traces.trace_stacks(calls).collect()), key=str)


def test_file_changes_stream(spark, tmp_path):
    from codecorpus.streaming import flows

    ddl = "repo string, path string, size long, mtime long, content string, changed_at long"
    parse_ = lambda df: df.select("repo", "path", "size", "mtime", F.sha2("content", 256).alias("hash"))
    source = str(tmp_path / "changes")
    spark.createDataFrame([("r", "a", 1, 1, "x", 1), ("r", "a", 2, 2, "xy", 2), ("r", "b", 1, 1, "b", 1), ("q", "c", 1, 1, "c", 1)], ddl).coalesce(1).write.mode("append").json(source)
    for number in (0, 1):
        if number:
            spark.createDataFrame([("r", "a", 3, 3, "xyz", 3), ("r", "b", None, None, None, 3)], ddl).coalesce(1).write.mode("append").json(source)
        q = flows.apply_file_changes(spark.readStream.schema(ddl).json(source), str(tmp_path / "index"), parse_, str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        got = {(r.repo, r.path, r.size) for r in flows.latest_index(spark, str(tmp_path / "index")).collect()}
        assert got == ({("r", "a", 2), ("r", "b", 1), ("q", "c", 1)}, {("r", "a", 3), ("q", "c", 1)})[number]
    assert [(r.repo, r.path) for r in spark.read.parquet(str(tmp_path / "index" / "segments" / "1" / "rows")).collect()] == [("r", "a")]


def test_index_survives_a_crash_and_is_compacted(spark, tmp_path, monkeypatch):
    from codecorpus.sources import index as I
    from codecorpus.streaming import flows

    monkeypatch.setattr(I, "COMPACT", 3)
    monkeypatch.setattr(I, "KEEP", 1)
    ddl = "repo string, path string, root string, size long, mtime long, content string, changed_at long"
    path, state = str(tmp_path / "index"), {}
    found = lambda: {r.path: r.size for r in flows.latest_index(spark, path).collect()}
    for number in range(5):
        rows = [("r", "same", "/r", 1, 1, "x", number), ("r", f"f{number % 3}", "/r", number, number, "y", number)] + ([("r", "f0", "/r", None, None, None, number)] if number == 4 else [])
        batch = spark.createDataFrame(rows, ddl)
        parse_ = lambda df: df.select("repo", "path", "size", "mtime")
        if number == 4:  # the rows are written, the manifest isn't
            with monkeypatch.context() as m:
                m.setattr(I.FileIndex, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError):
                    flows.fold_file_changes(batch, number, path, parse_)
            assert found() == state
        for _ in range(2):  # a batch that runs again changes nothing
            flows.fold_file_changes(batch, number, path, parse_)
            state = {k: v for k, v in (state | {"same": 1, f"f{number % 3}": number}).items() if not (number == 4 and k == "f0")}
            assert found() == state
    assert {r.root for r in flows.latest_index(spark, path).collect()} == {"/r"}
    assert flows.latest_index(spark, path, analyzer_version="2") is None
    assert len(list((tmp_path / "index" / "segments").iterdir())) <= 5


def test_search(spark, monkeypatch):
    long = "x" * 100 + " needle " + "y" * 300
    f = spark.createDataFrame([("r", "1", "notes.txt", "\ufeffİ [LITERAL] and [literal]\r\nno"), ("r", "1", "b.txt", f"aaa\n{long}\r\nΣΟΦΟΣ straſse"), ("r", "1", "none.txt", None), ("r", "1", "empty.txt", "")], FILES)
    queries = [("q", "[literal]"), ("a", "aa"), ("n", "NEEDLE"), ("g", "σοφος"), ("s", "STRASSE"), ("two", "no\nno"), ("same", "needle"), ("empty", "")]
    q = spark.createDataFrame(queries, "query_id string, query string")
    want = {("q", 1, 3), ("q", 1, 17), ("a", 1, 1), ("n", 2, 102), ("same", 2, 102), ("g", 3, 1), ("s", 3, 7)}
    for block in (50_000, 2):
        monkeypatch.setattr(extract_text, "QUERY_BLOCK", block)
        got = extract_text.search_text(f, q).collect()
        assert {(r.query_id, r.line, r.column) for r in got} == want and len(got) == len(want)
        assert next(r.preview for r in got if r.query_id == "n") == "…" + long[41:327] + "…"
    s = spark.createDataFrame([("r", "1", "i1", "runAllRun", "function", "a.py", 1), ("r", "1", "i2", "other", "function", "a.py", 2)], "repo string, revision string, symbol_id string, name string, kind string, path string, line int")
    assert [(r.query_id, r.symbol_id) for r in extract_text.search_symbols(s, spark.createDataFrame([("x", "RUN"), ("y", "zz")], "query_id string, query string")).collect()] == [("x", "i1")]


def test_frameworks(files):
    tree = {
        "api.py": "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/users')\ndef users():\n    pass\n@app.post(dynamicPath)\ndef other():\n    pass\napp.add_api_route('/x', users)\napp.add_api_route('/y', make())\n",
        "server.ts": "import express from \"express\"\nconst app = express()\nfunction home() {\n  return 1\n}\napp.get('/home', home)\napp.post('/dyn', () => 1)\n",
        "server.rs": "use axum::Router;\nasync fn home() {\n}\nfn main() {\n    let r = Router::new().route(\"/\", get(home));\n    let s = Router::new().route(path, get(home));\n}\n",
    }
    f = files(tree)
    found, excluded = extract_text.framework_candidates(f, parse.extract_symbols(f))
    got = {(r.framework, r.rule_id, r.value_label, r.to_id.split("#")[1].split(":")[0]) for r in found.collect()}
    assert got == {("fastapi", "decorator-route", "/users", "users"), ("fastapi", "add-api-route", "/x", "users"), ("express", "route-registration", "/home", "home"), ("axum", "router-route", "/", "home")}
    assert {(r.framework, r.line) for r in excluded.collect()} >= {("fastapi", 6), ("fastapi", 10), ("express", 7), ("axum", 6)}
    cover = behavior.framework_coverage(extract_text.detect_frameworks(f), found, excluded, ["fastapi", "celery"])
    assert {(r.framework, r.detected_files, r.candidates) for r in cover.collect()} == {("fastapi", 1, 2), ("celery", 0, 0)}


def test_behavior(files):
    tree = {"agent.py": "def validate(value, strict):\n    return value\n\ndef run(order):\n    validate(order, strict=True)\n    validate(*order)\n", "flow.ts": "function normalize(x) {\n  return x\n}\nfunction execute(order) {\n  const y = normalize(order)\n  return y\n}\n"}
    f = files(tree)
    t = workloads.architecture(f)
    sites = workloads.resolved_sites(t)
    passes = {r.label for r in behavior.behavior_passes(sites, t["symbols"]).collect()}
    assert passes == {"order -> value", "True -> strict", "order -> x"}
    back = [(r.from_id.split("#")[1].split(":")[0], r.to_id.split("#")[1].split(":")[0]) for r in behavior.behavior_returns(sites, t["symbols"], f).collect()]
    assert back == [("normalize", "execute")]


def test_bad_sites_are_refused_whole(files):
    tree = {"a.py": "def f(x, y):\n    return x\n\ndef run(v):\n    f(v, z=1)\n    f(v, x=2)\n    f(x=v, y)\n    f(v, 1, 2)\n    f(y=v)\n"}
    t = workloads.architecture(files(tree))
    assert {r.label for r in behavior.behavior_passes(workloads.resolved_sites(t), t["symbols"]).collect()} == {"v -> y"}


def test_scope_metrics(spark):
    ddl = "case_id string, selected_paths array<string>, changed_paths array<string>, required_paths array<string>, forbidden_paths array<string>, commands array<string>, expected_verification_passed boolean"
    cases = spark.createDataFrame([("a", ["x"], ["x"], ["x", "q"], ["bad"], ["make "], True), ("b", [], [], [], [], [], True)], ddl)
    out = "case_id string, provider_id string, selected_paths array<string>, planned_paths array<string>, changed_paths array<string>, commands array<string>, verification_passed boolean, verification_runs int"
    outputs = spark.createDataFrame([("a", "p", ["x", "bad"], [], ["bad"], [" make"], True, 3), ("b", "p", [], [], [], [], True, 1), ("a", "q", [], None, ["x"], ["rm"], False, 4)], out)
    got = {(r.case_id, r.provider_id): r for r in metrics.scope_metrics(outputs, cases).collect()}
    r = got["a", "p"]
    assert (r.context_precision, r.context_recall, r.plan_precision, r.changed_precision) == (0.5, 1.0, 0.0, 0.0)
    assert (r.forbidden, r.missing_required, r.out_of_scope, r.command_violations, r.bounded_verification, r.passed) == (1, 1, 1, 0, True, False)
    assert (got["b", "p"].context_precision, got["b", "p"].plan_precision, got["b", "p"].passed) == (1.0, 1.0, True)
    r = got["a", "q"]
    assert (r.context_precision, r.missing_required, r.command_violations, r.verification_accurate, r.bounded_verification) == (0.0, 2, 1, False, False)


def test_ignores_and_eligibility(spark):
    rows = [("r", "1", p, "x") for p in ("a.log", "keep.log", "src/a.log", "src/b.tmp", "node_modules/x.js", "src/out.txt", "build.txt")] + [("r", "1", "bin.png", "x"), ("r", "1", "nul.txt", "a\0b"), ("r", "1", "none.txt", None)]
    f = spark.createDataFrame(rows, FILES)
    rules = filters.ignore_rules(spark.createDataFrame([("r", "1", ".gitignore", "*.log\n!keep.log\n"), ("r", "1", "src/.gitignore", "/b.*\n"), ("r", "2", ".gitignore", "*.txt\n")], FILES))
    assert {r.path for r in filters.apply_ignores(f, rules).collect()} == {"keep.log", "src/out.txt", "build.txt", "bin.png", "nul.txt", "none.txt"}
    why = {r.path: r.skip_reason for r in filters.eligible_text(f.withColumn("size", F.lit(1))).collect()}
    assert (why["bin.png"], why["nul.txt"], why["none.txt"], why["a.log"]) == ("binary-extension", "nul-byte", "invalid-utf8", None)


def test_sources_round_trip(spark, tmp_path):
    root = tmp_path / "trees"
    (root / "one" / "src").mkdir(parents=True)
    (root / "one" / "src" / "a.py").write_text("x = 1\n")
    (root / "one" / "bad.txt").write_bytes(b"\xff\xfe")
    got = {r.path: r for r in corpus.read_corpus(spark, str(root)).collect()}
    assert got["src/a.py"].repo == "one" and got["src/a.py"].content == "x = 1\n" and got["bad.txt"].content is None
    nodes = spark.createDataFrame([("r", "1", "n")], "repo string, revision string, node_id string")
    corpus.write_snapshot({"nodes": nodes}, str(tmp_path / "snap"))
    assert corpus.read_snapshot(spark, str(tmp_path / "snap"), "nodes").count() == 1
    with pytest.raises(Exception):
        corpus.write_snapshot({"nodes": nodes}, str(tmp_path / "snap"))
    (tmp_path / "j.jsonl").write_text('{"event_id":"a","run_id":"r","sequence":1}\nnot json\n')
    j = corpus.read_run_journal(spark, str(tmp_path / "j.jsonl")).cache()
    assert corpus.journal_diagnostics(j).count() == 1 and j.filter("event_id = 'a'").count() == 1
    case = tmp_path / "cases" / "c1"
    case.mkdir(parents=True)
    (case / "callgraph.json").write_text('{"a":["b","c"],"b":[]}')
    edges, declared = corpus.read_call_oracle(spark, str(tmp_path / "cases" / "*" / "callgraph.json"))
    assert {(r.case_id, r.from_name, r.to_name) for r in edges.collect()} == {("c1", "a", "b"), ("c1", "a", "c")} and declared.count() == 2


def test_reading_leaves_out_what_is_not_wanted(spark, tmp_path):
    from codecorpus.operators.filters import BINARY, IGNORED_FOLDERS

    root = tmp_path / "trees"
    for name, size in {"a/src/x.py": 10, "a/src/build.py": 20, "a/node_modules/m/y.js": 40_000, "a/build/z.py": 50_000, "b/big.py": 3_000, "b/logo.PNG": 60_000, "b/q r.py": 5}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * size)
    df = corpus.read_corpus(spark, str(root), skip_folders=IGNORED_FOLDERS, max_bytes=2_000, skip_names=BINARY)
    assert {(r.repo, r.path, r.size) for r in df.collect()} == {("a", "src/x.py", 10), ("a", "src/build.py", 20), ("b", "q r.py", 5)}
    # the files in folders and with names that aren't wanted are no part of the scan
    df.select("hash").collect()
    plan = df.select("hash")._jdf.queryExecution()
    plan.executedPlan().executeCollect()
    scan = plan.executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 4 and scan.metrics().apply("filesSize").value() == 10 + 20 + 3_000 + 5


def test_evaluation_folders(spark, tmp_path):
    from codecorpus.operators import evaluation

    for case, wanted in (("ok", "src/a b.py"), ("lost", "src/none.py")):
        folder = tmp_path / "cases" / case
        (folder / "project" / "src").mkdir(parents=True)
        (folder / "project" / "src" / "a b.py").write_text("x = 1")
        for name, value in {"request": {"goal": "g", "mode": "ask"}, "expected-scope": {"selectedPaths": [wanted], "changedPaths": []}, "assertions": {"requiredPaths": [], "forbiddenPaths": [], "verificationPassed": True}, "allowed-commands": {"commands": ["make"]}}.items():
            (folder / f"{name}.json").write_text(json.dumps(value, indent=1))
    cases, inventory = corpus.read_eval_folders(spark, str(tmp_path / "cases"))
    good, refused = evaluation.check_cases(cases, inventory)
    assert [(r.case_id, r.selected_paths, r.expected_verification_passed) for r in good.collect()] == [("ok", ["src/a b.py"], True)]
    assert [tuple(r) for r in refused.collect()] == [("lost", "EVALUATION_PATH_NOT_IN_INVENTORY", "src/none.py")]


def test_a_reading_with_an_index_parses_changed_files_only(spark, files, tmp_path, monkeypatch):
    from codecorpus.operators import parse as P
    from codecorpus.sources.index import FileIndex

    index, parsed = FileIndex(spark, str(tmp_path / "index")), []
    real = P.parse_files
    monkeypatch.setattr(P, "parse_files", lambda df, *a: parsed.append(sorted(r.path for r in df.select("path").collect())) or real(df, *a))
    tree = {"a.py": "def a():\n    return 1\n", "b.py": "from a import a\ndef b():\n    return a()\n", "c.py": "def c():\n    pass\n"}
    calls = lambda t: {(r.from_id, r.to_id) for r in workloads.architecture(files(t), index)["calls"].collect()}
    assert calls(tree) == {("b.py#b:2", "a.py#a:1")}
    assert calls(tree) == {("b.py#b:2", "a.py#a:1")}
    tree = {"a.py": "\n" + tree["a.py"], "b.py": tree["b.py"], "d.py": "def d():\n    return d2()\ndef d2():\n    return 1\n"}
    assert calls(tree) == {("b.py#b:2", "a.py#a:2"), ("d.py#d:1", "d.py#d2:3")}
    assert parsed == [["a.py", "b.py", "c.py"], ["a.py", "d.py"]]
    assert {r.path for r in index.rows().collect()} == {"a.py", "b.py", "d.py"}
