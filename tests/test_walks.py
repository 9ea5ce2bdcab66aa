"""Walks over many small random graphs at once against plain loops, and the rounds that a long chain takes."""

import random

from pyspark.sql import functions as F

from codecorpus.operators import graph, resolve, storage

EDGE = "repo string, revision string, edge_id string, from_id string, to_id string"


def graphs():
    """Repositories of chains, circles, tails into circles, forks, loops and double edges."""
    out = {}
    for g in range(40):
        r = random.Random(g)
        n = r.randrange(3, 20)
        edges = [(f"c{i}", f"n{i}", f"n{i + 1}") for i in range(n - 1)]
        if g % 3 == 1:
            edges.append(("back", f"n{n - 1}", f"n{r.randrange(n)}"))
        for k in range(r.randrange(0, n // 2 + 1) if g % 2 else 0):
            edges.append((f"x{k:02d}", f"n{r.randrange(n)}", f"n{r.randrange(n)}"))
        if g % 5 == 0:
            edges += [("a-twin", "n0", "n1"), ("loop", "n1", "n1")]
        r.shuffle(edges)
        out[f"g{g:02d}"] = (n, edges)
    return out


def reached(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for _, a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def shortest(edges, start, target):
    """By levels: a node's first parent in order of discovery, then the smallest edge id."""
    way, level = {start: ([start], [])}, [start]
    while target not in way and level:
        nxt = []
        for at in level:
            for e, a, b in sorted(edges):
                if a == at and b not in way:
                    way[b] = (way[at][0] + [b], way[at][1] + [e])
                    nxt.append(b)
        level = nxt
    return way.get(target)


def test_reach_all_and_route_on_random_graphs(spark):
    gs = graphs()
    e = spark.createDataFrame([(g, "1", *x) for g, (_, edges) in gs.items() for x in edges], EDGE)
    starts = [(g, "1", f"n{i}") for g, (n, _) in gs.items() for i in (0, n // 2, n - 1)] + [("g00", "1", "nowhere")]
    s = spark.createDataFrame(starts, "repo string, revision string, start string").distinct()
    for direction in ("down", "up"):
        nodes, edges = graph.reach_all(e, s, direction)
        got = {}
        rows = nodes.collect()
        for r in rows:
            got.setdefault((r.repo, r.start), set()).add(r.node)
        turned = lambda es: es if direction == "down" else [(i, b, a) for i, a, b in es]  # noqa: E731, B023
        assert got == {(g, st): reached(turned(gs[g][1]), st) for g, _, st in starts}
        assert len(rows) == sum(map(len, got.values()))
        assert {(r.repo, r.start, r.edge_id) for r in edges.collect()} == {(g, st, i) for g, _, st in starts for i, a, _ in turned(gs[g][1]) if a in got[g, st]}
    pairs = [(g, "1", f"q{i}-{j}", f"n{i}", f"n{j}") for g, (n, _) in gs.items() for i, j in ((0, n - 1), (n // 2, 0), (n - 1, n // 2), (1, 1), (0, n + 5))]
    p = spark.createDataFrame(pairs, "repo string, revision string, query_id string, start string, target string").distinct()
    got = {(r.repo, r.query_id): (r.nodes, r.edge_ids, r.length) for r in graph.route(e, p).collect()}
    want = {(g, q): shortest(gs[g][1], a, b) for g, _, q, a, b in pairs}
    assert got == {k: (*v, len(v[1])) for k, v in want.items() if v}


def test_a_chain_of_5000_takes_few_rounds(spark, monkeypatch):
    rounds = []
    write = storage.Levels.append
    monkeypatch.setattr(storage.Levels, "append", lambda self, df: rounds.append("level") or write(self, df))
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda *a: rounds.append("stored") or keep(*a))
    e = spark.range(4_999).selectExpr("'r' AS repo", "'1' AS revision", "concat('e', id) AS edge_id", "concat('f', id + 1) AS from_id", "concat('f', id) AS to_id")
    start = spark.createDataFrame([("r", "1", "f4999")], "repo string, revision string, start string")
    nodes, _ = graph.reach_all(e, start)
    assert nodes.count() == 5_000 and len(rounds) <= 20 and rounds.count("level") <= 7
    pair = spark.createDataFrame([("r", "1", "q", "f4999", "f0")], "repo string, revision string, query_id string, start string, target string")
    found = graph.route(e, pair).collect()
    assert found[0].length == 4_999 and found[0].nodes[1234] == f"f{4999 - 1234}"


def test_owners_in_large_files(spark):
    """50,000 short functions and as many points in one file, within long ones: a point meets what is around it and its cell's."""
    n = 50_000
    short = spark.range(n).selectExpr("concat('s', id) AS symbol_id", "CAST(id * 3 + 1 AS INT) AS line", "CAST(id * 3 + 2 AS INT) AS end_line")
    long = spark.range(12).selectExpr("concat('l', id) AS symbol_id", "CAST(1 AS INT) AS line", "CAST(CASE WHEN id = 11 THEN 2147483647 ELSE pow(4, id) END AS INT) AS end_line")
    key = {"repo": F.lit("r"), "revision": F.lit("1"), "path": F.lit("a.py"), "kind": F.lit("function")}
    symbols = short.unionByName(long).withColumns(key)
    points = spark.range(n).selectExpr("CAST(id * 3 + id % 3 + 1 AS INT) AS line", "id").withColumns({k: v for k, v in key.items() if k != "kind"})
    met = resolve._around(points, symbols.withColumnsRenamed({"line": "o_line", "end_line": "o_end"}))
    assert met.count() < 14 * n
    got = {r.id: r.owner_id for r in resolve.owner_at_line(points, symbols).collect()}
    ends = [(4**i, f"l{i}") for i in range(11)] + [(2**31 - 1, "l11")]
    for i in range(0, n, 97):
        line = i * 3 + i % 3 + 1
        assert got[i] == (f"s{i}" if i % 3 < 2 and not (i == 0 and line == 1) else next(o for e, o in ends if e >= line))


def test_owners_of_spans_that_cross(spark):
    r = random.Random(5)
    spans = [("r", "1", "a.py", f"s{i}", "function", a := r.randrange(1, 300), a + r.choice([-1, 0, 2, 9, 70, 200])) for i in range(200)]
    symbols = spark.createDataFrame(spans, "repo string, revision string, path string, symbol_id string, kind string, line int, end_line int")
    points = spark.createDataFrame([("r", "1", "a.py", i) for i in range(520)], "repo string, revision string, path string, line int")
    got = {x.line: x.owner_id for x in resolve.owner_at_line(points, symbols, keep_without=True).collect()}
    for i in range(520):
        around = [(e - a, -a, s) for _, _, _, s, _, a, e in spans if a <= i <= e]
        assert got[i] == (min(around)[2] if around else None)
