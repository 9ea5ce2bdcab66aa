"""What large tables asked for: texts read once, work over all cores, pairs met at their rarer end."""

import random

from pyspark.sql import functions as F

from codecorpus.operators import behavior, extract_text, graph, parse, state, storage
from codecorpus.plans import workloads

FILES = "repo string, revision string, path string, content string"


def test_framework_candidates_read_texts_once_and_join_none(spark):
    texts = {"a.py": "from fastapi import FastAPI\nfrom celery import Celery\napp = FastAPI()\njobs = Celery('x')\n@app.get('/x')\ndef home():\n    return 1\n@jobs.task\ndef work():\n    return 2\n", "b.py": "x = 1\n", "pages/api/c.ts": "export default function run() {\n}\n"}
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([("r", "1", p, c) for p, c in texts.items()], FILES).mapInArrow(seen, FILES)
    symbols = spark.createDataFrame([("r", "1", "a.py", "function", "a.py#home:6", "home", 6, 7), ("r", "1", "a.py", "function", "a.py#work:9", "work", 9, 10), ("r", "1", "pages/api/c.ts", "function", "c#run:1", "run", 1, 2)], "repo string, revision string, path string, kind string, symbol_id string, name string, line int, end_line int")
    found, _ = extract_text.framework_candidates(files, symbols)
    got = {(r.framework, r.rule_id, r.line, r.value_label, r.to_id) for r in found.collect()}
    assert got == {("fastapi", "decorator-route", 5, "/x", "a.py#home:6"), ("celery", "task-decorator", 8, "", "a.py#work:9"), ("nextjs", "pages-api-export", 1, "", "c#run:1")}
    assert read.value == len(texts)


def test_a_small_file_is_spread_over_all_cores(spark):
    one = storage.stored(spark.range(500).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("path")).coalesce(1))
    wide = storage.spread(one, ["repo", "path"])
    assert one.rdd.getNumPartitions() == 1 and wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(wide.collect()) == sorted(one.collect())
    assert storage.spread(wide, ["repo", "path"]) is wide


LINK = "repo string, revision string, from_id string, to_id string, kind string"


def random_links(seed, n, m, k):
    r = random.Random(seed)
    return sorted({(f"r{r.randrange(2)}", "1", f"n{r.randrange(n)}", f"n{r.randrange(n)}", f"k{r.randrange(k)}") for _ in range(m)})


def test_nearest_is_the_head_of_reach_and_goes_no_further_than_it_must(spark):
    links = random_links(1, 40, 90, 1)
    edges = spark.createDataFrame(links, LINK)
    starts = edges.select("repo", "revision", F.col("from_id").alias("start")).distinct()
    for levels, most in ((1, 3), (2, 2), (2, 8), (3, 1), (3, 1000)):
        whole = {}
        for r in graph.reach(edges, starts, "down", levels)[0].collect():
            whole.setdefault((r.repo, r.start), []).append((r.depth, r.node))
        got = {}
        for r in graph.nearest(edges, starts, levels, most).collect():
            got.setdefault((r.repo, r.start), []).append((r.depth, r.node))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:most] for k, v in whole.items()}
    # 300 starts of 300 nodes each: their second steps would be 27 million rows
    wide = spark.range(90_000).select(F.lit("r").alias("repo"), F.lit("1").alias("revision"), F.concat(F.lit("s"), (F.col("id") % 300).cast("string")).alias("from_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 300).cast("string")).alias("to_id"), F.lit("k").alias("kind"))
    both = wide.unionByName(wide.select("repo", "revision", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "kind"))
    near = graph.nearest(both, wide.select("repo", "revision", F.col("from_id").alias("start")).distinct(), 2, 100)
    assert {(r.depth, r["count"]) for r in near.groupBy("depth").count().collect()} == {(0, 300), (1, 300 * 99)}


def test_links_within_groups(spark):
    links = random_links(2, 30, 200, 3)
    r = random.Random(3)
    ends = {(f"r{r.randrange(2)}", "1", f"g{r.randrange(6)}", f"n{min(r.randrange(30), r.randrange(30))}") for _ in range(150)}
    got = graph.within(spark.createDataFrame(links, LINK), spark.createDataFrame(sorted(ends), "repo string, revision string, start string, node string"))
    groups = {g for _, _, g, _ in ends}
    want = sorted((*x, g) for x in links for g in groups if (x[0], "1", g, x[2]) in ends and (x[0], "1", g, x[3]) in ends)
    assert sorted(tuple(x) for x in got.select("repo", "revision", "from_id", "to_id", "kind", "start").collect()) == want and want


def test_workflow_sizes_are_those_of_the_lists(spark):
    for seed, n in ((4, 8), (5, 25), (6, 60)):
        links = [(*x, "".join(x)) for x in random_links(seed, n, 120, 2)]
        r = random.Random(seed)
        people = [(f"r{r.randrange(2)}", "1", f"n{r.randrange(6)}", f"n{r.randrange(n)}") for _ in range(60)]
        relations = spark.createDataFrame(links, LINK + ", rel_id string")
        participants = spark.createDataFrame(people, "repo string, revision string, workflow_id string, to_id string")
        lists = {(x.repo, x.workflow_id): len(x.relation_ids) for x in behavior.behavior_workflows(participants, relations).collect()}
        assert {(x.repo, x.workflow_id): x.n for x in behavior.behavior_workflow_sizes(participants, relations).collect()} == lists


def test_an_architecture_parses_over_all_cores(spark, monkeypatch):
    texts = [("r", "1", f"src/f{i}.py", f"def f{i}():\n    return g()\ndef g():\n    return 1\n") for i in range(40)]
    one = storage.stored(spark.createDataFrame(texts, FILES).coalesce(1))
    tasks, whole = [], parse.parse_files
    monkeypatch.setattr(parse, "parse_files", lambda files: tasks.append(files.rdd.getNumPartitions()) or whole(files))
    assert workloads.architecture(one)["calls"].count() == 40
    assert tasks and tasks[0] >= spark.sparkContext.defaultParallelism


def test_state_tokens_read_a_text_once(spark):
    text = "let total = 0\nlet limit = 5\nexport function add(x) {\n  total += x\n  return { limit: [1].map((limit) => limit), total }\n}\nfunction own(limit) {\n  return limit\n}\nclass A { total() { return limit } }\n"
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([("r", "1", "a.ts", text), ("r", "1", "b.ts", "let other = 1\n")], FILES).mapInArrow(seen, FILES)
    variables = spark.createDataFrame([("r", "1", "a.ts", n, n) for n in ("total", "limit")], "repo string, revision string, path string, name string, symbol_id string")
    got = sorted((r.line, r.name, r.operator) for r in state.state_tokens(files, variables).collect())
    assert got == [(4, "total", "+="), (5, "total", ""), (10, "limit", ""), (10, "total", "")]
    assert read.value == 2
    first = state.script_tokens("f(a) {\n  a\n}", {"a"})
    assert [(r[0], r[1], r[2], r[3], r[5], r[13]) for r in first] == [(2, "a", True, 1, 0, None), (4, "{", False, 1, 1, 4), (6, "a", True, 2, 1, 4), (8, "}", False, 3, 1, 4)]
