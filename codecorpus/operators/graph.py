"""Graph walks as joins level by level; each level is stored, and a walk ends when a level is empty.

Where nodes have one way on only, walks jump: tables of jumps of 1 to 7 times 8^k steps lead over a chain of n nodes in
about log8(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.operators.storage import Levels, release, stored

KEYS = ["repo", "revision"]
#: Levels of a walk that are read as they were written, before they become one table.
MERGE_LEVELS = 16


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, external: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each seed: the seed, its direct edges both ways, their other ends. ``seeds`` (keys, seed).

    Nodes carry ``seed``, edges ``seed`` and ``direction``; external nodes come only on request.
    """
    s = seeds.select(*KEYS, "seed").distinct()
    known = nodes.select(*KEYS, "node_id", "kind")
    usable = known if external else known.filter("kind != 'external'")
    out = edges.join(s.withColumnRenamed("seed", "from_id"), [*KEYS, "from_id"]).withColumns({"seed": F.col("from_id"), "direction": F.lit("outgoing")})
    inc = edges.join(s.withColumnRenamed("seed", "to_id"), [*KEYS, "to_id"]).withColumns({"seed": F.col("to_id"), "direction": F.lit("incoming")})
    near = out.unionByName(inc)
    near = near.withColumn("other", F.when(F.col("direction") == "outgoing", F.col("to_id")).otherwise(F.col("from_id")))
    near = near.join(usable.select(*KEYS, F.col("node_id").alias("other")), [*KEYS, "other"], "left_semi")
    ids = near.select(*KEYS, "seed", F.col("other").alias("node_id")).unionByName(s.select(*KEYS, "seed", F.col("seed").alias("node_id"))).distinct()
    return ids.join(nodes, [*KEYS, "node_id"]), near.drop("other")


#: Nodes whose hashes may be broadcast (24 MB).
FEW = 1_000_000


def likely(df: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """``df`` without rows whose ``ends`` can't be among ``nodes`` (keys, node): dropped where they lie, by hashes, so that they cross no shuffle.

    A few rows too many may stay, all of them where there are more than FEW nodes: what follows looks nodes up itself.
    """
    of = lambda c: F.xxhash64(*KEYS, c)
    known = stored(nodes.select(of("node").alias("_hash")).distinct(), "hashes")
    if known.count() > FEW:
        return df
    for c in ends:
        df = df.join(F.broadcast(known.withColumnRenamed("_hash", f"_{c}")), of(c) == F.col(f"_{c}"), "left_semi")
    return df


def within(links: DataFrame, ends: DataFrame, group: str = "start") -> DataFrame:
    """``links`` with each ``group`` of ``ends`` (keys, group, node; no row twice) that has both their ends: one row for each link and group.

    A link meets the groups of that end which is in fewer of them: a node of very many groups costs nothing where the other end is in few.
    """
    many = stored(ends.groupBy(*KEYS, "node").agg(F.count("*").alias("n")), "groups-of-nodes")
    groups = lambda c: many.select(*KEYS, F.col("node").alias(c), F.col("n").alias(f"_{c}"))
    known = likely(links, many, "from_id", "to_id").join(groups("from_id"), [*KEYS, "from_id"]).join(groups("to_id"), [*KEYS, "to_id"])
    known = stored(known, "links-of-groups")
    release(known.sparkSession)

    def met(some, near, far):
        at = some.join(ends.withColumnRenamed("node", near), [*KEYS, near])
        return at.join(ends.withColumnRenamed("node", far), [*KEYS, group, far], "left_semi").select(*links.columns, group)

    return met(known.filter("_from_id <= _to_id"), "from_id", "to_id").unionByName(met(known.filter("_from_id > _to_id"), "to_id", "from_id"))


def nearest(edges: DataFrame, starts: DataFrame, levels: int, most: int) -> DataFrame:
    """The first ``most`` nodes (start, node, depth) of each start by depth and node, its own first, at most ``levels`` steps down.

    As reach, but a start that has enough nodes goes no further, and of a level no more than ``most`` of a start are kept.
    """
    order = W.partitionBy(*KEYS, "start").orderBy("node")
    seen = stored(starts.select(*KEYS, "start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "nearest")
    front = seen
    for depth in range(1, levels + 1):
        step = likely(edges.select(*KEYS, F.col("from_id").alias("at"), F.col("to_id").alias("node")), front, "at")
        nxt = front.select(*KEYS, "start", F.col("node").alias("at")).join(step, [*KEYS, "at"]).select(*KEYS, "start", "node")
        # fewer than ``most`` of a start are known, so the first 2 * most have enough new ones; cut where they lie
        nxt = nxt.withColumn("k", F.dense_rank().over(order)).filter(F.col("k") <= 2 * most).select(*KEYS, "start", "node").distinct()
        new = nxt.join(seen.select(*KEYS, "start", "node"), [*KEYS, "start", "node"], "left_anti")
        new = new.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")
        new = stored(new.withColumn("depth", F.lit(depth)), "nearest")
        release(new.sparkSession)
        seen = seen.unionByName(new)
        hungry = seen.groupBy(*KEYS, "start").agg(F.count("*").alias("n")).filter(F.col("n") < most).select(*KEYS, "start")
        front = stored(new.join(hungry, [*KEYS, "start"], "left_semi"), "front")
        if front.isEmpty():
            break
    first = W.partitionBy(*KEYS, "start").orderBy("depth", "node")
    return seen.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= most).drop("k")


def reach(edges: DataFrame, starts: DataFrame, direction: str = "down", levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reached from each start: nodes (start, node, depth), and every edge that leaves (enters) a reached node.

    ``starts`` (keys, start); ``levels`` limits the depth (strict k-hop), None goes on to the end.
    """
    a, b = ("from_id", "to_id") if direction == "down" else ("to_id", "from_id")
    step = stored(edges.select(*KEYS, F.col(a).alias("at"), F.col(b).alias("node")).distinct())
    seen, merged = stored(starts.select(*KEYS, "start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()), 0
    front, depth = seen, 0
    while levels is None or depth < levels:
        depth += 1
        nxt = front.select(*KEYS, "start", F.col("node").alias("at")).join(step, [*KEYS, "at"]).select(*KEYS, "start", "node").distinct()
        front = stored(nxt.join(seen, [*KEYS, "start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)  # levels stay as they were written, and become one table now and then
        if depth - merged >= MERGE_LEVELS:
            seen, merged = stored(seen), depth
    touched = edges.join(seen.select(*KEYS, "start", F.col("node").alias(a)), [*KEYS, a])
    return seen, touched


#: A jump table has jumps of 1 to RADIX - 1 times RADIX^level steps.
RADIX = 8
FREE = 99


def chain_jumps(steps: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(jumps, endless) of ``steps`` (by, at, node), one way on for each node: jumps (by, at, node, hops, level), and the nodes (by, at) whose way never ends, which have none.

    Each level is made of the one before by RADIX - 1 joins and stored: about log8 of the number of steps rounds.
    """
    one = stored(steps.select(*by, "at", "node"), "steps")
    total, reach_, level, parts = one.count(), 1, 0, []
    way = one
    while reach_ <= total and not way.isEmpty():
        wide = way.withColumnRenamed("node", "n1")
        for i in range(2, RADIX + 1):
            wide = wide.join(way.select(*by, F.col("at").alias(f"n{i - 1}"), F.col("node").alias(f"n{i}")), [*by, f"n{i - 1}"], "left")
        wide = stored(wide, "jumps")
        jumps = wide.select(*by, "at", F.posexplode(F.array(*[f"n{i}" for i in range(1, RADIX)])).alias("i", "node")).filter("node is not null")
        parts.append(jumps.select(*by, "at", "node", ((F.col("i") + 1) * reach_).cast("long").alias("hops"), F.lit(level).alias("level")))
        way = wide.filter(f"n{RADIX} is not null").select(*by, "at", F.col(f"n{RADIX}").alias("node"))
        reach_, level = reach_ * RADIX, level + 1
    endless = way.select(*by, "at") if reach_ > total else way.limit(0).select(*by, "at")
    out = one.select(*by, "at", "node", F.lit(1).cast("long").alias("hops"), F.lit(0).alias("level")).limit(0)
    for part in parts:
        out = out.unionByName(part)
    return stored(out.join(endless, [*by, "at"], "left_anti"), "jumps"), endless


def chain_walk(jumps: DataFrame, starts: DataFrame, by: list[str], ids: list[str]) -> DataFrame:
    """``(by, ids, node, dist)``: all nodes on the way on from each of ``starts`` (by, ids, node), with their distance.

    Longer jumps come before shorter ones, so every node is met once.
    """
    front = starts.select(*by, *ids, "node", F.lit(0).cast("long").alias("dist"), F.lit(FREE).alias("cap"))
    found = Levels(front, "walk")
    while not found.last.isEmpty():
        at = found.last.withColumnRenamed("node", "at").join(jumps, [*by, "at"]).filter("level < cap")
        found.append(at.select(*by, *ids, "node", (F.col("dist") + F.col("hops")).alias("dist"), F.col("level").alias("cap")))
    return found.table().drop("cap")


def _ways(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chain, jumps) of edges ``step`` (keys, at, node): the nodes with one way on that comes to an end, and their jumps."""
    single = step.groupBy(*KEYS, "at").agg(F.count_distinct("node").alias("n"), F.min("node").alias("node")).filter("n = 1 and at != node").select(*KEYS, "at", "node")
    single = stored(single, "single-ways")
    jumps, endless = chain_jumps(single, KEYS)
    return single.join(endless, [*KEYS, "at"], "left_anti"), jumps


def reach_all(edges: DataFrame, starts: DataFrame, direction: str = "down") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) reached from each start, to the end: nodes (start, node), and every edge that leaves (enters) a reached node.

    As reach without depths, in fewer rounds: where there is one way on only, a round takes all jumps of a length below that of the
    last jump; elsewhere it takes every edge.
    """
    a, b = ("from_id", "to_id") if direction == "down" else ("to_id", "from_id")
    step = stored(edges.select(*KEYS, F.col(a).alias("at"), F.col(b).alias("node")).distinct(), "step")
    chain, jumps = _ways(step)
    forks = stored(step.join(chain.select(*KEYS, "at"), [*KEYS, "at"], "left_anti"), "forks")
    found = Levels(starts.select(*KEYS, "start", F.col("start").alias("node"), F.lit(FREE).alias("cap")).distinct(), "reach")
    while not found.last.isEmpty():
        front = found.last.withColumnRenamed("node", "at")
        on = front.join(jumps, [*KEYS, "at"]).filter("level < cap").select(*KEYS, "start", "node", F.col("level").alias("cap"))
        nxt = on.unionByName(front.join(forks, [*KEYS, "at"]).select(*KEYS, "start", "node", F.lit(FREE).alias("cap"))).groupBy(*KEYS, "start", "node").agg(F.max("cap").alias("cap"))
        found.append(nxt.join(found.table().select(*KEYS, "start", "node"), [*KEYS, "start", "node"], "left_anti"))
    seen = found.table().drop("cap")
    return seen, edges.join(seen.select(*KEYS, "start", F.col("node").alias(a)), [*KEYS, a])


def route(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """One shortest directed path per pair (query_id, start, target): struct arrays ``nodes`` and ``edge_ids``; no path, no row.

    A node is found by its first parent in order of discovery, then by the smallest edge id; start = target is the
    path without edges. While there is one way on only, a walk jumps along it; from the first fork it goes level by level
    and keeps each node's parent, and paths are put together in the end, jumping back over the parents. Levels are
    written once.
    """
    q = [*KEYS, "query_id"]
    every = edges.select(*KEYS, "edge_id", F.col("from_id").alias("at"), F.col("to_id").alias("node"))
    step = stored(every.groupBy(*KEYS, "at", "node").agg(F.min("edge_id").alias("edge_id")), "step")
    chain, jumps = _ways(step)
    asked = stored(pairs.select(*q, "start", "target").distinct(), "pairs")
    way = stored(chain_walk(jumps, asked.select(*KEYS, "query_id", "target", "start", F.col("start").alias("node")), KEYS, ["query_id", "start", "target"]), "ways")
    met = way.filter("node = target").select(*q, F.col("dist").alias("end"))
    last = way.join(met, q, "left_anti").groupBy(*q, "target").agg(F.max_by("node", "dist").alias("node"), F.max("dist").alias("end"))
    # the tree from the first fork on: each node's parent, found in order
    none = F.lit(None).cast("string")
    roots = last.select(*q, "target", "node", none.alias("parent"), none.alias("edge_id"), F.lit(1).cast("long").alias("rank"))
    tree = Levels(roots, "tree")
    open_ = tree.last
    while not open_.isEmpty():
        hop = open_.select(*q, "target", "rank", F.col("node").alias("at")).join(step, [*KEYS, "at"])
        hop = hop.join(tree.table().select(*q, "node"), [*q, "node"], "left_anti")
        first = hop.groupBy(*q, "target", "node").agg(F.min_by(F.struct("at", "edge_id", "rank"), F.struct("rank", "edge_id")).alias("x"))
        first = first.select(*q, "target", "node", F.col("x.at").alias("parent"), F.col("x.edge_id").alias("edge_id"), F.row_number().over(W.partitionBy(*q).orderBy("x.rank", "x.edge_id")).cast("long").alias("rank"))
        level = tree.append(first)
        open_ = level.join(level.filter("node = target").select(*q), q, "left_anti")
    up = tree.table()
    back, _ = chain_jumps(up.filter("parent is not null").join(up.filter("node = target").select(*q), q, "left_semi").select(*q, F.col("node").alias("at"), F.col("parent").alias("node")), q)
    steps_back = chain_walk(back, up.filter("node = target").select(*q, "node"), q, [])
    ends = last.select(*q, "end").join(up.filter("node = target").select(*q), q, "left_semi")
    depth = steps_back.groupBy(*q).agg(F.max("dist").alias("depth"))
    later = steps_back.join(depth, q).join(ends, q).select(*q, "node", (F.col("end") + F.col("depth") - F.col("dist")).alias("place"))
    early = way.join(met.unionByName(ends), q).filter("dist <= end").select(*q, "node", F.col("dist").alias("place"))
    path = early.unionByName(later).distinct()
    links = path.join(path.select(*q, F.col("node").alias("after"), (F.col("place") - 1).alias("place")), [*q, "place"], "left")
    links = links.join(step.select(*KEYS, F.col("at").alias("node"), F.col("node").alias("after"), "edge_id"), [*KEYS, "node", "after"], "left")
    listed = links.groupBy(*q).agg(F.array_sort(F.collect_list(F.struct("place", "node", "edge_id"))).alias("p"))
    out = listed.select(*q, F.transform("p", lambda x: x["node"]).alias("nodes"), F.array_compact(F.transform("p", lambda x: x["edge_id"])).alias("edge_ids"))
    return out.join(asked, q).select(*q, "start", "target", "nodes", "edge_ids", F.size("edge_ids").alias("length"))


def dossier(relations: DataFrame, seeds: DataFrame, hops: int = 2, max_nodes: int | None = 100, max_relations: int = 160, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) within ``hops`` undirected steps of each seed, the nearest ``max_nodes`` (None: all) and the first ``max_relations`` between them."""
    used = relations if kinds is None else relations.filter(F.col("kind").isin(kinds))
    both = used.select(*KEYS, "from_id", "to_id").unionByName(used.select(*KEYS, F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    seeds = seeds.withColumnRenamed("seed", "start") if "seed" in seeds.columns else seeds
    near = reach(both, seeds, "down", hops)[0] if max_nodes is None else nearest(both, seeds, hops, max_nodes)
    near = stored(near, "dossier-nodes")
    if not max_relations:
        return near, used.limit(0).withColumn("start", F.lit(None).cast("string"))
    inner = within(used, near.select(*KEYS, "start", "node"))
    kept = inner.withColumn("k", F.row_number().over(W.partitionBy(*KEYS, "start").orderBy("from_id", "to_id", "kind"))).filter(F.col("k") <= max_relations).drop("k")
    return near, kept


#: Items of each layer of a dossier, and pieces of evidence of each item.
DOSSIER = {"nodes": (100, 4), "relations": (160, 3), "behavior": (120, 3), "frameworks": (80, 3), "claims": (60, 3), "questions": (30, 3)}


def dossier_layers(seeds: DataFrame, nodes: DataFrame, relations: DataFrame, behavior: DataFrame, candidates: DataFrame, claims: DataFrame, questions: DataFrame, hops: int = 2, most: dict = DOSSIER) -> DataFrame:
    """One row for each item that a seed's dossier shows: (start, layer, place, item_id, kind, from_id, to_id, evidence).

    ``nodes`` are those within ``hops`` undirected steps, nearest first; ``relations`` and ``behavior`` join two of them;
    ``frameworks`` candidates touch one; ``claims`` and open ``questions`` are about the seed itself. All tables have item_id, kind
    and evidence[]; links have from_id and to_id, nodes node_id, claims and questions subject_id, questions status. Each
    layer keeps its first items by its own budget, and each item its first pieces of evidence.
    """
    seeds = seeds.withColumnRenamed("seed", "start") if "seed" in seeds.columns else seeds
    near, _ = dossier(relations, seeds, hops, most["nodes"][0], 0)
    near = near.select(*KEYS, "start", "node", "depth")
    ends = near.select(*KEYS, "start", "node")
    seen = stored(ends.select(*KEYS, "node").distinct(), "seen")
    none = F.lit(None).cast("string")

    def layer(df, name, *order):
        n = most[name][0]
        # the first rows of a partition are cut where they lie, before they are shuffled
        df = df.withColumn("place", F.row_number().over(W.partitionBy(*KEYS, "start").orderBy(*order))).filter(F.col("place") <= n)
        return df.select(*KEYS, "start", F.lit(name).alias("layer"), "place", "item_id", "kind", *[F.col(c) if c in df.columns else none.alias(c) for c in ("from_id", "to_id")], "evidence")

    def short(df, name):
        return df.withColumn("evidence", F.slice("evidence", 1, most[name][1]))

    def about(df, name):
        # the first of each subject, cut where they lie, before the seeds are looked up
        first = layer(short(df, name).withColumnRenamed("subject_id", "start"), name, "item_id")
        return first.join(seeds.select(*KEYS, "start").distinct(), [*KEYS, "start"], "left_semi")

    def touched(df, name):
        # ids alone are ranked, those shown get their rows
        at = lambda c: likely(df.select(*KEYS, c, "item_id"), seen, c).join(ends.withColumnRenamed("node", c), [*KEYS, c]).select(*KEYS, "start", "item_id")
        ids = at("from_id").unionByName(at("to_id")).withColumn("k", F.dense_rank().over(W.partitionBy(*KEYS, "start").orderBy("item_id"))).filter(F.col("k") <= most[name][0])
        ids = stored(ids.select(*KEYS, "start", "item_id").distinct(), "touched")
        release(ids.sparkSession)
        return layer(ids.join(short(df, name).dropDuplicates([*KEYS, "item_id"]), [*KEYS, "item_id"]), name, "item_id")

    def kept(df):
        # one layer after the other, so that their shuffle files are not there at once
        df = stored(df, "layer")
        release(df.sparkSession)
        return df

    out = kept(layer(short(nodes, "nodes").join(near.withColumnRenamed("node", "node_id"), [*KEYS, "node_id"]), "nodes", "depth", "node_id"))
    for df, name in ((relations, "relations"), (behavior, "behavior")):
        out = out.unionByName(kept(layer(within(short(df, name), ends), name, "from_id", "to_id", "kind", "item_id")))
    for more in (touched(candidates, "frameworks"), about(claims, "claims"), about(questions.filter("status = 'open'"), "questions")):
        out = out.unionByName(kept(more))
    return out


def context_paths(nodes: DataFrame, relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Paths behind a semantic node (keys, seed): of a system all, of a component its module's, else those of what it contains, executes and defines, 3 steps down."""
    s = seeds.join(nodes.select(*KEYS, F.col("node_id").alias("seed"), F.col("kind").alias("seed_kind"), F.col("label").alias("seed_label")), [*KEYS, "seed"])
    files = nodes.filter("path is not null").select(*KEYS, "path", F.col("module") if "module" in nodes.columns else F.lit(None).cast("string").alias("module"))
    every = s.filter("seed_kind = 'system'").join(files, KEYS).select(*KEYS, "seed", "path")
    part = s.filter("seed_kind = 'component'").join(files, (s["repo"] == files["repo"]) & (s["revision"] == files["revision"]) & (s["seed_label"] == files["module"])).select(s["repo"], s["revision"], "seed", "path")
    rest = s.filter("seed_kind not in ('system', 'component')")
    near, _ = reach(relations.filter(F.col("kind").isin("contains", "executes", "defines")), rest.select(*KEYS, F.col("seed").alias("start")), "down", 3)
    walked = near.join(nodes.select(*KEYS, F.col("node_id").alias("node"), "path").filter("path is not null"), [*KEYS, "node"]).select(*KEYS, F.col("start").alias("seed"), "path")
    return every.unionByName(part).unionByName(walked).distinct()


def collapse_branches(branches: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hidden, projected): ``branches`` (guard_id, arm_start, arm). Nodes that only some arms reach are hidden; one edge leads from the guard to where all arms meet first."""
    starts = branches.select(*KEYS, F.concat_ws("|", "guard_id", "arm").alias("start"), "arm_start", "guard_id")
    walks, _ = reach(edges, starts.select(*KEYS, F.col("arm_start").alias("start")).distinct())
    met = starts.select(*KEYS, "guard_id", "arm_start").join(walks.withColumnRenamed("start", "arm_start"), [*KEYS, "arm_start"])
    arms = starts.groupBy(*KEYS, "guard_id").agg(F.count_distinct("arm_start").alias("arms"))
    seen = met.groupBy(*KEYS, "guard_id", "node").agg(F.count_distinct("arm_start").alias("by"), F.max("depth").alias("depth")).join(arms, [*KEYS, "guard_id"])
    hidden = seen.filter("by < arms and node != guard_id").select(*KEYS, "guard_id", "node")
    joined = seen.filter("by = arms and arms > 1 and node != guard_id").groupBy(*KEYS, "guard_id").agg(F.min_by("node", F.struct("depth", "node")).alias("to_id"))
    return hidden, joined.select(*KEYS, F.col("guard_id").alias("from_id"), "to_id", F.lit("branches-to").alias("kind"))
