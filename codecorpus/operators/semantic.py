"""The semantic layer: containment, lifted facts, workflows, corroboration and claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions import scalars as S

KEYS = ["repo", "revision"]


def contains_defines(nodes: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sem_nodes, sem_relations): system contains components (0.72), components files (1), files define top symbols (1), symbols contain their members (1)."""
    files = nodes.filter("kind = 'file'")
    sid = lambda kind, c: F.concat(F.lit(f"semantic:{kind}:"), c)
    system = files.select(*KEYS).distinct().select(*KEYS, sid("system", F.col("repo")).alias("node_id"), F.col("repo").alias("label"), F.lit("system").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit("inferred").alias("trust"), F.lit("provisional").alias("status"), F.lit(0.72).alias("confidence"))
    comps = files.select(*KEYS, "module").distinct().select(*KEYS, sid("component", F.col("module")).alias("node_id"), F.col("module").alias("label"), F.lit("component").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit("inferred").alias("trust"), F.lit("provisional").alias("status"), F.lit(0.72).alias("confidence"))
    fs = files.select(*KEYS, sid("file", F.col("node_id")).alias("node_id"), "label", F.lit("file").alias("kind"), "path", F.lit("verified").alias("trust"), F.lit("accepted").alias("status"), F.lit(1.0).alias("confidence"))
    syms = symbols.select(*KEYS, sid("symbol", F.col("symbol_id")).alias("node_id"), F.coalesce("qualified_name", "name").alias("label"), F.lit("symbol").alias("kind"), "path", F.lit("verified").alias("trust"), F.lit("accepted").alias("status"), F.lit(1.0).alias("confidence"))
    rel = lambda df, a, b, kind, conf: df.select(*KEYS, a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"), F.lit("verified" if conf == 1 else "inferred").alias("trust"), F.lit("accepted" if conf == 1 else "provisional").alias("status"), F.lit(float(conf)).alias("confidence"))
    rels = rel(files.select(*KEYS, "module").distinct(), sid("system", F.col("repo")), sid("component", F.col("module")), "contains", 0.72)
    rels = rels.unionByName(rel(files, sid("component", F.col("module")), sid("file", F.col("node_id")), "contains", 1))
    rels = rels.unionByName(rel(symbols.filter("container_id is null"), sid("file", F.col("path")), sid("symbol", F.col("symbol_id")), "defines", 1))
    rels = rels.unionByName(rel(symbols.filter("container_id is not null"), sid("symbol", F.col("container_id")), sid("symbol", F.col("symbol_id")), "contains", 1))
    return system.unionByName(comps).unionByName(fs).unionByName(syms), rels


def lift_relations(edges: DataFrame, calls: DataFrame, relations: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(external nodes, sem_relations): imports between files or to external systems, calls and type facts between known symbols."""
    sid = lambda kind, c: F.concat(F.lit(f"semantic:{kind}:"), c)
    outer = edges.filter(F.col("to_id").startswith("external:"))
    ext = outer.select(*KEYS, F.substr("to_id", F.lit(10)).alias("label")).distinct().select(*KEYS, sid("external-system", F.col("label")).alias("node_id"), "label", F.lit("external-system").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit("verified").alias("trust"), F.lit("accepted").alias("status"), F.lit(1.0).alias("confidence"))
    target = F.when(F.col("to_id").startswith("external:"), sid("external-system", F.substr("to_id", F.lit(10)))).otherwise(sid("file", F.col("to_id")))
    imports = edges.select(*KEYS, sid("file", F.col("from_id")).alias("from_id"), target.alias("to_id"), F.lit("depends-on").alias("kind"), F.lit("verified").alias("trust"), F.lit("accepted").alias("status"), F.lit(1.0).alias("confidence"))
    known = symbols.select(*KEYS, "symbol_id")
    facts = calls.select(*KEYS, "from_id", "to_id", F.lit("calls").alias("kind"), "trust", "confidence").unionByName(relations.select(*KEYS, "from_id", "to_id", "kind", "trust", "confidence"))
    facts = facts.join(known.withColumnRenamed("symbol_id", "from_id"), [*KEYS, "from_id"], "left_semi").join(known.withColumnRenamed("symbol_id", "to_id"), [*KEYS, "to_id"], "left_semi")
    facts = facts.select(*KEYS, sid("symbol", F.col("from_id")).alias("from_id"), sid("symbol", F.col("to_id")).alias("to_id"), "kind", "trust", F.when(F.col("trust") == "verified", "accepted").otherwise("provisional").alias("status"), "confidence")
    return ext, imports.unionByName(facts).distinct()


def workflow_entries(symbols: DataFrame, max_support: int = 12, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(entries, omitted counts): symbols with a step kind; production first, support paths at most ``max_support``, all at most ``most`` per repository."""
    kind = S.workflow_step_kind(*[F.col(c) for c in ("kind", "name", "qualified_name", "container_id", "exported", "is_async", "decorators")])
    c = symbols.withColumn("step_kind", kind).filter("step_kind is not null").withColumn("support", S.is_support_path(F.col("path")))
    c = c.withColumn("_nth", F.row_number().over(W.partitionBy(*KEYS, "support").orderBy("path", "line", "symbol_id")))
    kept = c.filter((~F.col("support")) | (F.col("_nth") <= max_support)).drop("_nth")
    ranked = kept.withColumn("place", F.row_number().over(W.partitionBy(*KEYS).orderBy("support", "path", "line", "symbol_id")))
    counts = c.groupBy(*KEYS).agg(F.greatest(F.count_if("support") - max_support, F.lit(0)).alias("support_omitted"), F.greatest(F.count_if(~F.col("support")) + F.least(F.count_if("support"), F.lit(max_support)) - most, F.lit(0)).alias("entries_omitted"))
    return ranked.filter(F.col("place") <= most), counts


def workflow_participants(entries: DataFrame, sites: DataFrame, per_workflow: int = 16, per_repo: int = 800) -> DataFrame:
    """Call sites of each entry in order of ordinal and target, once for each target, path and ordinal. ``sites`` (keys, from_id, to_id, path, ordinal, ..)."""
    s = sites.join(entries.select(*KEYS, F.col("symbol_id").alias("from_id"), F.col("place").alias("entry_place")), [*KEYS, "from_id"]).dropDuplicates([*KEYS, "from_id", "to_id", "path", "ordinal"])
    s = s.withColumn("place", F.row_number().over(W.partitionBy(*KEYS, "from_id").orderBy("ordinal", "to_id"))).filter(F.col("place") <= per_workflow)
    return s.withColumn("k", F.row_number().over(W.partitionBy(*KEYS).orderBy("entry_place", "place"))).filter(F.col("k") <= per_repo).drop("k").withColumnRenamed("from_id", "workflow_id")


FLOW_RULES = ["entry", "arm", "retry", "straight", "converge", "continue"]


def flow_precedes(participants: DataFrame) -> DataFrame:
    """precedes relations of a workflow's sites: entry to the first one 0.78, consecutive ones of an arm 0.80, of a retry body 0.78, in straight line 0.80.

    ``participants`` (keys, workflow_id, to_id, ordinal, branch_id, arm, retry_id). One row for each workflow, from and
    to: the first rule wins in the order entry, arm, retry, straight.
    """
    g = [*KEYS, "workflow_id"]
    order = ["ordinal", "to_id"]
    first = participants.withColumn("k", F.row_number().over(W.partitionBy(*g).orderBy(*order))).filter("k = 1").select(*g, F.col("workflow_id").alias("from_id"), "to_id", F.lit(0).alias("rule"), F.lit(0.78).alias("confidence"))
    step = lambda df, by, rule, conf: df.withColumn("from_id", F.lag("to_id").over(W.partitionBy(*g, *by).orderBy(*order))).filter("from_id is not null and from_id != to_id").select(*g, "from_id", "to_id", F.lit(rule).alias("rule"), F.lit(conf).alias("confidence"))
    out = first.unionByName(step(participants.filter("branch_id is not null"), ["branch_id", "arm"], 1, 0.80))
    out = out.unionByName(step(participants.filter("retry_id is not null"), ["retry_id"], 2, 0.78))
    out = out.unionByName(step(participants.filter("branch_id is null and retry_id is null"), [], 3, 0.80))
    best = out.groupBy(*g, "from_id", "to_id").agg(F.min(F.struct("rule", "confidence")).alias("b"))
    names = F.element_at(F.array(*map(F.lit, FLOW_RULES)), F.col("b.rule") + 1)
    return best.select(*g, "from_id", "to_id", F.lit("precedes").alias("kind"), names.alias("rule"), F.col("b.confidence").alias("confidence"))


def flow_controls(participants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control nodes, relations): a guard node for each branch and a retry node for each retry; branches-to the first site of each arm 0.88, retries its first site 0.92 with a bound and 0.86 without, convergence from the last site of each arm to the next site after the branch 0.72, continuation after a retry 0.70."""
    g = [*KEYS, "workflow_id"]
    b = participants.filter("branch_id is not null")
    r = participants.filter("retry_id is not null")
    nodes = b.select(*g, F.col("branch_id").alias("node_id"), F.lit("guard").alias("step_kind")).distinct().unionByName(r.select(*g, F.col("retry_id").alias("node_id"), F.lit("retry").alias("step_kind")).distinct())
    at = F.struct("ordinal", "to_id")
    arms = b.groupBy(*g, "branch_id", "arm").agg(F.min(at)["to_id"].alias("first_site"), F.max(at)["to_id"].alias("last_site"), F.max("ordinal").alias("end"))
    ends = arms.groupBy(*g, "branch_id").agg(F.max("end").alias("group_end"))
    bodies = r.groupBy(*g, "retry_id").agg(F.min(at)["to_id"].alias("first_site"), F.max(at)["to_id"].alias("last_site"), F.max("ordinal").alias("end"), F.max("max_attempts").alias("max_attempts"))
    after = lambda df, key, end: df.join(participants.select(*g, F.col("ordinal").alias("n_ord"), F.col("to_id").alias("n_to")), g).filter(F.col("n_ord") > F.col(end)).groupBy(*g, key).agg(F.min(F.struct("n_ord", "n_to"))["n_to"].alias("next_site"))
    rel = lambda df, a, c, kind, conf: df.select(*g, F.col(a).alias("from_id"), F.col(c).alias("to_id"), F.lit(kind).alias("kind"), (conf if not isinstance(conf, float) else F.lit(conf)).alias("confidence"))
    out = rel(arms, "branch_id", "first_site", "branches-to", 0.88)
    out = out.unionByName(rel(bodies, "retry_id", "first_site", "retries", F.when(F.col("max_attempts").isNotNull(), 0.92).otherwise(0.86)))
    out = out.unionByName(rel(arms.join(after(ends, "branch_id", "group_end"), [*g, "branch_id"]), "last_site", "next_site", "precedes", 0.72))
    out = out.unionByName(rel(bodies.join(after(bodies, "retry_id", "end"), [*g, "retry_id"]), "last_site", "next_site", "precedes", 0.70))
    return nodes, out.filter("from_id != to_id").groupBy(*g, "from_id", "to_id", "kind").agg(F.max("confidence").alias("confidence"))


def reconcile_claims(inferred: DataFrame, authored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, questions): by subject and key, equal trimmed values corroborate each other, different ones conflict and raise a question; unmatched ones stay.

    Both (keys, subject_id, key, value).
    """
    k = [*KEYS, "subject_id", "key"]
    i = inferred.select(*k, F.col("value").alias("inferred_value"))
    a = authored.select(*k, F.col("value").alias("authored_value"))
    j = i.join(a, k, "full_outer")
    state = F.when(F.col("authored_value").isNull(), "provisional").when(F.col("inferred_value").isNull(), "accepted").when(F.trim("inferred_value") == F.trim("authored_value"), "corroborated").otherwise("conflicting")
    j = j.withColumn("status", state)
    rows = F.array_compact(F.array(F.when(F.col("inferred_value").isNotNull(), F.struct(F.lit("inferred").alias("trust"), F.col("inferred_value").alias("value"))), F.when(F.col("authored_value").isNotNull(), F.struct(F.lit("authored").alias("trust"), F.col("authored_value").alias("value")))))
    claims = j.select(*k, "status", F.explode(rows).alias("c")).select(*k, "c.trust", "c.value", "status")
    questions = j.filter("status = 'conflicting'").select(*k, F.col("inferred_value").alias("recommendation"), F.lit("open").alias("status"))
    return claims, questions


def corroborate_calls(calls: DataFrame, observed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with status: corroborated (confidence 0.95 at least) where the observed target is the inferred one, conflicting (0.94, both kept) where one line has exactly one inferred and one different observed target; else as they were.

    ``calls`` (keys, from_id, to_id, line, confidence); ``observed`` (keys, from_id, name, path, line, from_line). The
    observed target is the symbol around its line: one of that name first, then the smallest.
    """
    sym = symbols.select(*KEYS, "path", F.col("symbol_id").alias("to_id"), F.col("name").alias("s_name"), F.col("line").alias("s_line"), F.col("end_line").alias("s_end"))
    hit = observed.join(sym, [*KEYS, "path"]).filter("line between s_line and s_end")
    rank = F.struct((F.col("s_name") != F.col("name")).cast("int"), F.col("s_end") - F.col("s_line"), "to_id")
    seen = hit.groupBy(*KEYS, "from_id", "from_line", "name", "path", "line").agg(F.min_by("to_id", rank).alias("to_id")).select(*KEYS, "from_id", F.col("from_line").alias("line"), "to_id").distinct()
    site = [*KEYS, "from_id", "line"]
    per_i = calls.groupBy(*site).agg(F.count_distinct("to_id").alias("ni"), F.min("to_id").alias("i_to"))
    per_o = seen.groupBy(*site).agg(F.count_distinct("to_id").alias("no"), F.min("to_id").alias("o_to"))
    clash = per_i.join(per_o, site).filter("ni = 1 and no = 1 and i_to != o_to").select(*site, "i_to", "o_to")
    pair = [*KEYS, "from_id", "to_id"]
    c = calls.join(seen.select(*pair).distinct().withColumn("same", F.lit(True)), pair, "left").join(clash.select(*site, F.col("i_to").alias("to_id"), F.lit(True).alias("bad")), [*site, "to_id"], "left")
    status = F.when(F.col("same"), "corroborated").when(F.col("bad"), "conflicting").otherwise("provisional")
    conf = F.when(F.col("same"), F.greatest("confidence", F.lit(0.95))).when(F.col("bad"), F.lit(0.94)).otherwise(F.col("confidence"))
    kept = c.select(*pair, "line", F.lit("inferred").alias("trust"), status.alias("status"), conf.alias("confidence"))
    extra = clash.select(*KEYS, "from_id", F.col("o_to").alias("to_id"), "line", F.lit("observed").alias("trust"), F.lit("conflicting").alias("status"), F.lit(0.94).alias("confidence"))
    return kept.unionByName(extra)


def workflow_summaries(participants: DataFrame, entries: DataFrame, modules: DataFrame) -> DataFrame:
    """Per workflow: steps, branches, retries, whether it is support code, and its components."""
    p = participants.join(modules.select(*KEYS, "path", "module").distinct(), [*KEYS, "path"], "left")
    agg = p.groupBy(*KEYS, "workflow_id").agg(F.count("*").alias("steps"), F.count_distinct("branch_id").alias("branches"), F.count_distinct("retry_id").alias("retries"), F.array_sort(F.collect_set("module")).alias("components"))
    e = entries.select(*KEYS, F.col("symbol_id").alias("workflow_id"), "step_kind", "support")
    return e.join(agg, [*KEYS, "workflow_id"], "left").fillna(0, ["steps", "branches", "retries"]).withColumn("components", F.coalesce("components", F.array().cast("array<string>")))
