"""Workflows and claims of a composed map: what of a packet a rule draft takes, and what of an outside draft source facts carry.

Lists keep the order they come in. Everything is keyed by revision; no step gathers more than one workflow or component in
a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions import scalars as S

KEYS = ["repo", "revision"]
# Kinds of a step by words of its label and responsibility, first match.
STEP_PATTERNS = (("auth|valid|guard|risk", "validate"), ("plan|agent|reason|infer", "infer"), ("tool|command|exec|runner", "tool-call"), ("store|db|persist|repository", "persist"), ("publish|emit|event|queue", "publish"))


def _first(df: DataFrame, most: int, *order) -> DataFrame:
    """The first ``most`` rows of each revision, with their ``place``."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*KEYS).orderBy(*order))).filter(F.col("place") <= most)


def packet_workflows(workflows: DataFrame, evidence: DataFrame, files: DataFrame, most: int = 30) -> DataFrame:
    """The first ``most`` workflows of a revision with ``candidate_ids``: module candidates of their evidence, in order of first appearance.

    ``workflows`` (workflow_id, label, description), ``evidence`` (workflow_id, place, path), ``files`` (path, candidate_id).
    """
    w = _first(workflows.select(*KEYS, "workflow_id", "label", "description"), most, "workflow_id")
    seen = evidence.join(w.select(*KEYS, "workflow_id"), [*KEYS, "workflow_id"], "left_semi").join(files.select(*KEYS, "path", "candidate_id").distinct(), [*KEYS, "path"])
    seen = seen.groupBy(*KEYS, "workflow_id", "candidate_id").agg(F.min("place").alias("at"))
    lists = seen.groupBy(*KEYS, "workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "candidate_id"))), lambda x: x["candidate_id"]).alias("candidate_ids"))
    return w.join(lists, [*KEYS, "workflow_id"], "left").withColumn("candidate_ids", F.coalesce("candidate_ids", F.array().cast("array<string>")))


def packet_claims(claims: DataFrame, most: int = 40) -> DataFrame:
    """The first ``most`` authored claims of a revision: claim_id, subject_id, key, value, status, place."""
    return _first(claims.filter("trust = 'authored'").select(*KEYS, "claim_id", "subject_id", "key", "value", "status"), most, "claim_id")


def rule_workflows(packet: DataFrame, components: DataFrame, most: int = 3, whole: bool = False) -> DataFrame:
    """The first ``most`` workflows (6 where workflows are the focus) with a chosen component; ``component_ids`` are those of their candidates that are chosen.

    With ``whole``, only workflows all of whose candidates are chosen: a relational division.
    """
    asked = packet.select(*KEYS, "workflow_id", "label", "description", "place", F.size("candidate_ids").alias("asked"), F.posexplode("candidate_ids").alias("at", "candidate_id"))
    met = asked.join(components.select(*KEYS, "candidate_id", S.slug(F.col("module")).alias("component_id")), [*KEYS, "candidate_id"])
    kept = met.groupBy(*KEYS, "workflow_id", "label", "description", "place", "asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "component_id"))), lambda x: x["component_id"]).alias("component_ids"))
    if whole:
        kept = kept.filter(F.size("component_ids") == F.col("asked"))
    kept = _first(kept.withColumnRenamed("place", "at"), most, "at")
    return kept.select(*KEYS, "workflow_id", "label", F.coalesce("description", F.lit("Source-inferred workflow candidate.")).alias("description"), "component_ids", F.array("workflow_id").alias("source_ids"), F.lit(0.62).alias("confidence"), "place")


def step_kind(text):
    """The kind of a step by the words in its label and responsibility."""
    low = F.lower(text)
    return reduce(lambda rest, p: F.when(low.rlike(p[0]), p[1]).otherwise(rest), reversed(STEP_PATTERNS), F.lit("execute"))


def ground_workflows(draft: DataFrame, components: DataFrame, packet: DataFrame, from_rules: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relations, rejected) of a draft's workflows.

    ``draft`` (workflow_id, label, component_ids[], source_ids[], confidence); ``components`` (component_id, label,
    responsibility, confidence) that are grounded. A workflow needs a grounded component and, unless it is of the rules, a
    source workflow of the packet. Its steps are its grounded components in order, each executing its component.
    """
    steps = draft.select(*KEYS, "workflow_id", F.col("confidence").alias("sure"), F.posexplode("component_ids").alias("at", "component_id")).join(components, [*KEYS, "component_id"])
    sourced = draft.select(*KEYS, "workflow_id", F.explode("source_ids").alias("source")).join(packet.select(*KEYS, F.col("workflow_id").alias("source")), [*KEYS, "source"], "left_semi").select(*KEYS, "workflow_id").distinct()
    good = steps.select(*KEYS, "workflow_id").distinct()
    if not from_rules:
        good = good.join(sourced, [*KEYS, "workflow_id"], "left_semi")
    bad = draft.join(good, [*KEYS, "workflow_id"], "left_anti").select(*KEYS, F.col("workflow_id").alias("subject"), F.lit("COMPOSITION_WORKFLOW_UNGROUNDED").alias("code"))
    name = F.concat(F.lit("compose:workflow:"), S.slug(F.col("workflow_id")))
    steps = steps.join(good, [*KEYS, "workflow_id"], "left_semi").withColumn("n", F.row_number().over(W.partitionBy(*KEYS, "workflow_id").orderBy("at"))).withColumn("flow", name)
    steps = steps.withColumn("step", F.concat("flow", F.lit(":step:"), F.col("n").cast("string")))
    flows = draft.join(good, [*KEYS, "workflow_id"], "left_semi").withColumn("flow", name)
    nodes = flows.select(*KEYS, F.col("flow").alias("node_id"), "label", F.lit("workflow").alias("kind"), F.lit(None).cast("string").alias("step_kind"), "confidence")
    nodes = nodes.unionByName(steps.select(*KEYS, F.col("step").alias("node_id"), "label", F.lit("workflow-step").alias("kind"), step_kind(F.concat_ws(" ", "label", "responsibility")).alias("step_kind"), F.least("sure", "confidence").alias("confidence")))
    rel = lambda df, a, b, kind: df.select(*KEYS, a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"), F.col("sure").alias("confidence"))
    before = F.lag("step").over(W.partitionBy(*KEYS, "workflow_id").orderBy("n"))
    relations = rel(flows.withColumnRenamed("confidence", "sure"), F.lit("compose:system:workspace"), F.col("flow"), "contains")
    relations = relations.unionByName(rel(steps, F.col("flow"), F.col("step"), "contains")).unionByName(rel(steps, F.col("step"), F.concat(F.lit("compose:component:"), S.slug(F.col("component_id"))), "executes"))
    relations = relations.unionByName(rel(steps.withColumn("before", before).filter("before is not null"), F.col("before"), F.col("step"), "precedes"))
    return nodes.withColumns({"trust": F.lit("inferred"), "status": F.lit("provisional")}), relations.withColumns({"trust": F.lit("inferred"), "status": F.lit("provisional")}), bad


def ground_claims(components: DataFrame, authored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, questions) of grounded components.

    ``components`` (component_id, candidate_ids[], responsibility, confidence) each claim their responsibility. Authored claims
    (packet_claims) on a component's semantic candidates go with it, numbered in order; one on the responsibility
    corroborates the component's own where it says the same but for case and space, else conflicts with it, and asks.
    The last such claim sets the status of the component's own.
    """
    id_ = F.concat(F.lit("compose:component:"), S.slug(F.col("component_id")))
    claim = F.concat(F.lit("compose:claim:"), S.slug(F.col("component_id")))
    members = components.select(*KEYS, "component_id", "responsibility", F.explode("candidate_ids").alias("candidate_id")).distinct()
    said = authored.withColumn("candidate_id", F.concat(F.lit("candidate:semantic:"), "subject_id")).withColumnRenamed("status", "was")
    met = members.join(said, [*KEYS, "candidate_id"])
    same = F.lower(F.trim("value")) == F.lower(F.trim("responsibility"))
    met = met.withColumn("status", F.when(F.col("key") != "responsibility", F.col("was")).when(same, "corroborated").otherwise("conflicting"))
    met = met.withColumn("n", F.row_number().over(W.partitionBy(*KEYS, "component_id").orderBy("place")))
    met = met.withColumn("authored_id", F.concat(claim, F.lit(":authored:"), F.col("n").cast("string")))
    last = met.filter("key = 'responsibility'").groupBy(*KEYS, "component_id").agg(F.max_by("status", "place").alias("status"))
    own = components.join(last, [*KEYS, "component_id"], "left")
    claims = own.select(*KEYS, F.concat(claim, F.lit(":responsibility")).alias("claim_id"), id_.alias("subject_id"), F.lit("responsibility").alias("key"), F.trim("responsibility").alias("value"), F.lit("inferred").alias("trust"), F.coalesce("status", F.lit("provisional")).alias("status"))
    claims = claims.unionByName(met.select(*KEYS, F.col("authored_id").alias("claim_id"), id_.alias("subject_id"), "key", "value", F.lit("authored").alias("trust"), "status"))
    asks = met.filter("key = 'responsibility' and status = 'conflicting'")
    questions = asks.select(*KEYS, F.concat(F.lit("compose:question:"), S.slug(F.col("component_id")), F.lit(":authored-"), F.col("n").cast("string")).alias("question_id"), id_.alias("subject_id"), F.array(F.concat(claim, F.lit(":responsibility")), "authored_id").alias("claim_ids"), F.trim("responsibility").alias("recommendation"))
    return claims, questions
