"""What differs: between revisions, traces and code, plans and changes; and what an index spares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions import scalars as S


def table_delta(base: DataFrame, head: DataFrame, key: list[str], fields: list[str], preview: int | None = None, group: list[str] = ()) -> DataFrame:
    """(key, status, changed): rows added, removed or changed between two tables, with the names of the changed fields.

    Fingerprints are compared first, so the fields travel only as one hash each. ``preview`` keeps the first so many
    of each status in key order within ``group`` (the report's size); None keeps all.
    """
    prep = lambda df, side: df.select(*key, F.lit(True).alias(f"{side}_there"), F.struct(*[F.xxhash64(F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"})).alias(f) for f in fields]).alias(side))
    both = prep(base, "base").join(prep(head, "head"), key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"base.{f}").eqNullSafe(F.col(f"head.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("base_there").isNull(), "added").when(F.col("head_there").isNull(), "removed").when(F.size(changed) > 0, "changed")
    out = both.withColumn("status", status).filter("status is not null")
    out = out.select(*key, "status", F.when(F.col("status") == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed"))
    if preview is None:
        return out
    w = W.partitionBy(*group, "status").orderBy(*key)
    return out.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= preview).drop("k")


def delta_summary(delta: DataFrame, group: list[str] = ()) -> DataFrame:
    """Counts of added, removed and changed rows."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return delta.groupBy(*group).agg(count("added"), count("removed"), count("changed"))


def graph_delta(base_nodes: DataFrame, base_edges: DataFrame, head_nodes: DataFrame, head_edges: DataFrame, preview: int = 500) -> tuple[DataFrame, DataFrame]:
    """(node delta, edge delta) of two readings of one repository; ``preview`` (1 to 5,000) rows of each status."""
    if not 1 <= preview <= 5000:
        raise ValueError("preview must be 1 to 5000")
    n = table_delta(base_nodes, head_nodes, ["repo", "node_id"], ["label", "kind", "module", "language", "count", "hash"], preview, ["repo"])
    fp = lambda df: df.withColumn("evidence_fingerprint", F.sha2(F.to_json("evidence"), 256))
    e = table_delta(fp(base_edges), fp(head_edges), ["repo", "edge_id"], ["from_id", "to_id", "kind", "count", "evidence_fingerprint"], preview, ["repo"])
    return n, e


def delta_gate(pairs: DataFrame, receipts: DataFrame) -> DataFrame:
    """``pairs`` (repo, base_revision, head_revision) with ``code``: null where the two readings may be compared.

    ``receipts`` (repo, revision, root, valid): a reading is valid if it has receipts and all of them are. DELTA_READING_INVALID comes
    before DELTA_WORKSPACE_DIFFERS (roots that differ, or aren't known).
    """
    state = receipts.groupBy("repo", "revision").agg(F.bool_and(F.coalesce("valid", F.lit(False))).alias("valid"), F.min("root").alias("root"), F.max("root").alias("last_root"))
    side = lambda name: state.select("repo", F.col("revision").alias(f"{name}_revision"), F.col("valid").alias(f"{name}_valid"), *[F.col(c).alias(f"{name}_{c}") for c in ("root", "last_root")])
    both = pairs.select("repo", "base_revision", "head_revision").distinct().join(side("base"), ["repo", "base_revision"], "left").join(side("head"), ["repo", "head_revision"], "left")
    valid = F.coalesce(F.col("base_valid") & F.col("head_valid"), F.lit(False))
    one_root = F.coalesce((F.col("base_root") == F.col("head_root")) & (F.col("base_root") == F.col("base_last_root")) & (F.col("head_root") == F.col("head_last_root")), F.lit(False))
    return both.select("repo", "base_revision", "head_revision", F.when(~valid, "DELTA_READING_INVALID").when(~one_root, "DELTA_WORKSPACE_DIFFERS").alias("code"))


def checked_graph_delta(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, receipts: DataFrame, preview: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node delta, edge delta, diagnostics) of the pairs of readings that delta_gate lets through; a pair that it refuses has a diagnostic and no delta.

    The gate is a part of the plan: nothing is asked for on the driver. One pair for each repository.
    """
    gate = delta_gate(pairs, receipts)
    passed = gate.filter("code is null")
    of = lambda df, side: df.join(passed.select("repo", F.col(f"{side}_revision").alias("revision")), ["repo", "revision"], "left_semi")
    n, e = graph_delta(of(nodes, "base"), of(edges, "base"), of(nodes, "head"), of(edges, "head"), preview)
    refused = gate.filter("code is not null").select("repo", F.lit("delta").alias("layer"), "code", F.lit("error").alias("severity"), F.concat_ws("..", "base_revision", "head_revision").alias("subject"))
    return n, e, refused


def semantic_delta(prev: dict[str, DataFrame], nxt: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """(layer, id, status) of nodes, relations, claims and questions by row fingerprint."""
    out = None
    for layer, id_col in ids.items():
        fp = lambda df: df.select("repo", F.col(id_col).alias("id"), S.row_hash(*[c for c in df.columns if c not in ("repo", "revision")]).alias("fp"))  # noqa: E731, B023
        d = table_delta(fp(prev[layer]), fp(nxt[layer]), ["repo", "id"], ["fp"]).select(F.lit(layer).alias("layer"), "repo", "id", "status")
        out = d if out is None else out.unionByName(d)
    return out


def compare_runtime(static: DataFrame, observed: DataFrame) -> DataFrame:
    """Endpoint pairs by status: matched, static-only, observed-only; ``returns`` relations don't count."""
    s = static.filter("kind != 'returns'").select("repo", "from_id", "to_id").distinct().withColumn("s", F.lit(True))
    o = observed.select("repo", "from_id", "to_id").distinct().withColumn("o", F.lit(True))
    status = F.when(F.col("s") & F.col("o"), "matched").when(F.col("s"), "static-only").otherwise("observed-only")
    return s.join(o, ["repo", "from_id", "to_id"], "full_outer").select("repo", "from_id", "to_id", status.alias("status"))


def file_changes(before: DataFrame, after: DataFrame, key: list[str], max_files: int | None = None, max_bytes: int | None = None, max_file: int = 1_500_000) -> DataFrame:
    """created, deleted and modified files by hash, with both hashes and sizes; ``refused`` names why a change can't be reviewed.

    ``max_files`` and ``max_bytes`` bound one review in path order (default off).
    """
    b = before.select(*key, F.col("hash").alias("before_hash"), F.col("content").alias("before_text"))
    a = after.select(*key, F.col("hash").alias("after_hash"), F.col("content").alias("after_text"))
    j = b.join(a, key, "full_outer").filter(~F.col("before_hash").eqNullSafe(F.col("after_hash")))
    status = F.when(F.col("before_hash").isNull(), "created").when(F.col("after_hash").isNull(), "deleted").otherwise("modified")
    size = F.coalesce(F.octet_length("before_text"), F.lit(0)) + F.coalesce(F.octet_length("after_text"), F.lit(0))
    refused = F.when(F.coalesce(F.col("before_text").contains("\0"), F.lit(False)) | F.coalesce(F.col("after_text").contains("\0"), F.lit(False)), "binary").when(F.greatest(F.coalesce(F.octet_length("before_text"), F.lit(0)), F.coalesce(F.octet_length("after_text"), F.lit(0))) > max_file, "oversized")
    out = j.select(*key, status.alias("status"), "before_hash", "after_hash", "before_text", "after_text", size.alias("size"), refused.alias("refused"))
    if max_files is None and max_bytes is None:
        return out
    w = W.partitionBy(*[k for k in key if k != "path"]).orderBy("path").rowsBetween(W.unboundedPreceding, 0)
    within = (F.count("*").over(w) <= (max_files or (1 << 62))) & (F.sum("size").over(w) <= (max_bytes or (1 << 62)))
    return out.withColumn("refused", F.coalesce("refused", F.when(~within, "review-bound")))


def apply_conflicts(changes: DataFrame, files: DataFrame, set_key: str = "set_id") -> DataFrame:
    """Change sets with ``applies`` and the conflicts: a change applies if the file's hash is the one it was made from, its texts match their hashes and its path is not repeated; a set applies whole or not at all."""
    j = changes.join(files.select("repo", "path", F.col("hash").alias("current_hash")), ["repo", "path"], "left")
    twice = F.count("*").over(W.partitionBy(set_key, "repo", "path")) > 1
    sound = F.coalesce(F.sha2("before_text", 256) == F.col("before_hash"), F.col("before_hash").isNull()) & F.coalesce(F.sha2("after_text", 256) == F.col("after_hash"), F.col("after_hash").isNull())
    code = F.when(twice, "duplicate-path").when(~F.col("current_hash").eqNullSafe(F.col("before_hash")), "edited-meanwhile").when(~sound, "hash-mismatch")
    rows = j.withColumn("conflict", code)
    return rows.groupBy(set_key).agg(F.bool_and(F.col("conflict").isNull()).alias("applies"), F.count("conflict").alias("n_conflicts"), F.array_sort(F.collect_set("conflict")).alias("conflicts"))


def plan_evaluation(plans: DataFrame, changes: DataFrame) -> DataFrame:
    """Per run: expected and actual paths, unexpected ones (none where nothing was expected) and missing ones."""
    exp = plans.groupBy("run_id").agg(F.array_sort(F.collect_set("path")).alias("expected"))
    act = changes.groupBy("run_id").agg(F.array_sort(F.collect_set("path")).alias("actual"))
    none = F.array().cast("array<string>")
    j = exp.join(act, "run_id", "full_outer").select("run_id", F.coalesce("expected", none).alias("expected"), F.coalesce("actual", none).alias("actual"))
    return j.withColumns({"unexpected": F.when(F.size("expected") == 0, none).otherwise(F.array_except("actual", "expected")), "missing": F.array_except("expected", "actual")})


def incremental_plan(files: DataFrame, index: DataFrame, invalidated: DataFrame | None = None) -> DataFrame:
    """Files and index entries with ``action``: reuse (same size and mtime, not invalidated), parse, or drop (vanished)."""
    key = ["repo", "path"]
    f = files.select(*key, F.col("size").alias("size"), F.col("mtime").alias("mtime"), F.lit(True).alias("there"))
    i = index.select(*key, F.col("size").alias("i_size"), F.col("mtime").alias("i_mtime"), F.lit(True).alias("known"))
    j = f.join(i, key, "full_outer")
    j = j.join(invalidated.select(*key).distinct().withColumn("stale", F.lit(True)), key, "left") if invalidated is not None else j.withColumn("stale", F.lit(None).cast("boolean"))
    same = F.col("known") & (F.col("size") == F.col("i_size")) & F.col("mtime").eqNullSafe(F.col("i_mtime")) & F.col("stale").isNull()
    return j.select(*key, F.when(F.col("there").isNull(), "drop").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("parse").alias("action"))


def verify_receipts(manifests: DataFrame, changes: DataFrame) -> DataFrame:
    """Checkpoints with ``texts_match`` and ``changes_match``: each text's hash and the checkpoint's hash of its changes recomputed."""
    c = changes.withColumn("ok", F.coalesce(F.sha2("text", 256) == F.col("hash"), F.lit(False)))
    per = c.groupBy("checkpoint_id").agg(F.bool_and("ok").alias("texts_match"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash"))), "\n"), 256).alias("recomputed"), F.count("*").alias("n_changes"))
    j = manifests.join(per, "checkpoint_id", "left")
    return j.select("checkpoint_id", F.coalesce("texts_match", F.lit(True)).alias("texts_match"), F.coalesce(F.col("recomputed") == F.col("changes_hash"), F.col("changes_hash").isNull()).alias("changes_match"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"))
