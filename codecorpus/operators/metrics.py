"""Counts, coverage, fingerprints and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions import scalars as S

KEYS = ["repo", "revision"]


def language_coverage(files: DataFrame) -> DataFrame:
    """Per repository, revision and language, and in total (language ``total``): indexed, deep, file_only, skipped, oversized and mode.

    ``files`` has keys, path, skip_reason.
    """
    ext = S.extension(F.col("path"))
    rows = files.select(*KEYS, S.language_of(ext).alias("language"), ext.isin(S.DEEP_EXTENSIONS).alias("deep"), "skip_reason")
    read = F.col("skip_reason").isNull()
    out = rows.rollup(*KEYS, "language").agg(
        F.count("*").alias("indexed"),
        F.count_if(read).alias("analyzed"),
        F.count_if(read & F.col("deep")).alias("deep"),
        F.count_if(read & ~F.col("deep")).alias("file_only"),
        F.count_if(~read).alias("skipped"),
        F.count_if(F.coalesce(F.col("skip_reason") == "oversized", F.lit(False))).alias("oversized"),
        F.grouping_id().alias("level"),
    )
    mode = F.when(F.col("deep") == 0, "file-only").when(F.col("deep") == F.col("indexed"), "deep").otherwise("partial")
    return out.filter("level < 2").select(*KEYS, F.when(F.col("level") == 1, "total").otherwise(F.col("language")).alias("language"), "indexed", "analyzed", "deep", "file_only", "skipped", "oversized", mode.alias("mode"))


def kind_counts(table: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): counts of each column's values in one pass over grouping sets."""
    pairs = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p"))
    return pairs.groupBy("p.field", "p.value").agg(F.count("*").alias("n")).select("field", "value", "n")


def source_revision(files: DataFrame, id_col: str = "path") -> DataFrame:
    """Per repository and revision: SHA-256 over its sorted ``id:hash`` lines. The list is one line of about 100 bytes for each file."""
    line = F.concat_ws(":", id_col, "hash")
    return files.groupBy(*KEYS).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("source_revision"), F.count("*").alias("n_files"))


def layer_revision(tables: dict[str, DataFrame]) -> DataFrame:
    """One fingerprint per repository, revision and layer, over the sorted hashes of its rows.

    The rows of a layer are hashed in 256 parts by their own hash, and the parts in order, so that no list holds a layer.
    """
    out = None
    for layer, df in tables.items():
        cols = sorted(c for c in df.columns if c not in KEYS)
        hashed = df.select(*KEYS, S.row_hash(*cols).alias("h"))
        part = hashed.groupBy(*KEYS, F.substring("h", 1, 2).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"), F.count("*").alias("n"))
        whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n"), 256)
        one = part.groupBy(*KEYS).agg(whole.alias("fingerprint"), F.sum("n").alias("n")).select(*KEYS, F.lit(layer).alias("layer"), "fingerprint", "n")
        out = one if out is None else out.unionByName(one)
    return out


def receipts(layer: str, table: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per repository and revision: valid (no error), rows, pieces of evidence, source-backed, verified and provisional counts."""
    t = table.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.sum(F.greatest(F.size("evidence"), F.lit(0))).cast("long").alias("evidence_count") if "evidence" in table.columns else F.lit(0).cast("long").alias("evidence_count"),
        F.count_if(F.size("evidence") > 0).alias("source_backed") if "evidence" in table.columns else F.lit(0).cast("long").alias("source_backed"),
        F.count_if(F.col("trust") == "verified").alias("verified") if "trust" in table.columns else F.lit(0).cast("long").alias("verified"),
        F.count_if(F.col("status") == "provisional").alias("provisional") if "status" in table.columns else F.lit(0).cast("long").alias("provisional"),
    )
    d = diagnostics.groupBy(*KEYS).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    j = t.join(d, KEYS, "left").fillna(0, ["errors", "warnings"])
    return j.select(*KEYS, F.lit(layer).alias("layer"), (F.col("errors") == 0).alias("valid"), "n", "evidence_count", "source_backed", "verified", "provisional", "errors", "warnings")


def callgraph_score(predicted: DataFrame, oracle: DataFrame, declared: DataFrame, known: DataFrame) -> DataFrame:
    """Per case, and in total (case_id ``total``): counts and scores of predicted edges against an oracle.

    ``declared`` are the names that the oracle lists (an oracle edge counts only when its callee is one), ``known``
    the names that our reading has; scoped counts are those with both ends in both.
    """
    pair = ["case_id", "from_name", "to_name"]
    o = oracle.join(declared.select("case_id", F.col("name").alias("to_name")).distinct(), ["case_id", "to_name"], "left_semi").select(*pair).distinct().withColumn("gold", F.lit(1))
    p = predicted.select(*pair).distinct().withColumn("ours", F.lit(1))
    both = declared.select("case_id", "name").distinct().join(known.select("case_id", "name").distinct(), ["case_id", "name"])
    j = o.join(p, pair, "full_outer").fillna(0, ["gold", "ours"])
    j = j.join(both.select("case_id", F.col("name").alias("from_name"), F.lit(1).alias("f")), ["case_id", "from_name"], "left").join(both.select("case_id", F.col("name").alias("to_name"), F.lit(1).alias("t")), ["case_id", "to_name"], "left")
    scoped = (F.coalesce("f", F.lit(0)) * F.coalesce("t", F.lit(0)))
    s = lambda e: F.sum(e).cast("long")
    agg = j.withColumn("sc", scoped).rollup("case_id").agg(
        s(F.col("gold") * F.col("ours")).alias("tp"),
        s((1 - F.col("gold")) * F.col("ours")).alias("fp"),
        s(F.col("gold") * (1 - F.col("ours"))).alias("fn"),
        s(F.col("sc") * F.col("gold") * F.col("ours")).alias("scoped_tp"),
        s(F.col("sc") * (1 - F.col("gold")) * F.col("ours")).alias("scoped_fp"),
        s(F.col("sc") * F.col("gold") * (1 - F.col("ours"))).alias("scoped_fn"),
        F.grouping_id().alias("level"),
    )
    out = agg.withColumn("case_id", F.when(F.col("level") == 1, "total").otherwise(F.col("case_id"))).drop("level")
    for lead in ("", "scoped_"):
        tp, fp, fn = F.col(f"{lead}tp"), F.col(f"{lead}fp"), F.col(f"{lead}fn")
        out = out.withColumns({f"{lead}precision": S.ratio(tp, tp + fp), f"{lead}recall": S.ratio(tp, tp + fn), f"{lead}exact": (fp + fn) == 0})
        out = out.withColumn(f"{lead}f1", S.f1(F.col(f"{lead}precision"), F.col(f"{lead}recall")))
    return out.withColumns({"precision_valid": F.col("tp") + F.col("fp") > 0, "recall_valid": F.col("tp") + F.col("fn") > 0})


def score_examples(predicted: DataFrame, oracle: DataFrame, most: int = 12) -> DataFrame:
    """The first ``most`` missed and extra edges of each case, in name order."""
    pair = ["case_id", "from_name", "to_name"]
    miss = oracle.select(*pair).distinct().join(predicted.select(*pair).distinct(), pair, "left_anti").withColumn("status", F.lit("missed"))
    extra = predicted.select(*pair).distinct().join(oracle.select(*pair).distinct(), pair, "left_anti").withColumn("status", F.lit("extra"))
    w = W.partitionBy("case_id", "status").orderBy("from_name", "to_name")
    return miss.unionByName(extra).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most).drop("k")


def scope_metrics(outputs: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case and provider: precision and recall of selected, planned and changed paths, and violations.

    An empty answer to an empty expectation is right, to another one its precision is 0. Forbidden and required paths
    are looked for among the selected ones, changed paths among the expected ones; commands are compared trimmed.

    ``cases``: selected_paths, changed_paths, required_paths, forbidden_paths, commands, expected_verification_passed;
    ``outputs``: selected_paths, planned_paths, changed_paths, commands, verification_passed, verification_runs.
    """
    none = F.array().cast("array<string>")
    trimmed = lambda c: F.array_distinct(F.transform(F.coalesce(c, none), lambda x: F.trim(x)))
    cases, outputs = cases.withColumn("commands", trimmed("commands")), outputs.withColumn("commands", trimmed("commands"))
    c = cases.select("case_id", *[F.array_distinct(F.coalesce(x, none)).alias(f"want_{x}") for x in ("selected_paths", "changed_paths", "required_paths", "forbidden_paths", "commands")], "expected_verification_passed")
    o = outputs.select("case_id", "provider_id", *[F.array_distinct(F.coalesce(x, none)).alias(x) for x in ("selected_paths", "planned_paths", "changed_paths", "commands")], "verification_passed", "verification_runs")
    j = o.join(c, "case_id")
    both = lambda a, b: F.size(F.array_intersect(a, b))
    out = {}
    for name, got, want in (("context", "selected_paths", "want_selected_paths"), ("plan", "planned_paths", "want_changed_paths"), ("changed", "changed_paths", "want_changed_paths")):
        out[f"{name}_precision"] = F.when((F.size(got) == 0) & (F.size(want) > 0), 0.0).otherwise(S.ratio(both(got, want), F.size(got)))
        out[f"{name}_recall"] = S.ratio(both(got, want), F.size(want))
        out[f"{name}_f1"] = S.f1(out[f"{name}_precision"], out[f"{name}_recall"])
    out["out_of_scope"] = F.size(F.array_except("changed_paths", "want_changed_paths"))
    out["forbidden"] = both("selected_paths", "want_forbidden_paths")
    out["missing_required"] = F.size(F.array_except("want_required_paths", "selected_paths"))
    out["command_violations"] = F.size(F.array_except("commands", "want_commands"))
    out["verification_accurate"] = F.col("verification_passed").eqNullSafe(F.col("expected_verification_passed"))
    out["bounded_verification"] = F.coalesce("verification_runs", F.lit(0)) <= 3
    j = j.select("case_id", "provider_id", *[v.alias(k) for k, v in out.items()])
    ok = (F.col("out_of_scope") + F.col("forbidden") + F.col("missing_required") + F.col("command_violations") == 0) & F.col("verification_accurate") & F.col("bounded_verification")
    return j.withColumn("passed", ok)


def provider_matrix(results: DataFrame) -> DataFrame:
    """Per provider: cases, passed, mean F1 of context, plan and changes, summed violations."""
    return results.groupBy("provider_id").agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        *[F.avg(f"{n}_f1").alias(f"mean_{n}_f1") for n in ("context", "plan", "changed")],
        F.sum(F.col("out_of_scope") + F.col("forbidden") + F.col("command_violations")).cast("long").alias("violations"),
    )


def corpus_totals(repo_metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Per repository and over all (repo ``total``): sums of the columns, valid and invalid repositories."""
    agg = repo_metrics.rollup("repo").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), *[F.sum(c).cast("long").alias(c) for c in columns], F.grouping_id().alias("level"))
    return agg.withColumn("repo", F.when(F.col("level") == 1, "total").otherwise(F.col("repo"))).drop("level")
