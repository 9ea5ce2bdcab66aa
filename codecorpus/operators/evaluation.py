"""Evaluation inputs and results: oracle names against what a case declares, cases against their inventory, receipts against their texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import scalars as S

MODES = ["ask", "change"]
NAME_COLUMNS = ("selected_paths", "changed_paths", "required_paths", "forbidden_paths")


def declared_names(symbols: DataFrame, roots: list[str] = ()) -> DataFrame:
    """``(case_id, name)``: module and qualified name of each symbol of a case. ``symbols`` (case_id, path, qualified_name)."""
    return symbols.select("case_id", F.concat_ws(".", S.module_name(F.col("path"), roots), "qualified_name").alias("name")).distinct()


def oracle_names(names: DataFrame, declared: DataFrame, dynamic: bool = False, roots: list[str] = ()) -> DataFrame:
    """``names`` (case_id, raw) with ``name``: the first of its candidates that the case declares, else its first candidate."""
    ranked = names.select("case_id", "raw").distinct().withColumn("all", S.oracle_names(F.col("raw"), dynamic, roots))
    met = ranked.select("case_id", "raw", F.posexplode("all").alias("at", "name")).join(declared.select("case_id", "name").distinct(), ["case_id", "name"], "left_semi")
    best = met.groupBy("case_id", "raw").agg(F.min_by("name", "at").alias("known"))
    return ranked.join(best, ["case_id", "raw"], "left").select("case_id", "raw", F.coalesce("known", F.col("all")[0]).alias("name"))


def oracle_edges(callers: DataFrame, pairs: DataFrame, declared: DataFrame, dynamic: bool = False, roots: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(edges, internal) of an oracle by declared names: edges between names that are callers themselves, and those names.

    ``callers`` (case_id, from_name) has every caller, also without callees; ``pairs`` (case_id, from_name, to_name).
    """
    named = oracle_names(callers.select("case_id", F.col("from_name").alias("raw")).unionByName(pairs.select("case_id", F.col("to_name").alias("raw"))), declared, dynamic, roots)
    end = lambda c: named.select("case_id", F.col("raw").alias(c), F.col("name").alias(f"{c}_known"))
    internal = callers.join(end("from_name"), ["case_id", "from_name"]).select("case_id", F.col("from_name_known").alias("name")).distinct()
    edges = pairs.join(end("from_name"), ["case_id", "from_name"]).join(end("to_name"), ["case_id", "to_name"])
    edges = edges.select("case_id", F.col("from_name_known").alias("from_name"), F.col("to_name_known").alias("to_name")).distinct()
    return edges.join(internal.withColumnRenamed("name", "to_name"), ["case_id", "to_name"], "left_semi").select("case_id", "from_name", "to_name"), internal


def case_path(path):
    """A path of a case with ``/`` and without a leading ``./``; null if it is empty, absolute or leads out."""
    plain = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    bad = (plain == "") | plain.rlike(r"^(/|[A-Za-z]:)") | F.exists(F.split(plain, "/"), lambda p: (p == "") | (p == ".."))
    return F.when(~bad, plain)


def check_cases(cases: DataFrame, inventory: DataFrame, most_commands: int = 100, longest: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) cases; refused has a row (case_id, code, value) for each reason.

    ``cases`` (case_id, goal, mode, selected_paths[], changed_paths[], required_paths[], forbidden_paths[], commands[]), ``inventory`` (case_id, path).
    A case needs a goal and a mode of ask or change; its paths must be safe and in its inventory (an anti join); its
    commands are at most ``most_commands``, not blank, each at most ``longest`` characters.
    """
    why = lambda df, code, value: df.select("case_id", F.lit(code).alias("code"), value.cast("string").alias("value"))
    none = F.array().cast("array<string>")
    named = cases.select("case_id", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(c, none) for c in NAME_COLUMNS])))).alias("value")).withColumn("path", case_path(F.col("value")))
    inside = inventory.select("case_id", "path").distinct()
    commands = F.coalesce("commands", none)
    bad_command = F.col("commands").isNull() | (F.size("commands") > most_commands) | F.exists(commands, lambda c: c.isNull() | (F.trim(c) == "") | (F.length(c) > longest))
    refused = [
        why(cases.filter(F.trim(F.coalesce("goal", F.lit(""))) == ""), "EVALUATION_GOAL_MISSING", F.lit(None)),
        why(cases.filter(~F.coalesce(F.col("mode").isin(MODES), F.lit(False))), "EVALUATION_MODE_UNKNOWN", F.col("mode")),
        why(named.filter("path is null"), "EVALUATION_PATH_UNSAFE", F.col("value")),
        why(named.filter("path is not null").join(inside, ["case_id", "path"], "left_anti"), "EVALUATION_PATH_NOT_IN_INVENTORY", F.col("value")),
        why(cases.filter(bad_command), "EVALUATION_COMMANDS_INVALID", F.lit(None)),
    ]
    refused = reduce(DataFrame.unionByName, refused)
    return cases.join(refused.select("case_id").distinct(), "case_id", "left_anti"), refused


def verify_evaluations(results: DataFrame, contract: str, nested: str = "results", levels: int = 4) -> DataFrame:
    """``(receipt_id, at, well_formed, hash_matches, inner_sound)`` of evaluation results and of those nested in them.

    ``results`` (receipt_id, text): compact JSON with ``receiptHash``, the SHA-256 of the text without it. A result is well formed with
    schema version 1 and the contract's name. ``at`` is '' for the outer one and ``/0/2`` for the third result of its first one; ``inner_sound``
    says whether all below are well formed and match. Each level is the last one's results, at most ``levels`` deep.
    """
    level, rows = results.select("receipt_id", F.lit("").alias("at"), "text"), []
    given = F.regexp_extract("text", r'"receiptHash":"([0-9a-f]{64})"\}?$', 1)
    for _ in range(levels):
        # the receipt's own hash stands last; those of nested results stay in the text
        bare = F.regexp_replace("text", r',"receiptHash":"[0-9a-f]{64}"\}$', "}")
        sound = (F.get_json_object("text", "$.schemaVersion") == "1") & (F.get_json_object("text", "$.contract") == contract)
        rows.append(level.select("receipt_id", "at", F.coalesce(sound, F.lit(False)).alias("well_formed"), F.coalesce(F.sha2(bare, 256) == given, F.lit(False)).alias("hash_matches")))
        inner = level.select("receipt_id", "at", F.posexplode(F.from_json(F.get_json_object("text", f"$.{nested}"), "array<string>")).alias("i", "text"))
        level = inner.select("receipt_id", F.concat("at", F.lit("/"), F.col("i").cast("string")).alias("at"), "text")
    every = reduce(DataFrame.unionByName, rows)
    # what is wrong counts for all that it stands in
    parts = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    wrong = every.filter("at != '' and not (well_formed and hash_matches)").select("receipt_id", F.explode(above).alias("at")).distinct().withColumn("wrong", F.lit(True))
    return every.join(wrong, ["receipt_id", "at"], "left").select("receipt_id", "at", "well_formed", "hash_matches", F.col("wrong").isNull().alias("inner_sound"))
