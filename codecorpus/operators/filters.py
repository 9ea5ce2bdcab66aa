"""Which files are read: eligibility, ignore rules, source extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions import scalars as S

TEXT_LIMIT = 1_500_000
# Folders that are never read, and extensions of binary files.
IGNORED_FOLDERS = [".git", "node_modules", "dist", "out", "build", "release", ".next", ".nuxt", ".venv", "venv", "__pycache__", "coverage", "test-results", "playwright-report", ".idea"]
BINARY = r"(?i)\.(png|jpe?g|gif|webp|ico|bmp|avif|mp[34]|wav|ogg|mov|avi|webm|pdf|zip|gz|tgz|7z|rar|jar|exe|dll|so|dylib|bin|wasm|woff2?|ttf|otf|eot|class|pyc|db|sqlite3?)$"


def eligible_text(files: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """``files`` with ``skip_reason``: null for text that is read, else binary-extension, oversized, invalid-utf8 or nul-byte."""
    size = F.coalesce(F.col("size"), F.octet_length("content")) if "size" in files.columns else F.octet_length("content")
    reason = (
        F.when(F.col("path").rlike(BINARY), "binary-extension")
        .when(size > limit, "oversized")
        .when(F.col("content").isNull(), "invalid-utf8")
        .when(F.col("content").contains("\0"), "nul-byte")
    )
    return files.withColumn("skip_reason", reason)


def in_ignored_folder(path):
    """Whether a folder of the path is one that is never read."""
    return F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*[F.lit(x) for x in IGNORED_FOLDERS]))


def ignore_rules(ignore_files: DataFrame) -> DataFrame:
    """Rows (repo, revision, folder, rule_no, negate, pattern): the lines of ignore files as regular expressions on whole paths.

    ``ignore_files`` has repo, revision, path and content. A rule with a slash is anchored at its folder, another matches at any
    depth below it; a rule ending in a slash matches folders only.
    """
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    lines = ignore_files.select("repo", "revision", folder.alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).filter("line != '' and not startswith(line, '#')")
    rule = F.regexp_replace("line", "^!", "")
    plain = F.regexp_replace(rule, "^/|/$", "")
    anchored = F.regexp_replace(rule, "/$", "").contains("/")
    body = F.regexp_replace(plain, r"([.+^$(){}|\[\]\\])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\*\*/", "\u0001"), r"\*\*", "\u0002"), r"\*", "[^/]*")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\?", "[^/]"), "\u0001", "(?:.*/)?"), "\u0002", ".*")
    lead = F.when(F.col("folder") == "", "").otherwise(F.concat(F.regexp_replace("folder", r"([.+*?^$(){}|\[\]\\])", r"\\$1"), F.lit("/")))
    tail = F.when(F.endswith(rule, F.lit("/")), "/.*").otherwise("(?:/.*)?")
    depth = F.length("folder") - F.length(F.regexp_replace("folder", "/", "")) + (F.col("folder") != "").cast("int")
    return lines.select(
        "repo",
        "revision",
        "folder",
        (depth * 1_000_000 + F.col("line_no")).alias("rule_no"),
        F.startswith("line", F.lit("!")).alias("negate"),
        F.concat(F.lit("^"), lead, F.when(anchored, "").otherwise("(?:.*/)?"), body, tail, F.lit("$")).alias("pattern"),
    )


def apply_ignores(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` (key repo, revision, path) without ignored ones: ignored folders, then the last rule that matches decides.

    A file meets the rules of its own revision that stand in a folder above it, and no others.
    """
    kept = files.filter(~in_ignored_folder(F.col("path")))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    hit = kept.select("repo", "revision", "path", F.explode(above).alias("folder")).join(rules, ["repo", "revision", "folder"]).filter("rlike(path, pattern)")
    last = hit.groupBy("repo", "revision", "path").agg(F.max_by("negate", "rule_no").alias("negate")).filter("not negate").select("repo", "revision", "path")
    return kept.join(last, ["repo", "revision", "path"], "left_anti")


def source_files(files: DataFrame) -> DataFrame:
    """Files with a source extension, with ``language`` and ``deep``."""
    ext = S.extension(F.col("path"))
    return files.withColumn("extension", ext).filter(F.col("extension").isin(S.SOURCE_EXTENSIONS)).withColumns({"language": S.language_of(F.col("extension")), "deep": F.col("extension").isin(S.DEEP_EXTENSIONS)})


def byte_budget(files: DataFrame, budget: int | None = None) -> DataFrame:
    """``files`` with ``within_budget``: true, in path order of a repository, until the running size passes ``budget`` (none: all true)."""
    if budget is None:
        return files.withColumn("within_budget", F.lit(True))
    w = W.partitionBy("repo", "revision").orderBy("path").rowsBetween(W.unboundedPreceding, 0)
    return files.withColumn("within_budget", F.sum("size").over(w) <= budget)
