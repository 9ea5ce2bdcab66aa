"""Reading source collections, journals, traces and oracles; writing and reading snapshots and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.functions import scalars as S
from codecorpus.operators import evaluation
from codecorpus.sources.index import FileIndex

KEYS = ["repo", "revision"]

RUN_EVENT = "event_id string, run_id string, sequence long, ts string, type string, payload string, payload_hash string"
CLAIMS = "schemaVersion int, claims array<struct<subjectId:string,key:string,value:string,reason:string>>"
CLAIM_KEYS = ["boundary", "responsibility", "workflow", "behavior"]
EVAL_CASE = "case_id string, goal string, mode string, inventory array<string>, selected_paths array<string>, changed_paths array<string>, required_paths array<string>, forbidden_paths array<string>, expected_verification_passed boolean, commands array<string>"


def read_corpus(spark: SparkSession, root: str, repo: str | None = None, revision: str = "0", glob: str | None = None, skip_folders: list[str] = (), max_bytes: int | None = None, skip_names: str | None = None) -> DataFrame:
    """Source trees below ``root`` as ``files``; without ``repo`` the first folder below the root names the repository.

    Files in one of ``skip_folders`` below the root (filters.IGNORED_FOLDERS), larger than ``max_bytes`` or with a name like the pattern
    ``skip_names`` (filters.BINARY) are left out as the scan is planned, so none of their bytes are read. Texts that aren't
    UTF-8 keep a null ``content``; their bytes stay in ``raw``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    below = F.regexp_replace(F.expr("url_decode(path)"), "^.*?" + _quoted(root.rstrip("/").split("://")[-1].rstrip("/").split("/")[-1]) + "/", "")
    df = reader.load(root)
    # conditions on a file's own facts prune the list of files
    where = F.col("_metadata.file_path")
    base = root.rstrip("/").split("://")[-1].rstrip("/").split("/")[-1]
    if skip_folders:
        df = df.filter(~F.regexp_replace(where, "^.*?/" + _quoted(base) + "/", "").rlike("(^|/)(" + "|".join(_quoted(f) for f in skip_folders) + ")/"))
    if skip_names:
        df = df.filter(~where.rlike(skip_names))
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    df = df.withColumn("below", below)
    name = F.lit(repo) if repo else F.split("below", "/")[0]
    path = F.col("below") if repo else F.expr("substr(below, instr(below, '/') + 1)")
    valid = F.expr("is_valid_utf8(cast(content as string))")
    return df.select(
        name.alias("repo"),
        F.lit(revision).alias("revision"),
        path.alias("path"),
        S.extension(path).alias("extension"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
        F.when(valid, F.col("content").cast("string")).alias("content"),
        F.sha2("content", 256).alias("hash"),
        F.col("content").alias("raw"),
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_call_oracle(spark: SparkSession, path: str, dynamic: bool = False, roots: list[str] = (), declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(oracle_edges, declared) of adjacency files ``{caller: [callee, ..]}``; the file's folder names the case.

    With ``declared`` (case_id, name) a name is the first of its candidates that its case declares, and only edges between callers count
    (evaluation.oracle_edges); without, it is its first candidate.
    """
    text = spark.read.text(path, wholetext=True).withColumn("case_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    pairs = text.select("case_id", F.explode(F.from_json("value", "map<string,array<string>>")).alias("from_name", "callees"))
    if declared is not None:
        return evaluation.oracle_edges(pairs.select("case_id", "from_name"), pairs.select("case_id", "from_name", F.explode("callees").alias("to_name")), declared, dynamic, roots)
    one = lambda c: S.oracle_names(F.col(c), dynamic, roots)[0]
    edges = pairs.select("case_id", one("from_name").alias("from_name"), F.explode("callees").alias("to_name")).withColumn("to_name", one("to_name")).distinct()
    return edges, pairs.select("case_id", one("from_name").alias("name")).distinct()


def read_run_journal(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Run events of newline-delimited JSON; a damaged record has ``_corrupt_record`` and no event."""
    schema = RUN_EVENT + ", _corrupt_record string"
    reader = (spark.readStream if streaming else spark.read).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(path)


def journal_diagnostics(events: DataFrame) -> DataFrame:
    """A row for each damaged record of a journal."""
    return events.filter("_corrupt_record is not null").select(F.lit("journal").alias("layer"), F.lit("RECORD_CORRUPT").alias("code"), F.lit("error").alias("severity"), F.substring("_corrupt_record", 1, 200).alias("message"))


def read_trace_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw log lines as ``line``, with the file they come from as ``source``."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))


def parse_authored_claims(documents: DataFrame, column: str = "document", most: int = 500, longest: int = 4000) -> DataFrame:
    """Claims of authored documents. A document with another version, a bad claim or too many claims is refused whole."""
    doc = F.from_json(column, CLAIMS)
    claims = doc["claims"]
    good = (
        (doc["schemaVersion"] == 1)
        & (F.size(claims) <= most)
        & F.forall(claims, lambda c: F.coalesce((F.length(c["subjectId"]) > 0) & c["key"].isin(CLAIM_KEYS) & (F.length(F.trim(c["value"])) > 0) & (F.length(c["value"]) <= longest), F.lit(False)))
    )
    others = [c for c in documents.columns if c != column]
    kept = documents.filter(F.coalesce(good, F.lit(False))).select(*others, F.explode(claims).alias("c"))
    return kept.select(*others, F.col("c.subjectId").alias("subject_id"), F.col("c.key").alias("key"), F.col("c.value").alias("value"), F.col("c.reason").alias("reason"))


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Immutable tables of a reading, partitioned by repo and revision; an existing snapshot is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy(*KEYS).parquet(f"{path}/{name}")
    counts = None
    for name, df in tables.items():
        one = df.groupBy(*KEYS).agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    counts.write.mode("errorifexists").parquet(f"{path}/_index_rows")


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a snapshot, of the revisions that its index names with the same count."""
    df = spark.read.parquet(f"{path}/{name}")
    index = spark.read.parquet(f"{path}/_index_rows").filter(F.col("table") == name).select(*[F.col(k).cast("string") for k in KEYS], "n")
    sound = df.groupBy(*KEYS).agg(F.count("*").alias("n")).select(*[F.col(k).cast("string") for k in KEYS], "n").join(index, [*KEYS, "n"], "left_semi").select(*KEYS)
    return df.join(sound, KEYS, "left_semi")


def write_index(files: DataFrame, path: str, analyzer_version: str) -> None:
    """Durable parsed index of ``files`` (repo, path, ..), in place of what is there; see index.FileIndex for batches of changes.

    A column ``root`` says where a repository was read from.
    """
    index = FileIndex(files.sparkSession, path, analyzer_version)
    index.commit((index.manifest() or {"number": -1})["number"] + 1, files, files, replace=True)


def read_index(spark: SparkSession, path: str, analyzer_version: str, roots: DataFrame | None = None) -> DataFrame | None:
    """The index rows of this analyzer version and, with ``roots`` (repo, root), of these roots; others are ignored. None without an index."""
    return FileIndex(spark, path, analyzer_version).rows(roots=roots)


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON files with everything in one object, each with ``valid`` (check_eval_cases)."""
    return check_eval_cases(spark.read.schema(EVAL_CASE).option("multiLine", True).json(path))


def read_eval_folders(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(cases, inventory) of case folders: request, expected-scope, assertions and allowed-commands as JSON files, the files below ``project`` as inventory.

    evaluation.check_cases says which cases are refused; the inventory's bytes aren't read.
    """
    case = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    read = lambda name, ddl: spark.read.schema(ddl).option("multiLine", True).json(f"{root}/*/{name}.json").select(case.alias("case_id"), "*")
    cases = read("request", "goal string, mode string")
    parts = [
        read("expected-scope", "selectedPaths array<string>, changedPaths array<string>").withColumnsRenamed({"selectedPaths": "selected_paths", "changedPaths": "changed_paths"}),
        read("assertions", "requiredPaths array<string>, forbiddenPaths array<string>, verificationPassed boolean").withColumnsRenamed({"requiredPaths": "required_paths", "forbiddenPaths": "forbidden_paths", "verificationPassed": "expected_verification_passed"}),
        read("allowed-commands", "commands array<string>"),
    ]
    for part in parts:
        cases = cases.join(part, "case_id", "left")
    below = F.expr("url_decode(path)")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/*/project").select(below.alias("at"))
    inventory = files.select(F.regexp_extract("at", r"([^/]+)/project/.+$", 1).alias("case_id"), F.regexp_extract("at", r"[^/]+/project/(.+)$", 1).alias("path"))
    return cases, inventory


def check_eval_cases(cases: DataFrame) -> DataFrame:
    """Cases with ``valid``: false where a path is not in the case's inventory."""
    named = F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("selected_paths", "changed_paths", "required_paths", "forbidden_paths")])))
    return cases.withColumn("valid", F.size(F.array_except(named, F.coalesce("inventory", F.array().cast("array<string>")))) == 0)
