"""Checks of every layer: each gives diagnostics (repo, revision, layer, code, severity, subject); those of traces, which have no revision, a null one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEYS = ["repo", "revision"]


def _diag(df: DataFrame, layer: str, code: str, subject: str | Column, severity: str = "error") -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    revision = F.col("revision") if "revision" in df.columns else F.lit(None).cast("string")
    return df.select("repo", revision.alias("revision"), F.lit(layer).alias("layer"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _identity(df: DataFrame, layer: str, id_col: str) -> list[DataFrame]:
    twice = df.groupBy(*KEYS, id_col).count().filter("count > 1")
    return [_diag(df.filter(f"{id_col} is null or {id_col} = ''"), layer, "ID_MISSING", F.lit("")), _diag(twice.filter(f"{id_col} is not null and {id_col} != ''"), layer, "ID_DUPLICATE", id_col)]


def _missing_end(df: DataFrame, known: DataFrame, layer: str, code: str, column: str, id_col: str, severity: str = "error") -> DataFrame:
    ids = known.select(*KEYS, F.col("node_id").alias(column)).distinct()
    return _diag(df.filter(F.col(column).isNotNull()).join(ids, [*KEYS, column], "left_anti"), layer, code, id_col, severity)


def _evidence(df: DataFrame, files: DataFrame, layer: str, id_col: str, required: Column) -> list[DataFrame]:
    """Missing, invalid, stale and repeated evidence of rows with an ``evidence`` array."""
    e = df.select(*KEYS, id_col, F.explode("evidence").alias("e")).select(*KEYS, id_col, "e.*")
    known = files.select(*KEYS, "path", F.col("hash").alias("file_hash"))
    j = e.join(known, [*KEYS, "path"], "left")
    bad_line = (F.col("line") < 1) | (F.coalesce("end_line", "line") < F.col("line")) | F.col("line").isNull()
    twice = e.groupBy(*KEYS, id_col, "path", "line", F.coalesce("end_line", "line").alias("stop")).count().filter("count > 1")
    return [
        _diag(df.filter(required & (F.size("evidence") <= 0)), layer, "EVIDENCE_MISSING", id_col),
        _diag(j.filter(bad_line), layer, "EVIDENCE_INVALID", id_col),
        _diag(j.filter("file_hash is null"), layer, "EVIDENCE_PATH_UNKNOWN", id_col),
        _diag(j.filter("file_hash is not null and hash != file_hash"), layer, "EVIDENCE_HASH_MISMATCH", id_col),
        _diag(twice, layer, "EVIDENCE_DUPLICATE", id_col, "warning"),
    ]


def validate_architecture(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Missing and repeated ids, ends that are no node, and evidence of edges."""
    files = nodes.filter("kind = 'file'").select(*KEYS, "path", "hash")
    parts = [*_identity(nodes, "architecture", "node_id"), *_identity(edges, "architecture", "edge_id")]
    parts += [_missing_end(edges, nodes, "architecture", "EDGE_SOURCE_MISSING", "from_id", "edge_id"), _missing_end(edges, nodes, "architecture", "EDGE_TARGET_MISSING", "to_id", "edge_id")]
    return _all(parts + _evidence(edges, files, "architecture", "edge_id", F.lit(True)))


def _trust(df: DataFrame, layer: str, id_col: str) -> list[DataFrame]:
    return [
        _diag(df.filter("trust not in ('verified', 'inferred', 'authored', 'observed')"), layer, "TRUST_UNKNOWN", id_col),
        _diag(df.filter("status not in ('accepted', 'provisional', 'corroborated', 'conflicting', 'stale')"), layer, "STATUS_UNKNOWN", id_col),
        _diag(df.filter("trust = 'verified' and status != 'accepted'"), layer, "VERIFIED_NOT_ACCEPTED", id_col),
        _diag(df.filter("trust = 'inferred' and status = 'accepted'"), layer, "INFERRED_ACCEPTED", id_col),
        _diag(df.filter(F.col("confidence").isNull() | F.isnan("confidence") | ~F.col("confidence").between(0, 1)), layer, "CONFIDENCE_RANGE", id_col),
    ]


def validate_semantic(nodes: DataFrame, relations: DataFrame, claims: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """Ends, confidence, trust and status of nodes and relations; subjects of claims and questions."""
    parts = [*_identity(nodes, "semantic", "node_id"), *_trust(nodes, "semantic", "node_id")]
    rel = relations if "rel_id" in relations.columns else relations.withColumn("rel_id", F.concat_ws(":", "from_id", "kind", "to_id"))
    parts += _trust(rel, "semantic", "rel_id")
    parts += [_missing_end(rel, nodes, "semantic", "RELATION_SOURCE_MISSING", "from_id", "rel_id"), _missing_end(rel, nodes, "semantic", "RELATION_TARGET_MISSING", "to_id", "rel_id")]
    for name, df in (("CLAIM", claims), ("QUESTION", questions)):
        if df is not None:
            parts.append(_missing_end(df, nodes, "semantic", f"{name}_SUBJECT_MISSING", "subject_id", "subject_id"))
    return _all(parts)


def validate_behavior(values: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends and values of behaviour relations, completeness of their provenance, and sessions of observed ones."""
    r = relations
    parts = [*_identity(r, "behavior", "rel_id"), *_trust(r, "behavior", "rel_id")]
    parts += [_missing_end(r, nodes, "behavior", "RELATION_SOURCE_MISSING", "from_id", "rel_id"), _missing_end(r, nodes, "behavior", "RELATION_TARGET_MISSING", "to_id", "rel_id")]
    ids = values.select(*KEYS, "value_id").distinct()
    parts.append(_diag(r.filter("value_id is not null").join(ids, [*KEYS, "value_id"], "left_anti"), "behavior", "VALUE_MISSING", "rel_id"))
    parts.append(_diag(r.filter("resolver is null or resolver = ''"), "behavior", "PROVENANCE_INCOMPLETE", "rel_id"))
    parts.append(_diag(r.filter("trust = 'observed' and session_id is null"), "behavior", "SESSION_MISSING", "rel_id"))
    return _all(parts)


def validate_framework(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Every candidate has a behaviour relation of its framework and target."""
    have = relations.filter("framework is not null").select(*KEYS, "framework", "to_id").distinct()
    return _all([*_identity(candidates, "framework", "candidate_id"), _diag(candidates.join(have, [*KEYS, "framework", "to_id"], "left_anti"), "framework", "RELATION_MISSING", "candidate_id")])


def validate_trace(sessions: DataFrame, events: DataFrame, symbols: DataFrame) -> DataFrame:
    """Contiguous sequences, known symbols (an error in the session's own revision, else a warning), non-negative times, status with completion, command digest of 64 hex characters.

    ``sessions`` (repo, session_id, status, completed_at, command_digest, same_revision); ``events`` (repo, session_id, sequence, symbol_id, offset_ms, duration_ms).
    """
    w = W.partitionBy("repo", "session_id").orderBy("sequence")
    e = events.withColumn("k", F.row_number().over(w))
    subject = F.concat_ws(":", "session_id", F.col("sequence").cast("string"))
    unknown = events.join(symbols.select("repo", "symbol_id").distinct(), ["repo", "symbol_id"], "left_anti").join(sessions.select("repo", "session_id", "same_revision"), ["repo", "session_id"])
    finished = F.col("status").isin("completed", "failed", "interrupted")
    return _all(
        [
            _diag(e.filter("k != sequence"), "trace", "SEQUENCE_GAP", subject),
            _diag(events.filter("offset_ms < 0 or duration_ms < 0"), "trace", "TIME_NEGATIVE", subject),
            _diag(unknown.filter("same_revision"), "trace", "SYMBOL_UNKNOWN", subject),
            _diag(unknown.filter("not same_revision"), "trace", "SYMBOL_UNKNOWN", subject, "warning"),
            _diag(sessions.filter(finished != F.col("completed_at").isNotNull()), "trace", "COMPLETION_MISMATCH", "session_id"),
            _diag(sessions.filter(~F.coalesce(F.col("command_digest").rlike("^[0-9a-f]{64}$"), F.lit(False))), "trace", "COMMAND_DIGEST", "session_id"),
        ]
    )
