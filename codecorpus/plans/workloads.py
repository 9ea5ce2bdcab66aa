"""Whole workloads as one plan of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.functions import scalars as S
from codecorpus.operators import behavior, callables, delta, extract_text, filters, graph, parse, project, resolve, semantic, state, traces
from codecorpus.operators.storage import spread, stored
from codecorpus.sources.index import FileIndex

KEYS = ["repo", "revision"]


def module_dependencies(files: DataFrame, most: int | None = 600) -> DataFrame:
    """Which modules depend on which, and how strongly: imports of eligible source files, resolved, rolled up."""
    src = filters.source_files(filters.eligible_text(files).filter("skip_reason is null"))
    resolved = resolve.resolve_imports(extract_text.extract_imports(src), src)
    pairs = resolved.filter("target is not null and not startswith(target, 'external:')").groupBy(*KEYS, F.col("path").alias("from_id"), F.col("target").alias("to_id")).agg(F.count("*").alias("count"))
    nodes = src.select(*KEYS, F.col("path").alias("node_id"), F.lit("file").alias("kind"), S.module_of(F.col("path")).alias("module"))
    return project.module_edges(pairs, nodes, most)


def indexed_parse(src: DataFrame, index: FileIndex) -> DataFrame:
    """``parse.parse_files`` of ``src``, reading what ``index`` has: only files that are new or changed are parsed, and the index takes them and forgets those that are gone.

    A file is known by its size and ``mtime``, or by its content's hash where ``src`` has no mtime.
    """
    stamp = F.col("mtime").cast("string") if "mtime" in src.columns else F.sha2("content", 256)
    now = src.withColumns({"size": F.octet_length("content").cast("long"), "mtime": stamp})
    known, manifest = index.rows(), index.manifest()
    if known is None:
        changed, touched = now, now
    else:
        plan = stored(delta.incremental_plan(now, known).filter("action != 'reuse'"), "index-plan")
        if plan.isEmpty():
            return _of_revision(known, now)
        changed, touched = now.join(plan.filter("action = 'parse'").select("repo", "path"), ["repo", "path"], "left_semi"), plan
    rows = parse.parse_files(changed).join(changed.select("repo", "path", "size", "mtime"), ["repo", "path"])
    index.commit(manifest["number"] + 1 if manifest else 0, rows, touched)
    return _of_revision(index.rows(), now)


def _of_revision(rows: DataFrame, src: DataFrame) -> DataFrame:
    return rows.drop("revision", "size", "mtime").join(src.select(*KEYS, "path"), ["repo", "path"])


def architecture(files: DataFrame, index: FileIndex | None = None) -> dict[str, DataFrame]:
    """Files to nodes, edges, symbols, calls and type relations: the tables of a reading.

    What is parsed from texts (imports, symbols, call sites) is written once in the shared folder, as many joins read
    it; the rest is lazy. With an ``index`` only files that have changed are parsed (indexed_parse).
    """
    src = filters.source_files(filters.eligible_text(files).filter("skip_reason is null"))
    src = spread(src, [*KEYS, "path"]) if index is None else src
    imports = stored(resolve.resolve_imports(extract_text.extract_imports(src), src.select(*KEYS, "path")), "imports")
    nodes, edges, unresolved = resolve.build_edges(imports, src)
    read = stored(parse.parse_files(src), "parsed") if index is None else indexed_parse(src, index)
    unique, diagnostics = resolve.unique_symbol_ids(parse.table_of(read, "symbols"))
    symbols, sites = stored(unique, "unique-symbols"), stored(parse.table_of(read, "sites"), "sites")
    bindings = parse.table_of(read, "bindings")
    bound = stored(resolve.bind_imports(parse.import_names(imports), symbols), "imported")
    types = stored(resolve.type_relations(symbols), "types")
    found = []
    if not sites.filter("path like '%.py'").isEmpty():
        python = stored(resolve.with_targets(sites.filter("path like '%.py'"), symbols, resolve.known_heads(bindings, symbols)), "python-sites")
        direct = stored(resolve.resolve_calls(python, symbols, bound, "python"), "direct-calls")
        noted = stored(resolve.resolve_calls(python, symbols, bound, "python", decorated=True), "decorated-calls")
        found.append(direct)
        if callables.calls_through_values(sites, symbols, bindings):
            found.append(callables.callable_calls(sites, symbols, bound, bindings, direct, noted))
        inherited = python.filter("callee_text like 'super().%' or callee_text like 'self.%'")
        if not inherited.isEmpty():
            found.append(resolve.inheritance_dispatch(inherited.select(sites.columns), symbols, types))
    for lang, pattern in (("rust", r"\.rs$"), ("script", r"\.([mc]?ts|tsx|[mc]?js|jsx)$")):
        if not found or not sites.filter(F.col("path").rlike(pattern)).isEmpty():
            found.append(resolve.resolve_calls(sites, symbols, bound, lang))
    candidates = stored(resolve.union_facts(*found), "call-candidates")
    calls = stored(resolve.merge_calls(candidates), "calls")
    variables = stored(state.module_variables(symbols, imports, bound), "module-variables")
    touched = [] if variables.isEmpty() else [stored(resolve.state_access(state.state_tokens(src, variables), variables, symbols), "state")]
    relations = stored(resolve.union_facts(types, resolve.override_relations(symbols, types), *touched), "relations")
    return {"nodes": nodes, "edges": edges, "unresolved": unresolved, "symbols": symbols, "sites": sites, "calls": calls, "call_candidates": candidates, "relations": relations, "diagnostics": diagnostics}


def resolved_sites(tables: dict[str, DataFrame]) -> DataFrame:
    """Call sites with their resolved target as (from_id, to_id), with arguments, branches and retries."""
    c = tables["call_candidates"].select(*KEYS, "path", F.col("owner_id").alias("from_id"), "ordinal", "callee_text", "to_id").distinct()
    s = tables["sites"].select(*KEYS, "path", F.col("owner_id").alias("from_id"), "ordinal", "callee_text", "line", "args", "branch_id", "arm", "retry_id", "max_attempts", "assigned_to", "returned")
    return s.join(c, [*KEYS, "path", "from_id", "ordinal", "callee_text"])


def semantic_layer(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Nodes, relations and workflows above a reading."""
    nodes, rels = semantic.contains_defines(tables["nodes"], tables["symbols"])
    outer, lifted = semantic.lift_relations(tables["edges"], tables["calls"], tables["relations"], tables["symbols"])
    entries, omitted = semantic.workflow_entries(tables["symbols"])
    entries = stored(entries, "entries")
    people = stored(semantic.workflow_participants(entries, resolved_sites(tables)), "participants")
    guards, control = semantic.flow_controls(people)
    return {"nodes": nodes.unionByName(outer), "relations": rels.unionByName(lifted), "entries": entries, "omitted": omitted, "participants": people, "flow": semantic.flow_precedes(people), "guards": guards, "control": control}


def behavior_layer(files: DataFrame, tables: dict[str, DataFrame], people: DataFrame) -> dict[str, DataFrame]:
    """Frameworks, passed arguments, returns, state read and written, and what each workflow takes and gives."""
    files = spread(files, [*KEYS, "path"])
    sites = resolved_sites(tables)
    candidates, exclusions = extract_text.framework_candidates(files, tables["symbols"])
    passes = behavior.behavior_passes(sites, tables["symbols"])
    returns = behavior.behavior_returns(sites, tables["symbols"], files)
    held = behavior.behavior_state_and_framework(tables["relations"], candidates)
    rels = passes.unionByName(returns).unionByName(held, allowMissingColumns=True)
    return {"detections": extract_text.detect_frameworks(files), "candidates": candidates, "exclusions": exclusions, "relations": rels, "workflows": behavior.behavior_workflows(people, rels)}


def revision_impact(base: tuple[DataFrame, DataFrame], head: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(node delta, files that depend on a changed one) of two readings (nodes, edges)."""
    nodes, _ = delta.graph_delta(*base, *head)
    changed = nodes.filter("status != 'removed'").select("repo", F.col("node_id").alias("start"))
    starts = changed.join(head[0].select(*KEYS, F.col("node_id").alias("start")), ["repo", "start"]).select(*KEYS, "start")
    reached, _ = graph.reach_all(head[1], starts, "up")
    return nodes, reached


def trace_comparison(events: DataFrame, static: DataFrame) -> DataFrame:
    """Trace events against static relations: pairs matched, only static, only observed."""
    return delta.compare_runtime(static, traces.observed_relations(events).join(events.select("session_id", "repo").distinct(), "session_id"))
