"""From names to things: import targets, owners of lines, callees, bases, and their merged relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions import scalars as S
from codecorpus.operators.storage import stored

KEYS = ["repo", "revision"]
TS_SUFFIXES = ["ts", "tsx", "js", "jsx", "json", "css", "vue", "svelte"]


def _folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def _up(folder: Column, levels: Column) -> Column:
    """The folder ``levels`` above; null if there is none."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.when(F.size(parts) >= levels, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), "/"))


def _join(folder: Column, rest: Column) -> Column:
    """Folder and rest with ``.`` and ``..`` worked off; null if that leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, rest), "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array(F.lit("\0"))),
    )
    return F.when(~F.array_contains(done, "\0"), F.array_join(done, "/"))


def import_candidates(path: Column, specifier: Column) -> Column:
    """Paths that an import may mean, best first."""
    spec = F.split(specifier, r"\?")[0]
    ext, folder = S.extension(path), _folder(path)
    dots = F.length(F.regexp_extract(spec, r"^\.+", 0))
    rest = F.translate(F.substr(spec, dots + 1), ".", "/")
    base = F.when(dots > 0, _join(_up(folder, dots - 1), rest)).otherwise(F.translate(spec, ".", "/"))
    python = F.array(F.concat(base, F.lit(".py")), F.concat(F.when(base == "", "").otherwise(F.concat(base, F.lit("/"))), F.lit("__init__.py")))
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s+as\s+\w+$", ""), "::"), lambda p: p != "")
    supers = F.size(F.filter(parts, lambda p: p == "super"))
    root = F.when(parts[0] == "crate", "src").when(parts[0] == "self", folder).when(parts[0] == "super", _up(folder, supers))
    names = F.slice(parts, F.when(parts[0] == "super", supers).otherwise(1) + 1, F.size(parts))
    lengths = F.when(F.size(names) > 0, F.reverse(F.sequence(F.lit(1), F.size(names)))).otherwise(F.array().cast("array<int>"))
    rust = F.flatten(
        F.transform(lengths, lambda n: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda tail: F.concat(F.when(root == "", "").otherwise(F.concat(root, F.lit("/"))), F.array_join(F.slice(names, 1, n), "/"), tail)))
    )
    rust = F.when(parts[0].isin("crate", "self", "super"), rust).otherwise(F.array().cast("array<string>"))
    target = _join(folder, spec)
    script = F.concat(F.array(target), *[F.array(F.concat(target, F.lit(f".{s}")), F.concat(target, F.lit(f"/index.{s}"))) for s in TS_SUFFIXES])
    script = F.when(spec.startswith("."), script).otherwise(F.array().cast("array<string>"))
    return F.array_compact(F.when(ext == "py", python).when(ext == "rs", rust).otherwise(script))


def external_package(path: Column, specifier: Column) -> Column:
    """``external:<package>`` of an import that no file answers; null where it can only mean a file."""
    spec, ext = F.split(specifier, r"\?")[0], S.extension(path)
    first = F.filter(F.split(spec, "::"), lambda p: p != "")[0]
    package = F.when(spec.startswith("@"), F.array_join(F.slice(F.split(spec, "/"), 1, 2), "/")).otherwise(F.split(spec, "/")[0])
    name = F.when(ext == "py", F.when(~spec.startswith("."), F.split(spec, r"\.")[0])).when(ext == "rs", F.when(~first.isin("crate", "self", "super"), first)).otherwise(F.when(~spec.startswith("."), package))
    return F.when(name != "", F.concat(F.lit("external:"), name))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` with ``target``: a file's path, ``external:<package>``, or null for an unresolved one.

    Candidates depend on folder and specifier only, so each distinct pair of a repository is looked up once.
    """
    keyed = imports.withColumn("_dir", _folder(F.col("path"))).withColumn("_ext", S.extension(F.col("path")))
    asked = keyed.select(*KEYS, "_dir", "_ext", "specifier").distinct()
    like = F.concat(F.when(F.col("_dir") == "", "").otherwise(F.concat("_dir", F.lit("/"))), F.lit("x."), F.col("_ext"))
    asked = asked.withColumn("_like", like)
    cand = asked.select(*KEYS, "_dir", "_ext", "specifier", F.posexplode(import_candidates(F.col("_like"), F.col("specifier"))).alias("rank", "candidate"))
    known = files.select(*KEYS, F.col("path").alias("candidate"))
    best = cand.join(known, [*KEYS, "candidate"]).groupBy(*KEYS, "_dir", "_ext", "specifier").agg(F.min_by("candidate", "rank").alias("file"))
    found = keyed.join(best, [*KEYS, "_dir", "_ext", "specifier"], "left")
    return found.withColumn("target", F.coalesce("file", external_package(F.col("path"), F.col("specifier")))).drop("_dir", "_ext", "file")


def build_edges(resolved: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arch_nodes, arch_edges, unresolved): file and external nodes; imports grouped by file, kind and target with their evidence."""
    hashes = files.select(*KEYS, "path", "hash") if "hash" in files.columns else files.select(*KEYS, "path", S.content_hash(F.col("content")).alias("hash"))
    ev = F.struct(F.col("path"), F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("end_line"), F.col("hash"), F.col("excerpt"))
    edges = resolved.filter("target is not null").join(hashes, [*KEYS, "path"])
    edges = edges.groupBy(*KEYS, F.col("path").alias("from_id"), "kind", F.col("target").alias("to_id")).agg(F.count("*").alias("count"), F.array_sort(F.collect_list(ev)).alias("evidence"))
    edges = edges.withColumn("edge_id", F.concat_ws(":", "from_id", "kind", "to_id"))
    ext = S.extension(F.col("path"))
    label = F.element_at(F.split("path", "/"), -1)
    nodes = hashes.select(*KEYS, F.col("path").alias("node_id"), label.alias("label"), F.lit("file").alias("kind"), "path", S.module_of(F.col("path")).alias("module"), S.language_of(ext).alias("language"), F.lit(1).cast("long").alias("count"), "hash")
    outer = edges.filter(F.col("to_id").startswith("external:")).select(*KEYS, "to_id").distinct()
    outer = outer.select(*KEYS, F.col("to_id").alias("node_id"), F.substr("to_id", F.lit(10)).alias("label"), F.lit("external").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit("external").alias("module"), F.lit("package").alias("language"), F.lit(1).cast("long").alias("count"), F.lit("").alias("hash"))
    return nodes.unionByName(outer), edges, resolved.filter("target is null").drop("target")


#: Widths of the grids of lines, and the span from which a symbol is in the next coarser one: 64 times the width.
GRID = (16, 1 << 10, 1 << 16, 1 << 31)


def _around(spots: DataFrame, spans: DataFrame) -> DataFrame:
    """``spots`` (path, line) with each of the ``spans`` (path, o_line, o_end, ..) around it.

    They meet in cells of lines: a span is in at most 65 cells of the grid for its length, a spot in one of each grid. So a spot
    meets what is around it and the few short spans of its cell, however many the file has.
    """
    size = F.col("o_end") - F.col("o_line")
    grid = F.lit(len(GRID) - 1)
    for i in range(len(GRID) - 2, -1, -1):
        grid = F.when(size < 64 * GRID[i], i).otherwise(grid)
    width = F.element_at(F.array(*[F.lit(w) for w in GRID]), F.col("grid") + 1)
    cells = spans.filter("o_end >= o_line").withColumn("grid", grid)
    cells = cells.withColumn("cell", F.explode(F.sequence(F.floor(F.col("o_line") / width), F.floor(F.col("o_end") / width))))
    at = spots.withColumn("g", F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), F.floor(F.col("line") / w).alias("cell")) for i, w in enumerate(GRID)])))
    return at.select("*", "g.grid", "g.cell").drop("g").join(cells, [*KEYS, "path", "grid", "cell"]).filter("line between o_line and o_end").drop("grid", "cell")


def owner_at_line(points: DataFrame, symbols: DataFrame, keep_without: bool = False) -> DataFrame:
    """``points`` (path, line) with ``owner_id``: the innermost callable around the line - the smallest span, then the latest start."""
    sym = symbols.filter(F.col("kind").isin(S.CALLABLE_KINDS)).select(*KEYS, "path", F.col("symbol_id").alias("owner_id"), F.col("line").alias("o_line"), F.col("end_line").alias("o_end"))
    inner = _around(points.select(*KEYS, "path", "line").distinct(), sym)
    inner = inner.groupBy(*KEYS, "path", "line").agg(F.min_by("owner_id", F.struct(F.col("o_end") - F.col("o_line"), -F.col("o_line"), "owner_id")).alias("owner_id"))
    return points.join(inner, [*KEYS, "path", "line"], "left" if keep_without else "inner")


def unique_symbol_ids(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols with distinct ids, diagnostics): a repeated ``path#name:line`` gets ``@offset``, then ``.2``, ``.3``; a file with a repeat left loses its symbols."""
    by = [*KEYS, "path", "symbol_id"]
    s = symbols.withColumn("_n", F.count("*").over(W.partitionBy(*by)))
    s = s.withColumn("symbol_id", F.when(F.col("_n") > 1, F.concat("symbol_id", F.lit("@"), F.col("start_offset").cast("string"))).otherwise(F.col("symbol_id"))).drop("_n")
    s = s.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy("start_offset", "name", "kind")))
    s = s.withColumn("symbol_id", F.when(F.col("_k") > 1, F.concat("symbol_id", F.lit("."), F.col("_k").cast("string"))).otherwise(F.col("symbol_id"))).drop("_k")
    broken = s.groupBy(*by).count().filter("count > 1").select(*KEYS, "path").distinct()
    diag = broken.select(*KEYS, F.lit("symbols").alias("layer"), F.lit("SYMBOL_ID_COLLISION").alias("code"), F.lit("warning").alias("severity"), F.col("path").alias("subject"))
    return s.join(broken, [*KEYS, "path"], "left_anti"), diag


def bind_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imported names: (path, local_name, symbol_id or module_path). ``imports`` has target, item (null for a module) and local_name.

    A name binds a top-level symbol only if the target file has exactly one of that name.
    """
    top = symbols.filter("container_id is null").select(*KEYS, F.col("path").alias("target"), F.col("name").alias("item"), "symbol_id")
    top = top.withColumn("n", F.count("*").over(W.partitionBy(*KEYS, "target", "item"))).filter("n = 1").drop("n")
    items = imports.filter("item is not null").join(top, [*KEYS, "target", "item"]).select(*KEYS, "path", "local_name", "symbol_id", F.lit(None).cast("string").alias("module_path"))
    modules = imports.filter("item is null and target not like 'external:%'").select(*KEYS, "path", "local_name", F.lit(None).cast("string").alias("symbol_id"), F.col("target").alias("module_path"))
    return items.unionByName(modules).distinct()


def _unique(symbols: DataFrame, *by: str) -> DataFrame:
    return symbols.withColumn("_n", F.count("*").over(W.partitionBy(*KEYS, *by))).filter("_n = 1").drop("_n")


CALL_COLUMNS = ["path", "owner_id", "callee_text", "line", "ordinal"]


def known_heads(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """What the first name of a Python call stands for: (scope, head, line, stands_for, instance).

    ``bindings`` are those of parse.parse_files. A scope is a callable for its aliases, instances (``x = C()``) and
    annotated parameters, a class for the fields (``self.x = ..``) that its methods set, a path for names of the file.
    """
    own = bindings.filter(F.col("binding").isin("alias", "receiver", "self") & F.col("path").endswith(".py"))
    own = own.select(*KEYS, "path", "owner_id", F.col("left_name").alias("head"), "line", F.when(F.col("binding") == "self", "self").otherwise(F.col("right_name")).alias("stands_for"), (F.col("binding") == "receiver").alias("instance"))
    field = F.col("head").startswith("self.")
    holder = symbols.select(*KEYS, F.col("symbol_id").alias("owner_id"), "container_id")
    fields = own.filter(field).join(holder, [*KEYS, "owner_id"]).filter("container_id is not null").select(*KEYS, F.col("container_id").alias("scope"), "head", F.lit(0).alias("line"), "stands_for", "instance")
    names = own.filter(~field).select(*KEYS, F.coalesce("owner_id", "path").alias("scope"), "head", F.when(F.col("owner_id").isNull(), 0).otherwise(F.col("line")).alias("line"), "stands_for", "instance")
    typed = symbols.filter(F.col("kind").isin(S.CALLABLE_KINDS) & F.col("path").endswith(".py"))
    typed = typed.select(*KEYS, F.col("symbol_id").alias("scope"), F.explode(F.regexp_extract_all("signature", F.lit(r"[A-Za-z_]\w*\s*:\s*[\"']?[A-Z][\w.]*"), F.lit(0))).alias("p"))
    typed = typed.select(*KEYS, "scope", F.regexp_extract("p", r"^(\w+)", 1).alias("head"), F.lit(0).alias("line"), F.regexp_extract("p", r":\s*[\"']?([\w.]+)$", 1).alias("stands_for"), F.lit(True).alias("instance"))
    return fields.unionByName(names).unionByName(typed)


def with_targets(sites: DataFrame, symbols: DataFrame, heads: DataFrame) -> DataFrame:
    """Python ``sites`` with ``target_text``: the call with its first name put as what it stands for there, else as it is.

    The last binding above the call in its own callable counts, then one of its class or file. An instance only stands
    for calls of its methods.
    """
    s = sites.join(symbols.select(*KEYS, F.col("symbol_id").alias("owner_id"), "container_id"), [*KEYS, "owner_id"], "left")
    first, second = F.regexp_extract("callee_text", r"^(\w+)", 1), F.regexp_extract("callee_text", r"^(self\.\w+)\.", 1)
    asked = s.withColumn("head", F.when(second != "", second).otherwise(first))
    scopes = F.array(*[F.struct(F.col(c).alias("scope"), F.lit(r).alias("near")) for r, c in enumerate(("owner_id", "container_id", "path"))])
    asked = asked.select(*KEYS, *CALL_COLUMNS, "head", F.explode(scopes).alias("x")).select(*KEYS, *CALL_COLUMNS, "head", "x.scope", "x.near").filter("scope is not null and head not in ('self', '')")
    hit = asked.join(heads.withColumnRenamed("line", "bound_at"), [*KEYS, "scope", "head"]).filter((F.col("bound_at") < F.col("line")) & (F.col("stands_for") != F.col("head")))
    rest = F.substr("callee_text", F.length("head") + 1)
    hit = hit.filter(~F.col("instance") | rest.startswith("."))
    best = hit.groupBy(*KEYS, *CALL_COLUMNS).agg(F.min_by(F.concat("stands_for", rest), F.struct("near", (-F.col("bound_at")).alias("up"), "stands_for")).alias("target_text"))
    return sites.join(best, [*KEYS, *CALL_COLUMNS], "left").withColumn("target_text", F.coalesce("target_text", "callee_text"))


def resolve_calls(sites: DataFrame, symbols: DataFrame, bindings: DataFrame, language: str, decorated: bool = False) -> DataFrame:
    """``call_candidates`` of call sites: one row for each resolved site, with target, confidence and resolver.

    Where sites have ``target_text`` (with_targets), that is what is looked up. Calls of decorated Python functions are
    left to callables.callable_calls, which knows what the decorators return.

    Each rule is an equi join on repository, file (or container) and name; uniqueness is counted before the join,
    and the lowest rank that answers a site wins. Rules: imported name, alias of a module, unique function of the
    file, method of the own container, method of a named class, and for Rust the methods of the type's blocks.
    """
    sep = "::" if language == "rust" else "."
    own = ["self", "Self"] if language == "rust" else ["self", "this"]
    exts = {"python": ["py"], "rust": ["rs"]}.get(language, ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"])
    asked = F.col("target_text") if "target_text" in sites.columns else F.col("callee_text")
    dotted = F.regexp_replace(asked, r"\.", sep) if language == "rust" else asked
    s = sites.filter("owner_id is not null").filter(S.extension(F.col("path")).isin(exts)).withColumn("parts", F.split(dotted, sep.replace(".", r"\.")))
    s = s.withColumn("head", F.col("parts")[0]).withColumn("last", F.element_at("parts", -1)).withColumn("depth", F.size("parts"))
    fns = symbols.filter(F.col("kind").isin(S.CALLABLE_KINDS))
    keep = [*KEYS, *CALL_COLUMNS]
    high = 0.92
    answers = []

    def answer(df, rank, confidence):
        answers.append(df.select(*keep, F.col("to_id"), F.lit(rank).alias("rank"), F.lit(confidence).alias("confidence")))

    named = bindings.filter("symbol_id is not null").select(*KEYS, "path", F.col("local_name").alias("head"), F.col("symbol_id").alias("to_id"))
    callable_ids = fns.select(*KEYS, F.col("symbol_id").alias("to_id"))
    answer(s.filter("depth = 1").join(named, [*KEYS, "path", "head"]).join(callable_ids, [*KEYS, "to_id"], "left_semi"), 1, high)
    owners = symbols.select(*KEYS, F.col("symbol_id").alias("owner_id"), F.col("container_id").alias("owner_container"))
    local = _unique(fns.filter("container_id is not null"), "container_id", "name").select(*KEYS, F.col("container_id").alias("owner_id"), F.col("name").alias("head"), F.col("symbol_id").alias("to_id"))
    answer(s.filter("depth = 1").join(local, [*KEYS, "owner_id", "head"]), 2, 0.90)
    top = _unique(fns if language == "python" else fns.filter("container_id is null"), "path", "name").select(*KEYS, "path", F.col("name").alias("head"), F.col("symbol_id").alias("to_id"))
    answer(s.filter("depth = 1").join(top, [*KEYS, "path", "head"]), 3, high if language == "rust" else 0.90)
    methods = _unique(fns.filter("container_id is not null"), "container_id", "name").select(*KEYS, F.col("container_id").alias("owner_container"), F.col("name").alias("last"), F.col("symbol_id").alias("to_id"))
    mine = s.filter(F.col("head").isin(own) & (F.col("depth") == 2)).join(owners, [*KEYS, "owner_id"]).join(methods, [*KEYS, "owner_container", "last"])
    answer(mine, 4, 0.85 if language == "rust" else 0.84)
    modules = bindings.filter("module_path is not null").select(*KEYS, "path", F.col("local_name").alias("head"), "module_path")
    tops = _unique(fns.filter("container_id is null"), "path", "name").select(*KEYS, F.col("path").alias("module_path"), F.col("name").alias("last"), F.col("symbol_id").alias("to_id"))
    answer(s.filter("depth = 2").join(modules, [*KEYS, "path", "head"]).join(tops, [*KEYS, "module_path", "last"]), 5, high if language == "rust" else 0.90)
    holders = symbols.filter(F.col("kind").isin("class", "trait", "struct", "enum"))
    here = _unique(holders, "path", "name").select(*KEYS, "path", F.col("name").alias("head"), F.col("symbol_id").alias("owner_container"))
    imported = bindings.filter("symbol_id is not null").select(*KEYS, "path", F.col("local_name").alias("head"), F.col("symbol_id").alias("owner_container"))
    answer(s.filter("depth = 2").join(here.unionByName(imported).distinct(), [*KEYS, "path", "head"]).join(methods, [*KEYS, "owner_container", "last"]), 6, 0.90)
    if language == "rust":
        blocks = symbols.filter("kind = 'implementation'").select(*KEYS, "path", F.regexp_extract("name", r"^impl\s+(?:.+\s+for\s+)?([A-Za-z_]\w*)", 1).alias("head"), F.col("symbol_id").alias("owner_container"))
        in_block = blocks.join(fns.filter("container_id is not null").select(*KEYS, F.col("container_id").alias("owner_container"), F.col("name").alias("last"), F.col("symbol_id").alias("to_id")), [*KEYS, "owner_container"])
        in_block = in_block.withColumn("_n", F.count("*").over(W.partitionBy(*KEYS, "path", "head", "last"))).filter("_n = 1").drop("_n", "owner_container")
        answer(s.filter("depth = 2").join(in_block, [*KEYS, "path", "head", "last"]), 7, 0.88)
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    best = every.groupBy(*keep).agg(F.min_by(F.struct("to_id", "confidence"), F.struct("rank", "to_id")).alias("b"))
    has_notes = F.size(F.coalesce("decorators", F.array().cast("array<string>"))) > 0
    plain = symbols.filter(has_notes == decorated) if language == "python" else symbols
    out = best.select(*keep, "b.to_id", "b.confidence", F.lit(f"{language}-static").alias("resolver"))
    return out.filter("to_id != owner_id").join(plain.select(*KEYS, F.col("symbol_id").alias("to_id")), [*KEYS, "to_id"], "left_semi")


def merge_calls(candidates: DataFrame, max_evidence: int = 20, max_sites: int = 40) -> DataFrame:
    """``symbol_calls``: one row for each (from, to); at most ``max_evidence`` distinct places and ``max_sites`` sites, cut before they are collected.

    Verified wins; else the least confidence stands.
    """
    c = candidates.withColumn("trust", F.coalesce(F.col("trust") if "trust" in candidates.columns else F.lit(None), F.lit("inferred")))
    pair = [*KEYS, "from_id", "to_id"]
    c = c.withColumnRenamed("owner_id", "from_id")
    head = c.groupBy(*pair).agg(F.max(F.col("trust") == "verified").alias("v"), F.min("confidence").alias("low"), F.max(F.when(F.col("trust") == "verified", F.col("confidence"))).alias("high"), F.min("resolver").alias("resolver"), F.count("*").alias("n"))
    places = c.select(*pair, "path", "line").distinct().withColumn("k", F.row_number().over(W.partitionBy(*pair).orderBy("path", "line"))).filter(F.col("k") <= max_evidence)
    places = places.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("evidence"))
    sites = c.select(*pair, "path", "ordinal").distinct().withColumn("k", F.row_number().over(W.partitionBy(*pair).orderBy("path", "ordinal"))).filter(F.col("k") <= max_sites)
    sites = sites.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("path", "ordinal"))).alias("sites"))
    out = head.join(places, pair).join(sites, pair)
    return out.select(*pair, F.when(F.col("v"), "verified").otherwise("inferred").alias("trust"), F.when(F.col("v"), F.col("high")).otherwise(F.col("low")).alias("confidence"), "resolver", "evidence", "sites")


def type_relations(symbols: DataFrame) -> DataFrame:
    """extends and implements between types: Python bases 0.90, Rust ``impl T for X`` 0.93, TypeScript heritage 0.90; only names that are unique in the repository. ``position`` is the base's place in the list."""
    bases = F.regexp_extract("signature", r"^class\s+\w+\s*\((.*)\)\s*:", 1)
    py = symbols.filter((F.col("kind") == "class") & F.col("path").endswith(".py")).select(*KEYS, F.col("symbol_id").alias("from_id"), F.posexplode(F.split(F.regexp_replace(bases, r"\[[^\]]*\]", ""), ",")).alias("position", "base"))
    py = py.select(*KEYS, "from_id", "position", F.element_at(F.split(F.trim("base"), r"\."), -1).alias("name"), F.lit("extends").alias("kind"), F.lit(0.90).alias("confidence"))
    ts = symbols.filter(F.col("kind").isin("class", "interface") & ~F.col("path").rlike(r"\.(py|rs)$"))
    up = F.regexp_extract("signature", r"\bextends\s+([\w$.,\s]+?)(?:\s+implements\b|\s*\{|$)", 1)
    im = F.regexp_extract("signature", r"\bimplements\s+([\w$.,\s]+?)(?:\s*\{|$)", 1)
    both = F.concat(F.transform(F.split(up, ","), lambda n: F.struct(F.trim(n).alias("name"), F.lit("extends").alias("kind"))), F.transform(F.split(im, ","), lambda n: F.struct(F.trim(n).alias("name"), F.lit("implements").alias("kind"))))
    ts = ts.select(*KEYS, F.col("symbol_id").alias("from_id"), F.posexplode(both).alias("position", "x")).select(*KEYS, "from_id", "position", "x.name", "x.kind", F.lit(0.90).alias("confidence"))
    rx = r"^impl\s+(?:.*::)?([A-Za-z_]\w*)(?:<[^>]*>)?\s+for\s+(?:.*::)?([A-Za-z_]\w*)"
    rs = symbols.filter("kind = 'implementation'").select(*KEYS, F.regexp_extract("name", rx, 2).alias("type_name"), F.regexp_extract("name", rx, 1).alias("name")).filter("name != ''")
    holders = _unique(symbols.filter(F.col("kind").isin("struct", "enum", "type")), "name").select(*KEYS, F.col("name").alias("type_name"), F.col("symbol_id").alias("from_id"))
    rs = rs.join(holders, [*KEYS, "type_name"]).select(*KEYS, "from_id", F.lit(0).alias("position"), "name", F.lit("implements").alias("kind"), F.lit(0.93).alias("confidence"))
    targets = _unique(symbols.filter(F.col("kind").isin("class", "interface", "trait")), "name").select(*KEYS, "name", F.col("symbol_id").alias("to_id"))
    out = py.unionByName(ts).unionByName(rs).filter("name != ''").join(targets, [*KEYS, "name"]).filter("from_id != to_id")
    return out.groupBy(*KEYS, "from_id", "to_id", "kind", F.lit("inferred").alias("trust"), "confidence").agg(F.min("position").alias("position"))


def override_relations(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Methods that repeat the name of one method of the direct base class, 0.84."""
    methods = _unique(symbols.filter("kind = 'method' and container_id is not null"), "container_id", "name").select(*KEYS, "container_id", "name", "symbol_id")
    child = methods.select(*KEYS, F.col("container_id").alias("from_id"), "name", F.col("symbol_id").alias("m_from"))
    base = methods.select(*KEYS, F.col("container_id").alias("to_id"), "name", F.col("symbol_id").alias("m_to"))
    out = relations.filter("kind = 'extends'").select(*KEYS, "from_id", "to_id").join(child, [*KEYS, "from_id"]).join(base, [*KEYS, "to_id", "name"])
    return out.select(*KEYS, F.col("m_from").alias("from_id"), F.col("m_to").alias("to_id"), F.lit("overrides").alias("kind"), F.lit("inferred").alias("trust"), F.lit(0.84).alias("confidence"))


def inheritance_dispatch(sites: DataFrame, symbols: DataFrame, relations: DataFrame, most: int = 8) -> DataFrame:
    """``super().m`` calls of the method of the first known base, if it has the method itself (0.92), and ``self.m`` calls without an own method as calls of at most ``most`` descendants' methods, nearest first (0.64).

    The descendants are walked level by level to the end; each level is stored.
    """
    owners = symbols.filter("container_id is not null").select(*KEYS, F.col("symbol_id").alias("owner_id"), F.col("container_id").alias("klass"))
    methods = _unique(symbols.filter("kind = 'method' and container_id is not null"), "container_id", "name").select(*KEYS, F.col("container_id").alias("klass"), F.col("name").alias("last"), F.col("symbol_id").alias("to_id"))
    methods = stored(methods, "methods")
    bases = stored(relations.filter("kind = 'extends'").select(*KEYS, F.col("from_id").alias("klass"), F.col("to_id").alias("parent"), "position"), "bases")
    s = sites.join(owners, [*KEYS, "owner_id"]).withColumn("last", F.element_at(F.split("callee_text", r"\."), -1))
    keep = [*KEYS, *CALL_COLUMNS]
    first = bases.groupBy(*KEYS, "klass").agg(F.min_by("parent", F.struct("position", "parent")).alias("parent"))
    found = s.filter(F.col("callee_text").startswith("super().")).join(first, [*KEYS, "klass"]).select(*keep, "last", F.col("parent").alias("klass"))
    found = found.join(methods, [*KEYS, "klass", "last"]).select(*keep, "to_id")
    unmet = s.filter(F.col("callee_text").rlike(r"^self\.\w+$")).join(methods.select(*KEYS, "klass", "last"), [*KEYS, "klass", "last"], "left_anti").select(*keep, "last", "klass")
    unmet = stored(unmet, "unmet")
    level, depth = stored(unmet.select(*KEYS, "klass", F.col("klass").alias("child"), F.lit(0).alias("level")).distinct(), "descendants"), 0
    reach = level
    while not level.isEmpty():
        depth += 1
        down = level.select(*KEYS, "klass", F.col("child").alias("parent")).join(bases.select(*KEYS, "parent", F.col("klass").alias("child")), [*KEYS, "parent"]).select(*KEYS, "klass", "child", F.lit(depth).alias("level")).distinct()
        level = stored(down.join(reach, [*KEYS, "klass", "child"], "left_anti"), "descendants")
        reach = reach.unionByName(level)
    kids = unmet.join(reach.filter("level > 0"), [*KEYS, "klass"]).join(methods.select(*KEYS, F.col("klass").alias("child"), "last", "to_id"), [*KEYS, "child", "last"])
    kids = kids.groupBy(*keep, "to_id").agg(F.min("level").alias("level")).withColumn("k", F.row_number().over(W.partitionBy(*keep).orderBy("level", "to_id"))).filter(F.col("k") <= most)
    found = found.withColumn("confidence", F.lit(0.92))
    return found.unionByName(kids.select(*keep, "to_id", F.lit(0.64).alias("confidence"))).withColumn("resolver", F.lit("python-static"))


def state_access(tokens: DataFrame, variables: DataFrame, symbols: DataFrame) -> DataFrame:
    """reads and writes of module variables inside callables. ``tokens`` has path, line, name and operator ('' for a read), as state.state_tokens gives them; ``variables`` path, name and symbol_id, as state.module_variables.

    ``=`` writes; compound operators and ``++``/``--`` read and write; the variable is the file's own or an imported one.
    """
    hit = owner_at_line(tokens.join(variables.select(*KEYS, "path", "name", F.col("symbol_id").alias("to_id")), [*KEYS, "path", "name"]), symbols)
    kinds = F.when(F.col("operator") == "", F.array(F.lit("reads"))).when(F.col("operator") == "=", F.array(F.lit("writes"))).otherwise(F.array(F.lit("reads"), F.lit("writes")))
    out = hit.select(*KEYS, F.col("owner_id").alias("from_id"), "to_id", F.explode(kinds).alias("kind"), "path", "line")
    return out.groupBy(*KEYS, "from_id", "to_id", "kind").agg(F.min("line").alias("line"), F.count("*").alias("count")).withColumns({"trust": F.lit("inferred"), "confidence": F.lit(0.86)})


def union_facts(*tables: DataFrame, cap: int | None = None) -> DataFrame:
    """Facts of all resolvers as one table; ``cap`` keeps the first in order of from, to (default: all)."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if cap is None:
        return out
    return out.withColumn("k", F.row_number().over(W.partitionBy(*KEYS).orderBy("from_id", "to_id"))).filter(F.col("k") <= cap).drop("k")


def propagate_callables(invocations: DataFrame, parameters: DataFrame, calls_through: DataFrame, max_bindings: int = 24, passes: int = 16, store=None) -> tuple[DataFrame, DataFrame]:
    """(bindings, calls): callables passed as arguments, followed through parameters until nothing new binds.

    ``invocations`` (callee_id, position, name, symbol_id, param_owner, param_name): an argument is a symbol or a
    parameter of the caller. ``parameters`` (owner_id, position, name). ``calls_through`` (owner_id, param_name): calls
    of a parameter. Each pass joins only the bindings that the last one found; a parameter keeps at most
    ``max_bindings``. Calls through parameters have confidence 0.76.
    """
    args = invocations.join(parameters.select(*KEYS, F.col("owner_id").alias("callee_id"), F.col("position").alias("p_pos"), F.col("name").alias("p_name")), [*KEYS, "callee_id"])
    args = args.filter((F.col("name").isNotNull() & (F.col("name") == F.col("p_name"))) | (F.col("name").isNull() & (F.col("position") == F.col("p_pos"))))
    direct = args.filter("symbol_id is not null").select(*KEYS, F.col("callee_id").alias("owner_id"), F.col("p_name").alias("param"), "symbol_id").distinct()
    flows = args.filter("symbol_id is null and param_owner is not null").select(*KEYS, F.col("param_owner").alias("owner_id"), F.col("param_name").alias("param"), F.col("callee_id").alias("to_owner"), F.col("p_name").alias("to_param")).distinct()
    store = store or (lambda df: stored(df, "bindings"))

    def capped(df):
        w = W.partitionBy(*KEYS, "owner_id", "param").orderBy("symbol_id")
        return df.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= max_bindings).drop("k")

    found = store(capped(direct))
    fresh = found
    for _ in range(passes):
        step = fresh.join(flows, [*KEYS, "owner_id", "param"]).select(*KEYS, F.col("to_owner").alias("owner_id"), F.col("to_param").alias("param"), "symbol_id").distinct()
        fresh = store(step.join(found, [*KEYS, "owner_id", "param", "symbol_id"], "left_anti"))
        if fresh.isEmpty():
            break
        found = store(capped(found.unionByName(fresh)))
    calls = calls_through.select(*KEYS, "owner_id", F.col("param_name").alias("param")).distinct().join(found, [*KEYS, "owner_id", "param"])
    return found, calls.select(*KEYS, F.col("owner_id").alias("from_id"), F.col("symbol_id").alias("to_id"), F.lit(0.76).alias("confidence"), F.lit("inferred").alias("trust")).distinct()
