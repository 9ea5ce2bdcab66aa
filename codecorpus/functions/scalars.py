"""Column functions on paths, names, texts and numbers; all are built-in expressions, null in gives null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rs": "rust", "java": "java", "go": "go", "swift": "swift", "kt": "kotlin", "cs": "csharp",
    "cpp": "cpp", "c": "c", "h": "header", "rb": "ruby", "php": "php", "vue": "vue", "svelte": "svelte",
    "json": "json", "css": "css", "scss": "scss", "html": "html", "yml": "yaml", "yaml": "yaml", "md": "markdown",
}
SOURCE_EXTENSIONS = sorted(LANGUAGES)
DEEP_EXTENSIONS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "rs"]

# Patterns of paths.
SUPPORT_PATH = r"(?i)(^|/)(docs?|examples?|samples?|tests?|fixtures?|benchmarks?)(/|$)|(^|/)test_[^/]+$"
NOISY_PATH = r"(?i)(^|/)(?:tests?|__tests__|docs?|examples?|fixtures?|generated|vendor|dist|build|coverage|\.github)(/|$)"
PRIVATE_FILE = r"(?i)(^|/)(\.env(?:\..*)?|id_rsa|id_ed25519|\.npmrc|\.pypirc|\.netrc|_netrc|\.git-credentials|credentials\.json|auth\.json)$|\.(?:pem|p12|pfx|key|keystore)$"
PRIVATE_FOLDER = r"(?i)(^|/)(\.ssh|\.aws|\.azure|\.gnupg|\.kube)(/|$)"

# What a module's name says of it, first match first.
RESPONSIBILITIES = [
    ("agent|orchestrat|planner|reason", "Likely coordinates agent planning, reasoning, and tool execution."),
    ("risk|limit|compliance|guard", "Likely evaluates risk, limits, policy, or execution guards."),
    ("trade|order|execution|broker|exchange", "Likely coordinates trading, order routing, or execution adapters."),
    ("market|feed|quote|data|ingest", "Likely ingests, normalizes, or distributes market and reference data."),
    ("portfolio|position|account|ledger", "Likely manages portfolio, position, account, or ledger state."),
    ("renderer|component|view|ui|web", "Likely presents application state and user interactions."),
    ("api|server|service|main|core", "Likely coordinates application services and external entry points."),
]

# Words that make a symbol a workflow step.
CALLABLE_KINDS = ["function", "method", "component"]
REGISTERED = "tokio::main|__main__|route|router|endpoint|command|scheduler|cron|task|listener|subscriber|consumer|event|webhook"
ORCHESTRATION = ["agent", "workflow", "pipeline", "orchestrator", "orchestration", "handler", "listener", "consumer", "server", "cli", "command", "job", "task", "trade", "trading", "order", "risk", "strategy", "rebalance", "portfolio", "broker", "market"]
ENTRY_NAMES = ["main", "__main__", "bootstrap", "startup", "entrypoint", "run", "start"]
ACTIONS = ["start", "bootstrap", "run", "execute", "handle", "process", "consume", "listen", "serve", "submit", "dispatch", "orchestrate"]
UTILITIES = ["get", "set", "is", "has", "ensure", "find", "load", "save", "store", "persist", "write", "publish", "emit", "send", "receive"]
STEP_WORDS = [
    ("ingest", "ingest consume receive fetch load"),
    ("validate", "validate check verify"),
    ("infer", "infer predict model"),
    ("plan", "plan reason agent"),
    ("decide", "risk decide select strategy rebalance"),
    ("guard", "guard authorize approve limit"),
    ("tool-call", "tool invoke"),
    ("execute", "submit trade order execute handle process run"),
    ("persist", "save store persist commit write"),
    ("publish", "publish emit send"),
    ("observe", "monitor observe watch health"),
    ("retry", "retry"),
    ("cancel", "cancel"),
]


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment, without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def language_of(ext: Column) -> Column:
    """Language of an extension; an unknown one names itself, an empty one is ``unknown``."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(known[ext], F.when(ext == "", "unknown").otherwise(ext))


def module_of(path: Column) -> Column:
    """``root`` for a single segment; first two segments under apps, packages, services, src or lib if there are more; else the first."""
    parts = F.split(path, "/")
    return (
        F.when(F.size(parts) == 1, "root")
        .when(parts[0].isin("apps", "packages", "services", "src", "lib") & (F.size(parts) > 2), F.array_join(F.slice(parts, 1, 2), "/"))
        .otherwise(parts[0])
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def excerpt(line: Column, limit: int = 300) -> Column:
    return F.substring(F.trim(line), 1, limit)


def evidence_key(path: Column, line: Column, end_line: Column, hash_: Column, text: Column) -> Column:
    """Sort and identity key of a piece of evidence; a missing end is the line, a missing excerpt empty."""
    number = lambda c: F.lpad(c.cast("string"), 12, "0")
    return F.concat_ws(":", path, number(line), number(F.coalesce(end_line, line)), hash_, F.coalesce(text, F.lit("")))


def sort_evidence(evidence: Column) -> Column:
    """Distinct evidence structs in key order."""
    keyed = F.transform(F.array_distinct(evidence), lambda e: F.struct(evidence_key(e["path"], e["line"], e["end_line"], e["hash"], e["excerpt"]).alias("k"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x["e"])


def is_support_path(path: Column) -> Column:
    return path.rlike(SUPPORT_PATH)


def is_noisy_path(path: Column) -> Column:
    return path.rlike(NOISY_PATH)


def is_private_file(path: Column) -> Column:
    return path.rlike(PRIVATE_FILE) | path.rlike(PRIVATE_FOLDER)


def safe_relative_path(path: Column) -> Column:
    """The path with ``/`` and without empty or ``.`` segments; null if it is absolute, escapes or isn't portable."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    bad = F.exists(parts, lambda p: (p == "..") | p.contains(":") | ((p != "") & (p != ".") & (p.rlike(r"[. ]$") | p.rlike(r'[<>"|?*\x00-\x1f]') | p.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)"))))
    clean = F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")
    return F.when((F.length(path) <= 4096) & ~path.rlike(r"^[/\\]|^[A-Za-z]:") & ~bad & (clean != ""), clean)


def responsibility_of(module: Column) -> Column:
    name = F.lower(module)
    out = F.when(name.rlike(RESPONSIBILITIES[0][0]), RESPONSIBILITIES[0][1])
    for pattern, text in RESPONSIBILITIES[1:]:
        out = out.when(name.rlike(pattern), text)
    return out.otherwise(F.concat(F.lit("Groups source files under the inferred "), module, F.lit(" module boundary.")))


def identifier_tokens(name: Column) -> Column:
    """Words of an identifier in lower case: split at camel humps and at other characters than a-z and 0-9."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda t: t != "")


def workflow_step_kind(kind: Column, name: Column, qualified_name: Column, container_id: Column, exported: Column, is_async: Column, decorators: Column) -> Column:
    """The workflow step that a symbol is an entry to, or null."""
    tokens, context = identifier_tokens(name), identifier_tokens(F.coalesce(F.when(qualified_name != "", qualified_name), name))
    has = lambda words: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
    notes = F.lower(F.array_join(F.coalesce(decorators, F.array().cast("array<string>")), " "))
    registered = notes.rlike(REGISTERED)
    top = container_id.isNull()
    entry = top & F.lower(name).isin(ENTRY_NAMES)
    orchestrates = F.arrays_overlap(context, F.array(*[F.lit(w) for w in ORCHESTRATION]))
    action = top & (F.coalesce(exported, F.lit(False)) | F.coalesce(is_async, F.lit(False)) | registered) & orchestrates & has(ACTIONS)
    admitted = kind.isin(CALLABLE_KINDS) & (registered | (~has(UTILITIES) & (entry | action)))
    step = F.when(registered | entry | has(["start"]), "trigger")
    for label, words in STEP_WORDS:
        step = step.when(has(words.split()) | (notes.rlike(r"\btool\b") if label == "tool-call" else F.lit(False)), label)
    return F.when(admitted, step)


def module_name(path: Column, roots: list[str] = ()) -> Column:
    """Dotted module of a path: the first source root that leads it is cut, then the extension and ``/__init__``."""
    p = F.regexp_replace(path, r"\\", "/")
    rooted = p
    for root in reversed(list(roots)):
        rooted = F.when((p == root) | p.startswith(root + "/"), F.regexp_replace(F.substr(p, F.lit(len(root) + 1)), "^/", "")).otherwise(rooted)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rooted, r"(?i)\.(?:py|js|jsx|ts|tsx|rs)$", ""), r"(?i)/__init__$", ""), "/", ".")


def oracle_names(name: Column, dynamic: bool = False, roots: list[str] = ()) -> Column:
    """Candidate names of an oracle symbol, best first: as given; for dynamic traces without project prefix, source root and ``.__init__``."""
    if not dynamic:
        return F.array(name)
    base = F.regexp_replace(name, r"^\.?DyPyBench\.temp\.project\d+\.", "")
    names = [base] + [F.when(base.startswith(r.replace("/", ".") + "."), F.substr(base, F.lit(len(r) + 2))) for r in roots]
    plain = [F.regexp_replace(n, r"\.__init__(?=\.|$)", "") for n in names]
    return F.array_compact(F.array_distinct(F.array(*names, *plain)))


def slug(text: Column) -> Column:
    """Lower case with runs of other characters than ``a-z0-9._-`` as ``-``, at most 80 long; else the start of the text's hash."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.coalesce(F.nullif(s, F.lit("")), F.substring(F.sha2(text, 256), 1, 12))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 1 where the denominator is 0 (see the validity flag beside it)."""
    return F.when(denominator == 0, F.lit(1.0)).otherwise(numerator / denominator)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def retry_bound(text: Column) -> Column:
    """Attempts named by a loop header or decorator: ``range(a, b)``, ``range(n)``, ``a..b``, ``a..=b``, ``attempts=n``; null if none is."""
    get = lambda pattern, group: F.regexp_extract(text, pattern, group).try_cast("long")
    two, dots, closed = r"range\(\s*(\d+)\s*,\s*(\d+)\s*\)", r"(\d+)\s*\.\.\s*(\d+)", r"(\d+)\s*\.\.=\s*(\d+)"
    zero = F.lit(0).cast("long")
    return (
        F.when(text.rlike(two), F.greatest(zero, get(two, 2) - get(two, 1)))
        .when(text.rlike(r"range\(\s*\d+\s*\)"), get(r"range\(\s*(\d+)\s*\)", 1))
        .when(text.rlike(closed), F.greatest(zero, get(closed, 2) - get(closed, 1) + 1))
        .when(text.rlike(dots), F.greatest(zero, get(dots, 2) - get(dots, 1)))
        .when(text.rlike(r"(?i)(?:attempt|tries|max_tries)\D{0,12}\d+"), get(r"(?i)(?:attempt|tries|max_tries)\D{0,12}(\d+)", 1))
    )


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, nulls written out."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
