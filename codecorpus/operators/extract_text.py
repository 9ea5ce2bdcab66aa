"""Rows from texts: imports, frameworks and trace markers by built-in expressions, search by one automaton of all queries."""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from codecorpus.functions import scalars as S
from codecorpus.operators.storage import stored

KEYS = ["repo", "revision"]


def numbered_lines(files: DataFrame, *more: str) -> DataFrame:
    """(repo, revision, path, .., line, text): lines from 1."""
    return files.select(*KEYS, "path", *more, F.posexplode(F.split("content", r"\r?\n")).alias("at", "text")).withColumn("line", F.col("at") + 1).drop("at")


PY_FROM, PY_IMPORT = r"^\s*from\s+([.\w]+)\s+import\s+", r"^\s*import\s+([\w.,\s]+?)(?:\s+as\s+\w+)?\s*(?:#.*)?$"
RS_USE, RS_MOD = r"^\s*(pub\s+)?use\s+([^;]+);", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)\s*;"
TS_FROM = r"""(?m)^\s*(import|export)\s+(?:type\s+)?(?:[\w*{}\s,$]+?\s+from\s+)?["']([^"'\n]+)["']"""
TS_CALL = r"""(?:\brequire|\bimport)\s*\(\s*["']([^"'\n]+)["']\s*\)"""


def extract_imports(files: DataFrame) -> DataFrame:
    """``imports``: path, specifier, line, kind (imports or exports), excerpt; from Python, Rust and TypeScript or JavaScript text.

    One scan: files are filtered by a pattern on the whole text, then lines by the same pattern, before anything is
    taken apart. A line in a comment is none.
    """
    family = F.when(F.col("ext") == "py", "py").when(F.col("ext") == "rs", "rs").when(F.col("ext").isin("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), "ts")
    known = files.withColumn("ext", S.extension(F.col("path"))).withColumn("family", family).filter("family is not null")
    some = F.when(F.col("family") == "py", F.col("content").rlike(r"(?m)^\s*(from|import)\s")).when(F.col("family") == "rs", F.col("content").rlike(r"\b(use|mod)\s")).otherwise(F.col("content").rlike(r"\b(import|export|require)\b"))
    lines = numbered_lines(known.filter(some), "family")
    text, is_py, is_rs = F.col("text"), F.col("family") == "py", F.col("family") == "rs"
    worth = F.when(is_py, text.rlike(r"^\s*(from|import)\s")).when(is_rs, text.rlike(r"\b(use|mod)\s")).otherwise(text.rlike(r"\b(import|export|require|from)\b") & ~text.rlike(r"^\s*(//|\*|/\*)"))
    lines = lines.filter(worth)
    item = lambda specifier, kind: F.struct(specifier.alias("specifier"), kind.alias("kind"))
    imports, exports = F.lit("imports"), F.lit("exports")
    names = F.when(text.rlike(PY_FROM), F.array(F.regexp_extract("text", PY_FROM, 1))).when(text.rlike(PY_IMPORT), F.transform(F.split(F.regexp_extract("text", PY_IMPORT, 1), ","), F.trim))
    python = F.transform(names, lambda n: item(n, imports))
    used = F.regexp_extract("text", RS_USE, 2)
    used = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(used, "^::", ""), r"\{.*$", ""), "::$", ""))
    rust = F.array_compact(
        F.array(
            F.when(text.rlike(RS_USE) & (used != ""), item(used, F.when(F.regexp_extract("text", RS_USE, 1) != "", exports).otherwise(imports))),
            F.when(text.rlike(RS_MOD), item(F.concat(F.lit("self::"), F.regexp_extract("text", RS_MOD, 1)), imports)),
        )
    )
    late = r"""^[\w*{}\s,$]*\}?\s*from\s+["']([^"'\n]+)["']"""
    head = F.regexp_extract("text", TS_FROM, 2)
    tail = F.when(head == "", F.regexp_extract("text", late, 1)).otherwise("")
    specs = F.filter(F.concat(F.array(head, tail), F.regexp_extract_all("text", F.lit(TS_CALL), 1)), lambda s: s != "")
    script = F.transform(specs, lambda s: item(s, F.when(text.rlike(r"^\s*export\b"), exports).otherwise(imports)))
    made = lines.select(*KEYS, "path", "line", S.excerpt(text).alias("excerpt"), F.explode(F.when(is_py, python).when(is_rs, rust).otherwise(script)).alias("m"))
    return made.select(*KEYS, "path", "m.specifier", "line", "m.kind", "excerpt")


# The line that shows a framework, for each language family.
FRAMEWORK_IMPORTS = {
    "fastapi": (["py"], r"^\s*(?:from\s+fastapi\b|import\s+fastapi\b)"),
    "langgraph": (["py"], r"^\s*(?:from\s+langgraph\b|import\s+langgraph\b)"),
    "celery": (["py"], r"^\s*(?:from\s+celery\b|import\s+celery\b)"),
    "express": (["ts", "js", "tsx", "jsx", "mts", "mjs", "cts", "cjs"], r"""(?:from\s+|require\(\s*)["']express["']"""),
    "nestjs": (["ts", "js", "tsx", "jsx", "mts", "mjs"], r"""from\s+["']@nestjs/"""),
    "nextjs": (["ts", "js", "tsx", "jsx"], r"""(?:from\s+["']next(?:/[^"']*)?["'])|^\s*["']use server["']"""),
    "axum": (["rs"], r"^\s*(?:pub\s+)?use\s+axum\b|\baxum::"),
    "tokio": (["rs"], r"^\s*(?:pub\s+)?use\s+tokio\b|\btokio::"),
}
NEXT_PATH = r"(?:^|/)app/(?:.*/)?route\.[tj]sx?$|(?:^|/)pages/api/.+\.[tj]sx?$"


def detect_frameworks(files: DataFrame) -> DataFrame:
    """``fw_detections``: the first line of each file that shows a framework; one row for each framework and file."""
    ext = S.extension(F.col("path"))
    tests = F.array_compact(F.array(*[F.when(F.col("ext").isin(exts) & F.col("text").rlike(rx), F.lit(name)) for name, (exts, rx) in FRAMEWORK_IMPORTS.items()]))
    any_rx = "(?m)" + "|".join(f"(?:{rx})" for _, rx in FRAMEWORK_IMPORTS.values())
    lines = numbered_lines(files.withColumn("ext", ext).filter(F.col("content").rlike(any_rx)), "ext")
    found = lines.select(*KEYS, "path", F.explode(tests).alias("framework"), "line", S.excerpt(F.col("text")).alias("excerpt"))
    by_path = files.filter(F.col("path").rlike(NEXT_PATH)).select(*KEYS, "path", F.lit("nextjs").alias("framework"), F.lit(1).alias("line"), F.lit("").alias("excerpt"))
    w = found.unionByName(by_path).groupBy(*KEYS, "framework", "path").agg(F.min(F.struct("line", "excerpt")).alias("first"))
    return w.select(*KEYS, "framework", "path", "first.line", "first.excerpt")


def _frameworks_shown():
    """The frameworks that a file (path, content, texts: its lines) shows, as an array; the files need no join with what detect_frameworks finds."""
    ext, by_path = S.extension(F.col("path")), F.when(F.col("path").rlike(NEXT_PATH), F.array(F.lit("nextjs"))).otherwise(F.array().cast("array<string>"))
    has = lambda rx: F.col("content").rlike("(?m)" + rx) & F.exists("texts", lambda t: t.rlike(rx))
    return F.array_union(F.array_compact(F.array(*[F.when(ext.isin(exts) & has(rx), F.lit(name)) for name, (exts, rx) in FRAMEWORK_IMPORTS.items()])), by_path)


# How frameworks register a handler. Groups: instance (or empty), verb or kind, literal, handler.
FRAMEWORK_RULES = [
    ("fastapi", "decorator-route", r"""^\s*@(\w+)\.(get|post|put|patch|delete|options|head|websocket)\(\s*["']([^"']+)["']""", (1, 2, 3, 0), "next"),
    ("fastapi", "add-api-route", r"""\b(\w+)\.(add_api_route)\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_]\w*)""", (1, 2, 3, 4), "named"),
    ("langgraph", "add-node", r"""\b(\w+)\.(add_node)\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_]\w*)""", (1, 2, 3, 4), "named"),
    ("langgraph", "add-edge", r"""\b(\w+)\.(add_edge)\(\s*["']([^"']+)["']\s*,\s*["']([^"']+)["']""", (1, 2, 3, 4), "literal"),
    ("langgraph", "conditional-edge", r"""\b(\w+)\.(add_conditional_edges)\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_]\w*)""", (1, 2, 3, 4), "named"),
    ("celery", "task-decorator", r"""^\s*@(?:(\w+)\.)?(task|shared_task)\b""", (1, 2, 0, 0), "next"),
    ("celery", "enqueue", r"""\b([A-Za-z_]\w*)\.(delay|apply_async)\(""", (0, 2, 0, 1), "named"),
    ("celery", "named-task-publish", r"""\b(\w+)\.(send_task)\(\s*["']([^"']+)["']""", (1, 2, 3, 0), "literal"),
    ("express", "route-registration", r"""\b(\w+)\.(get|post|put|patch|delete|use|all)\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_$][\w$]*)\s*[,)]""", (1, 2, 3, 4), "named"),
    ("nestjs", "controller-route", r"""^\s*@(Get|Post|Put|Patch|Delete|All)\(\s*(?:["']([^"']*)["'])?\s*\)""", (0, 1, 2, 0), "next"),
    ("nextjs", "app-route-export", r"""^\s*export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b""", (0, 1, 0, 1), "named"),
    ("nextjs", "pages-api-export", r"""^\s*export\s+default\s+(?:async\s+)?function\s+([A-Za-z_$][\w$]*)""", (0, 0, 0, 1), "named"),
    ("nextjs", "server-action", r"""^\s*export\s+async\s+function\s+([a-z_$][\w$]*)""", (0, 0, 0, 1), "named"),
    ("axum", "router-route", r"""\.(route)\(\s*"([^"]+)"\s*,\s*(?:get|post|put|patch|delete)\(\s*([A-Za-z_]\w*)\s*\)""", (0, 1, 2, 3), "named"),
    ("tokio", "spawn", r"""\btokio::(spawn)\(\s*([A-Za-z_]\w*)\s*\(""", (0, 1, 0, 2), "named"),
    ("tokio", "joinset-spawn", r"""\b(\w+)\.(spawn)\(\s*([A-Za-z_]\w*)\s*\(""", (1, 2, 0, 3), "named"),
    ("tokio", "mpsc-send", r"""\b(\w+)\.(send|try_send)\(""", (1, 2, 0, 0), "owner"),
    ("tokio", "mpsc-recv", r"""\b(\w+)\.(recv)\(\s*\)""", (1, 2, 0, 0), "owner"),
]
# Constructors that make an instance of a framework, so that its rules hold for that name only.
INSTANCES = {
    "fastapi": r"^\s*(\w+)\s*=\s*(?:FastAPI|APIRouter)\(",
    "langgraph": r"^\s*(\w+)\s*=\s*(?:StateGraph|MessageGraph|Graph)\(",
    "celery": r"^\s*(\w+)\s*=\s*Celery\(",
    "express": r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:express\(|express\.Router\(|Router\()",
    "tokio": r"^\s*let\s+(?:mut\s+)?\(?(\w+)(?:\s*,\s*(?:mut\s+)?\w+\))?\s*=\s*(?:tokio::)?(?:task::)?(?:JoinSet::new|mpsc::channel|mpsc::unbounded_channel)",
}
# A call of the rule's shape that the rule can't read (no literal, no plain handler) is an exclusion.
DYNAMIC = {
    "fastapi": r"@\w+\.(?:get|post|put|patch|delete)\(|\.add_api_route\(",
    "langgraph": r"\.add_(?:node|edge|conditional_edges)\(",
    "celery": r"\.send_task\(|\.(?:delay|apply_async)\(|@\w+\.task\b",
    "express": r"\b\w+\.(?:get|post|put|patch|delete|use|all)\(",
    "nestjs": r"^\s*@(?:Get|Post|Put|Patch|Delete|All)\(",
    "nextjs": r"^\s*export\s+const\s+(?:GET|POST|PUT|PATCH|DELETE)\b|^\s*export\s+default\b",
    "axum": r"\.route\(",
    "tokio": r"\bspawn\(",
}


def framework_candidates(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fw_candidates, fw_exclusions): registrations with a literal path and a handler that is one symbol of the file.

    Lines of files where a framework was detected meet that framework's rules; rules with an instance hold only for
    names that the same file makes by the framework's constructor. What has a rule's shape and gives no candidate is an exclusion.
    """
    shown = files.select(*KEYS, "path", "content", F.split("content", r"\r?\n").alias("texts"))
    shown = shown.select(*KEYS, "path", "texts", F.explode(_frameworks_shown()).alias("framework"))
    lines = shown.select(*KEYS, "path", "framework", F.posexplode("texts").alias("at", "text")).withColumn("line", F.col("at") + 1).drop("at")
    made = F.coalesce(*[F.when((F.col("framework") == fw) & F.col("text").rlike(rx), F.regexp_extract("text", rx, 1)) for fw, rx in INSTANCES.items()])
    part = lambda rx, g: F.regexp_extract("text", rx, g) if g else F.lit("")
    names, none = ("rule_id", "how", "instance", "kind", "value_label", "handler"), F.lit("")
    mark = lambda *values: F.struct(*[v.alias(n) for n, v in zip(names, values)])
    rules = [
        F.when(
            (F.col("framework") == fw) & F.col("text").rlike(rx),
            mark(F.lit(rule), F.lit(how), part(rx, i), part(rx, v), part(rx, p), part(rx, h)),
        )
        for fw, rule, rx, (i, v, p, h), how in FRAMEWORK_RULES
    ]
    controller = F.regexp_extract("text", r"""^\s*@Controller\(\s*["']([^"']*)["']""", 1)
    notes = [F.when(made.isNotNull(), mark(none, F.lit("made"), made, none, none, none)), F.when((F.col("framework") == "nestjs") & (controller != ""), mark(none, F.lit("prefix"), none, none, controller, none))]
    # one pass over the texts: what rules find, what constructors make, and prefixes
    marks = lines.select(*KEYS, "path", "framework", "line", "text", F.explode(F.array_compact(F.array(*rules, *notes))).alias("h")).select(*KEYS, "path", "framework", "line", "text", "h.*")
    marks = stored(marks, "framework-marks")
    hits = marks.filter("how not in ('made', 'prefix')")
    instances = marks.filter("how = 'made'").select(*KEYS, "path", "framework", "instance").distinct()
    bound = hits.filter("instance = ''").unionByName(hits.filter("instance != ''").join(instances, [*KEYS, "path", "framework", "instance"], "left_semi").select(hits.columns))
    prefix = marks.filter("how = 'prefix'").groupBy(*KEYS, "path").agg(F.min("value_label").alias("prefix"))
    bound = bound.join(prefix, [*KEYS, "path"], "left").withColumn("value_label", F.when((F.col("framework") == "nestjs") & F.col("prefix").isNotNull(), F.concat("prefix", F.lit("/"), "value_label")).otherwise(F.col("value_label"))).drop("prefix")
    bound = stored(bound, "framework-hits")
    sym = symbols.filter(F.col("kind").isin(S.CALLABLE_KINDS)).select(*KEYS, "path", "symbol_id", F.col("name").alias("s_name"), F.col("line").alias("s_line"), F.col("end_line").alias("s_end"))
    named = bound.filter("how = 'named'").join(sym, [*KEYS, "path"]).filter("s_name = handler")
    after = bound.filter("how = 'next'").join(sym, [*KEYS, "path"]).filter("s_line > line and s_line <= line + 12")
    after = after.withColumn("k", F.row_number().over(W.partitionBy(*KEYS, "path", "framework", "rule_id", "line").orderBy("s_line"))).filter("k = 1").drop("k")
    inside = bound.filter("how = 'owner'").join(sym, [*KEYS, "path"]).filter("line between s_line and s_end")
    inside = inside.withColumn("k", F.row_number().over(W.partitionBy(*KEYS, "path", "framework", "rule_id", "line").orderBy(F.col("s_end") - F.col("s_line"), F.desc("s_line")))).filter("k = 1").drop("k")
    literal = bound.filter("how = 'literal'").withColumns({"symbol_id": F.concat_ws(":", F.lit("literal"), "value_label"), "s_name": F.lit(""), "s_line": F.lit(0), "s_end": F.lit(0)})
    got = named.unionByName(after).unionByName(inside).unionByName(literal)
    only = got.withColumn("n", F.count("*").over(W.partitionBy(*KEYS, "path", "framework", "rule_id", "line", "handler"))).filter("n = 1")
    candidates = only.select(
        F.sha2(F.concat_ws("|", *KEYS, "path", "framework", "rule_id", F.col("line").cast("string"), "symbol_id"), 256).alias("candidate_id"),
        *KEYS, "framework", "rule_id", "kind", "path", "line", "value_label", F.col("symbol_id").alias("to_id"), S.excerpt(F.col("text")).alias("excerpt"),
    )
    shape = F.coalesce(*[F.when(F.col("framework") == fw, F.col("text").rlike(rx)) for fw, rx in DYNAMIC.items()], F.lit(False))
    excluded = lines.filter(shape & ~F.col("text").rlike(r"^\s*(#|//)")).join(candidates.select(*KEYS, "path", "framework", "line").distinct(), [*KEYS, "path", "framework", "line"], "left_anti")
    return candidates, excluded.select(*KEYS, "framework", "path", "line", F.lit("dynamic-or-unresolved").alias("reason"), S.excerpt(F.col("text")).alias("excerpt"))


#: Queries of one automaton; more are searched block by block, each reading the texts once.
QUERY_BLOCK = 50_000


def _simple_fold(c: str) -> str:
    """A character's lower case as one character: what a letter and its other cases share."""
    x = c.lower() if len(c.lower()) == 1 else c
    return x.upper().lower() if len(x.upper()) == 1 and len(x.upper().lower()) == 1 else x


_FOLDS: dict[int, str] = {}


def folded(text: str) -> str:
    """The text without differences of case, character by character: places stay what they were."""
    if text.isascii():
        return text.lower()
    if not _FOLDS:
        _FOLDS.update({i: f for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (f := _simple_fold(chr(i))) != chr(i)})
    return text.translate(_FOLDS)


class _Queries:
    """An Aho-Corasick automaton of folded queries; made anew in each worker."""

    def __init__(self, queries: list[str]):
        self.queries, self.automaton = queries, None

    def __reduce__(self):
        return _Queries, (self.queries,)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(query, start, end) of the matches in a text, those of one query from left to right without overlap."""
        if self.automaton is None:
            same: dict[str, list[int]] = {}
            for i, q in enumerate(self.queries):
                same.setdefault(folded(q), []).append(i)
            self.automaton = ahocorasick.Automaton()
            for q, ids in same.items():
                self.automaton.add_word(q, (len(q), ids))
            self.automaton.make_automaton()
        out, over = [], {}
        for last, (size, ids) in self.automaton.iter(folded(text)):
            start = last + 1 - size
            if over.get(ids[0], 0) <= start:
                over[ids[0]] = last + 1
                out += [(i, start, last + 1) for i in ids]
        return out


def _with_matches(df: DataFrame, text_col: str, queries: DataFrame, fields: str, rows_of) -> DataFrame:
    """``df``'s columns as struct ``row``, query_id, and the ``fields`` that ``rows_of(text, matches)`` gives with the query's number.

    The queries are the stated set: they go to the tasks in blocks of bounded size.
    """
    asked = queries.filter("query != ''").select("query_id", "query")
    n = -(-asked.count() // QUERY_BLOCK)
    spark, out = df.sparkSession, None
    src = df.select(F.struct(*[F.col(c) for c in df.columns if c != text_col]).alias("row"), F.col(text_col).alias("text")).filter("text is not null")
    schema = T.StructType([src.schema["row"], *T.StructType.fromDDL(f"q int, {fields}")])
    arrow = to_arrow_schema(schema)
    for k in range(max(1, n)):
        block = [(r.query_id, r.query) for r in asked.filter(F.pmod(F.xxhash64("query"), F.lit(max(1, n))) == k).toLocalIterator()]
        finder = spark.sparkContext.broadcast(_Queries([q for _, q in block]))

        def run(batches, finder=finder):
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    found = rows_of(text, finder.value.find(text)) if finder.value.queries else []
                    at += [i] * len(found)
                    rows += found
                columns = [pa.array([r[j] for r in rows], arrow.field(j + 1).type) for j in range(len(arrow) - 1)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at, pa.int64())), *columns], names=arrow.names)

        ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), queries.schema["query_id"]]))
        part = src.mapInArrow(run, schema).join(F.broadcast(ids), "q").drop("q")
        out = part if out is None else out.unionByName(part)
    return out


def _line_matches(text: str, matches: list[tuple[int, int, int]]) -> list[tuple]:
    """(query, line, column, preview) of matches within a line."""
    if not matches:
        return []
    lead = text.startswith("\ufeff")
    starts = [lead, *(m.end() for m in re.finditer(r"\n", text))]
    out = []
    for q, a, b in matches:
        k = bisect_right(starts, a) - 1
        if k < 0:
            continue
        end = starts[k + 1] - 1 if k + 1 < len(starts) else len(text)
        end -= k + 1 < len(starts) and text[end - 1 : end] == "\r" and end > starts[k]
        if b <= end:
            low, high = max(starts[k], a - 60), min(end, b + 220)
            out.append((q, k + 1, a - starts[k] + 1, ("…" if low > starts[k] else "") + text[low:high] + ("…" if high < end else "")))
    return out


def search_text(files: DataFrame, queries: DataFrame, most: int | None = 150) -> DataFrame:
    """Literal, case-insensitive matches of ``queries(query_id, query)``: path, line, column (from 1), preview.

    All queries are looked for at once in each text, character by character without case, so a letter whose lower case
    is longer moves nothing; nothing is joined but their ids. ``most`` per query is the feature's report size (None: all).
    """
    found = _with_matches(files.select(*KEYS, "path", "content"), "content", queries, "line int, column int, preview string", _line_matches)
    out = found.select("row.*", "query_id", "line", "column", "preview")
    if most is None:
        return out
    order = W.partitionBy("query_id").orderBy(*KEYS, "path", "line", "column")
    return out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


def search_symbols(symbols: DataFrame, queries: DataFrame, most: int | None = 150) -> DataFrame:
    """Declarations whose name contains a query, ignoring case: query_id, name, kind, path, line."""
    named = symbols.select(*KEYS, "symbol_id", "name", "kind", "path", "line", F.col("name").alias("_text"))
    found = _with_matches(named, "_text", queries, "first int", lambda text, matches: [(q, a) for q, a, _ in {m[0]: m for m in reversed(matches)}.values()])
    out = found.select("row.repo", "row.revision", "query_id", "row.symbol_id", "row.name", "row.kind", "row.path", "row.line")
    if most is None:
        return out
    order = W.partitionBy("query_id").orderBy(*KEYS, "path", "line", "name", "symbol_id")
    return out.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")


MARKER = "phase string, path string, symbol string, line int, outcome string"
MARKER_KEYS = ["phase", "path", "symbol", "line", "outcome"]


def parse_trace_markers(lines: DataFrame, prefix: str = "@trace ", column: str = "line") -> DataFrame:
    """Lines with ``marker`` (struct) and ``warning``: a marker with a foreign key or a bad value has only the warning.

    Lines without the prefix are dropped: they are no markers.
    """
    at = F.instr(column, prefix)
    body = F.trim(F.substr(F.col(column), at + F.lit(len(prefix))))
    rows = lines.filter(at > 0).withColumn("body", body)
    keys = F.json_object_keys("body")
    m = F.from_json("body", MARKER)
    rows = rows.withColumn("keys", keys).withColumn("m", m)
    warning = (
        F.when(F.col("body") == "", "WIRE_EMPTY")
        .when(F.length("body") > 2000, "WIRE_TOO_LONG")
        .when(F.col("keys").isNull(), "WIRE_NOT_AN_OBJECT")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, MARKER_KEYS)))) > 0, "WIRE_FIELD_FORBIDDEN")
        .when(~F.coalesce(F.col("m.phase").isin("enter", "exit", "error"), F.lit(False)), "WIRE_PHASE")
        .when(~F.coalesce(F.length("m.path").between(1, 500) & F.length("m.symbol").between(1, 200), F.lit(False)), "WIRE_NAME")
        .when(F.array_contains("keys", "line") & ~F.coalesce(F.col("m.line") >= 1, F.lit(False)), "WIRE_LINE")
        .when(F.array_contains("keys", "outcome") & ~F.coalesce(F.col("m.outcome").isin("ok", "error"), F.lit(False)), "WIRE_OUTCOME")
    )
    rows = rows.withColumn("warning", warning)
    return rows.select(*lines.columns, F.when(F.col("warning").isNull(), F.col("m")).alias("marker"), "warning")
