"""Reads and writes of module variables: tokens of source text as rows, scopes and shadowing by joins over them (TypeScript, JavaScript).

Only files with module variables, own or imported, are cut into tokens, each in one pass; names asked for and braces become rows. Lexical rules: what ``const``, ``let`` and ``var`` declare up to their ``=``, parameters in the brackets before a
body or an arrow, names of inner functions and classes, and what ``catch`` and ``for`` take hide a module variable of that
name within their block, and an arrow's without a body up to the end of its line. Property names, keys and declarations
are no uses; strings, templates and comments are blank.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from codecorpus.functions import scalars as S
from codecorpus.functions.texts import mask_script
from codecorpus.operators.storage import stored

KEYS = ["repo", "revision"]
FILE = [*KEYS, "path"]
SCRIPT = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
TOKEN = r"\n|[A-Za-z_$][\w$]*|\d[\w.]*|\+\+|--|=>|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|[=!]==?|[<>]=|[-+*/%&|^]=|\?\.|\.\.\.|[^\s\w]"
COMPOUND = ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="]
STEP = ["++", "--"]
#: Words before a bracket that make no function of it.
NO_HEADER = ["if", "while", "for", "switch", "with"]
NAME = r"^[A-Za-z_$][\w$]*$"


def module_variables(symbols: DataFrame, imports: DataFrame, imported: DataFrame) -> DataFrame:
    """``(path, name, symbol_id)``: what a name means in a file if nothing hides it: own variables, imported ones by their local name, and ``space.name`` for each variable of a module imported as a whole."""
    own = symbols.filter((F.col("kind") == "variable") & F.col("container_id").isNull()).select(*FILE, "name", "symbol_id")
    there = imported.filter("symbol_id is not null").select(*FILE, F.col("local_name").alias("name"), "symbol_id").join(own.select(*KEYS, "symbol_id"), [*KEYS, "symbol_id"], "left_semi")
    space = F.regexp_extract("excerpt", r"import\s+(?:[\w$]+\s*,\s*)?\*\s*as\s+([A-Za-z_$][\w$]*)", 1)
    whole = imports.filter("target is not null").select(*KEYS, "path", "target", space.alias("space")).filter("space != ''")
    whole = whole.join(own.select(*KEYS, F.col("path").alias("target"), F.col("name").alias("item"), "symbol_id"), [*KEYS, "target"])
    return own.unionByName(there.select(own.columns)).unionByName(whole.select(*FILE, F.concat_ws(".", "space", "item").alias("name"), "symbol_id")).distinct()


_TOKEN = re.compile(TOKEN, re.ASCII)
_RULES = frozenset(["const", "let", "var", "=", ";", "in", "of", "(", ")", "=>", "function", "return"])
_BRACKET = "struct<tok:string,before:string,after:string>"
TOKEN_DDL = f"pos int, tok string, named boolean, line long, line_end int, depth long, before string, before2 string, after string, ruled string, opened {_BRACKET}, closed {_BRACKET}, next_block int, block int"


def script_tokens(text: str, names: set[str]) -> list[tuple]:
    """TOKEN_DDL of each token of a script that is one of ``names`` or a brace, in two passes: what follows, then what came before."""
    every = _TOKEN.findall(mask_script(text))
    toks, places, ends, end = [], [], [], None
    for pos in range(len(every) - 1, -1, -1):
        tok = every[pos]
        if tok == "\n" or tok == ";":
            end = pos
        if tok != "\n":
            toks.append(tok)
            places.append(pos)
            ends.append(end)
    for x in (toks, places, ends):
        x.reverse()
    n = len(toks)
    near = lambda i: toks[i] if 0 <= i < n else None
    bracket = lambda i: None if i is None else {"tok": toks[i], "before": near(i - 1), "after": near(i + 1)}
    ahead, closed, brace = [], None, None
    for i in range(n - 1, -1, -1):
        tok = toks[i]
        if tok == "(" or tok == ")":
            closed = i
        elif tok == "{":
            brace = places[i]
        ahead.append((closed, brace))
    ahead.reverse()
    out, depth, ruled, opened, blocks, line, seen = [], 0, None, None, {}, 1, 0
    for i, tok in enumerate(toks):
        if tok in _RULES:
            ruled = tok
            if tok == "(" or tok == ")":
                opened = i
        elif tok == "{":
            depth += 1
            blocks[depth] = places[i]
        named = tok in names
        if named or tok == "{" or tok == "}":
            line, seen = line + every[seen : places[i]].count("\n"), places[i]
            closed, brace = ahead[i]
            # an opening brace and what it holds have the same depth; its closing brace has it too
            out.append((places[i], tok, named, line, ends[i], depth, near(i - 1), near(i - 2), near(i + 1), ruled, bracket(opened), bracket(closed), brace, blocks.get(depth)))
        if tok == "}":
            depth -= 1
    return out


def token_rows(files: DataFrame) -> DataFrame:
    """``(path, pos, tok, named, line, depth, ..)`` of script files with ``names``: the tokens that are one of the names, and braces, with their neighbours, their block, the word that rules a declaration so far and the brackets around. One pass over each file's text."""
    src = files.filter(S.extension(F.col("path")).isin(SCRIPT) & F.col("content").isNotNull()).select(*FILE, "content", "names")
    schema = T.StructType([*src.select(*FILE).schema, *T.StructType.fromDDL(TOKEN_DDL)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                at, rows = [], []
                for i, (text, names) in enumerate(zip(batch.column("content").to_pylist(), batch.column("names").to_pylist())):
                    found = script_tokens(text, set(names))
                    at += [i] * len(found)
                    rows += found
                keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in FILE]
                columns = [pa.array([r[j] for r in rows], arrow.field(j + len(FILE)).type) for j in range(len(arrow) - len(FILE))]
                yield pa.RecordBatch.from_arrays([*keys, *columns], names=arrow.names)

    return src.mapInArrow(run, schema)


def _blocks(tokens: DataFrame) -> DataFrame:
    """``(block, block_end)``: of each opening brace the place of its closing one; the end of the file where there is none."""
    at = W.partitionBy(*FILE, "depth").orderBy("pos")
    b = tokens.filter(F.col("tok").isin("{", "}")).withColumn("end", F.lead("pos").over(at))
    return b.filter("tok = '{'").select(*FILE, F.col("pos").alias("block"), F.coalesce("end", F.lit(2**31 - 1)).alias("block_end"))


def state_tokens(files: DataFrame, variables: DataFrame) -> DataFrame:
    """``(path, line, name, operator)``: uses of ``variables`` (module_variables) that nothing hides; the operator is '' for a read."""
    wanted = variables.select(*FILE, "name").distinct()
    heads = wanted.select(*FILE, F.split("name", r"\.")[0].alias("tok")).distinct()
    tails = wanted.filter("name like '%.%'").select(*FILE, F.split("name", r"\.")[1].alias("tok"))
    names = heads.unionByName(tails).groupBy(*FILE).agg(F.collect_set("tok").alias("names"))
    tokens = stored(token_rows(files.select(*FILE, "content").join(names, FILE)), "state-tokens")
    named = tokens.filter(F.col("named") & F.col("tok").rlike(NAME))
    header = (F.col("opened.tok") == "(") & (F.col("closed.tok") == ")") & ~F.coalesce(F.col("opened.before").isin(NO_HEADER), F.lit(False))
    parameter = header & F.col("closed.after").isin("{", "=>", ":") & ~F.coalesce(F.col("before").isin("=", ":", ".", "?."), F.lit(False)) & ((F.col("closed.after") != ":") | (F.col("opened.before") != "?"))
    bare_arrow = F.coalesce(F.col("after") == "=>", F.lit(False))
    local = F.coalesce(F.col("ruled").isin("const", "let", "var"), F.lit(False)) & ~F.coalesce((F.col("after") == ":") & F.col("before").isin("{", ","), F.lit(False))
    inner = F.coalesce(F.col("before").isin("function", "class"), F.lit(False))
    looped = local & F.coalesce((F.col("opened.tok") == "(") & (F.col("opened.before") == "for"), F.lit(False))
    parameter = F.coalesce(parameter, F.lit(False)) | looped
    made = named.withColumns({"parameter": parameter | bare_arrow, "declares": parameter | bare_arrow | local | inner})
    blocks = _blocks(tokens)
    # an arrow without a body, and a parameter whose body is elsewhere, hide up to the end of the statement's line
    scope = F.when(F.col("parameter"), F.when(F.col("next_block") < F.coalesce("line_end", F.lit(2**31 - 1)), F.col("next_block"))).otherwise(F.col("block"))
    hides = made.filter(F.col("declares") & (F.col("parameter") | (F.col("depth") > 0))).withColumn("block", scope)
    hides = hides.join(blocks, [*FILE, "block"], "left").select(*FILE, F.col("tok").alias("head"), F.when(F.col("parameter"), F.col("pos")).otherwise(F.col("block")).alias("from_pos"), F.coalesce("block_end", "line_end", F.lit(2**31 - 1)).alias("to_pos"))
    dotted = F.coalesce(F.col("before").isin(".", "?."), F.lit(False))
    name = F.when(dotted, F.concat_ws(".", "before2", "tok")).otherwise(F.col("tok"))
    key = F.coalesce((F.col("after") == ":") & F.col("before").isin("{", ","), F.lit(False))
    uses = made.filter(~F.col("declares") & ~key).withColumn("name", name).join(wanted, [*FILE, "name"], "left_semi")
    stepped = F.coalesce(F.col("after").isin(STEP), F.lit(False)) | F.coalesce(F.when(dotted, F.lit(False)).otherwise(F.col("before").isin(STEP)), F.lit(False))
    operator = F.when(stepped, "++").when(F.col("after") == "=", "=").when(F.col("after").isin(COMPOUND), F.col("after")).otherwise("")
    uses = uses.select(*FILE, "pos", "line", "name", F.split("name", r"\.")[0].alias("head"), F.coalesce(operator, F.lit("")).alias("operator"))
    seen = uses.join(hides, [*FILE, "head"]).filter("pos between from_pos and to_pos").select(*FILE, "pos").distinct()
    return uses.join(seen, [*FILE, "pos"], "left_anti").select(*FILE, "line", "name", "operator")
