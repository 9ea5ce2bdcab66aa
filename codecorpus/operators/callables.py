"""Calls that go through values: decorated functions, returned callables, and callables passed as arguments (Python).

Each rule is a join over small facts: what a name means in a scope, what a callable returns, what its decorators make of
it. What arguments bind to parameters is followed by resolve.propagate_callables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codecorpus.functions import scalars as S
from codecorpus.functions.texts import parameters_of
from codecorpus.operators.resolve import CALL_COLUMNS, KEYS, propagate_callables
from codecorpus.operators.storage import stored


def enclosing(symbols: DataFrame) -> DataFrame:
    """(owner_id, scope, depth): each Python callable and the callables around it, itself at depth 0."""
    fns = symbols.filter(F.col("kind").isin(S.CALLABLE_KINDS) & F.col("path").endswith(".py"))
    held = stored(fns.select(*KEYS, F.col("symbol_id").alias("scope"), F.col("container_id").alias("outer")), "scopes")
    level, depth = held.select(*KEYS, F.col("scope").alias("owner_id"), "scope", F.lit(0).alias("depth")), 0
    out = level
    while not level.isEmpty():
        depth += 1
        up = level.join(held, [*KEYS, "scope"]).filter("outer is not null").select(*KEYS, "owner_id", F.col("outer").alias("scope"), F.lit(depth).alias("depth"))
        level = stored(up.join(held.select(*KEYS, "scope"), [*KEYS, "scope"], "left_semi"), "enclosing")
        out = out.unionByName(level)
    return out


def parameters(symbols: DataFrame) -> DataFrame:
    """(owner_id, position, name) of Python callables; none where a list is variadic."""
    fns = symbols.filter(F.col("kind").isin(S.CALLABLE_KINDS) & F.col("path").endswith(".py"))
    return fns.select(*KEYS, F.col("symbol_id").alias("owner_id"), F.posexplode(parameters_of("signature", F.lit("python"))).alias("position", "name"))


def meanings(uses: DataFrame, symbols: DataFrame, imported: DataFrame, params: DataFrame, scopes: DataFrame) -> DataFrame:
    """``uses`` (keys, path, owner_id, name) with what the name means there: symbol_id, or param_owner and param_name.

    The nearest scope wins: its parameters, then its own functions; then the file's functions, then imports.
    """
    fns = symbols.filter(F.col("kind").isin(S.CALLABLE_KINDS))
    none = F.lit(None).cast("string")
    inner = params.select(*KEYS, F.col("owner_id").alias("scope"), "name", none.alias("symbol_id"), F.col("owner_id").alias("param_owner"), F.lit(0).alias("order"))
    inner = inner.unionByName(fns.filter("container_id is not null").select(*KEYS, F.col("container_id").alias("scope"), "name", "symbol_id", none.alias("param_owner"), F.lit(1).alias("order")))
    asked = uses.select(*KEYS, "path", "owner_id", "name").distinct()
    near = asked.join(scopes, [*KEYS, "owner_id"]).join(inner, [*KEYS, "scope", "name"]).select(*KEYS, "path", "owner_id", "name", "symbol_id", "param_owner", (2 * F.col("depth") + F.col("order")).alias("rank"))
    top = fns.filter("container_id is null").withColumn("n", F.count("*").over(W.partitionBy(*KEYS, "path", "name"))).filter("n = 1").select(*KEYS, "path", "name", "symbol_id", F.lit(1_000_000).alias("rank"))
    far = top.unionByName(imported.filter("symbol_id is not null").select(*KEYS, "path", F.col("local_name").alias("name"), "symbol_id", F.lit(1_000_001).alias("rank")))
    far = asked.join(far, [*KEYS, "path", "name"]).select(*KEYS, "path", "owner_id", "name", "symbol_id", none.alias("param_owner"), "rank")
    best = near.unionByName(far).groupBy(*KEYS, "path", "owner_id", "name").agg(F.min_by(F.struct("symbol_id", "param_owner"), F.struct("rank", "symbol_id")).alias("m"))
    found = uses.join(best.select(*KEYS, "path", F.col("owner_id").alias("_owner"), "name", "m.symbol_id", "m.param_owner"), [*KEYS, "path", "name"])
    found = found.filter(F.col("owner_id").eqNullSafe(F.col("_owner"))).drop("_owner")
    return found.withColumn("param_name", F.when(F.col("param_owner").isNotNull(), F.col("name")))


def returned_values(direct: DataFrame, links: DataFrame) -> DataFrame:
    """``direct`` (owner_id, symbol_id, param_owner, param_name) with what callables give that return another one's result.

    ``links`` (owner_id, via): ``owner_id`` returns what ``via`` returns. Followed to the end: a round joins the links
    with what the last round found only, and stores that; circles end as nothing new comes.
    """
    value = ["symbol_id", "param_owner", "param_name"]
    known = lambda df: df.withColumn("_v", F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in value]))
    fresh = stored(known(direct.select(*KEYS, "owner_id", *value).distinct()), "returned")
    found, links = fresh, stored(links.select(*KEYS, "owner_id", "via").filter("owner_id != via").distinct(), "return-links")
    while not links.isEmpty() and not fresh.isEmpty():
        step = links.join(fresh.withColumnRenamed("owner_id", "via"), [*KEYS, "via"]).select(*KEYS, "owner_id", *value, "_v").distinct()
        fresh = stored(step.join(found.select(*KEYS, "owner_id", "_v"), [*KEYS, "owner_id", "_v"], "left_anti"), "returned")
        found = found.unionByName(fresh)
    return found.drop("_v")


def decorated_values(symbols: DataFrame, notes: DataFrame, returned: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outputs, passed): the symbols (symbol_id, value_id) that a decorated name stands for, and what each decorator is given (callee_id, symbol_id).

    ``notes`` (symbol_id, step, decorator_id): resolved decorators, step 1 nearest the function. A decorator that returns
    its first parameter, or nothing known, leaves the value as it is.
    """
    first = params.filter("position = 0").select(*KEYS, F.col("owner_id").alias("decorator_id"), F.col("name").alias("first_name"))
    gives = returned.select(*KEYS, F.col("owner_id").alias("decorator_id"), F.col("symbol_id").alias("given"), "param_owner", "param_name").join(first, [*KEYS, "decorator_id"], "left")
    same = F.col("given").isNull() & (F.col("param_owner") == F.col("decorator_id")) & (F.col("param_name") == F.col("first_name"))
    gives = stored(gives.select(*KEYS, "decorator_id", "given", F.coalesce(same, F.lit(False)).alias("same")).filter("same or given is not null").distinct(), "decorator-values")
    value = symbols.join(notes.select(*KEYS, "symbol_id").distinct(), [*KEYS, "symbol_id"], "left_semi").select(*KEYS, "symbol_id", F.col("symbol_id").alias("value_id"))
    value, passed = stored(value, "values"), None
    for step in range(1, (notes.agg(F.max("step")).first()[0] or 0) + 1):
        here = value.join(notes.filter(F.col("step") == step).select(*KEYS, "symbol_id", "decorator_id"), [*KEYS, "symbol_id"], "left")
        given = here.filter("decorator_id is not null").select(*KEYS, F.col("decorator_id").alias("callee_id"), F.col("value_id").alias("symbol_id"))
        passed = given if passed is None else passed.unionByName(given)
        made = here.join(gives, [*KEYS, "decorator_id"], "left")
        value = stored(made.select(*KEYS, "symbol_id", F.when(F.coalesce("same", F.lit(True)), F.col("value_id")).otherwise(F.col("given")).alias("value_id")).distinct(), "values")
    passed = value.limit(0).select(*KEYS, F.col("symbol_id").alias("callee_id"), "symbol_id") if passed is None else passed
    return value, passed.distinct()


def calls_through_values(sites: DataFrame, symbols: DataFrame, bindings: DataFrame) -> bool:
    """Whether callable_calls can find anything: something decorated or returned, or a parameter's name that is called in its file."""
    ours = F.col("path").endswith(".py")
    if not bindings.filter(ours & F.col("binding").isin("return", "return-call", "call-result")).isEmpty():
        return True
    if not symbols.filter(ours & (F.size(F.coalesce("decorators", F.array().cast("array<string>"))) > 0)).isEmpty():
        return True
    names = parameters(symbols).join(symbols.select(*KEYS, F.col("symbol_id").alias("owner_id"), "path"), [*KEYS, "owner_id"]).select(*KEYS, "path", F.col("name").alias("callee_text"))
    return not sites.filter(ours).join(names, [*KEYS, "path", "callee_text"], "left_semi").isEmpty()


def callable_calls(sites: DataFrame, symbols: DataFrame, imported: DataFrame, bindings: DataFrame, direct: DataFrame, decorated: DataFrame) -> DataFrame:
    """``call_candidates`` that go through values: calls of decorated functions 0.72, of returned callables 0.72 (``x = f(); x()``) or 0.70 (``f()()``), also where ``f`` returns what others return, through parameters 0.76, and of decorators by the callable around the decorated one 0.90.

    ``direct`` are resolved calls, ``decorated`` those whose target has decorators. A decorated name stands for what its
    decorators return, bottom-up, or for itself where they return nothing known.
    """
    keep = [*KEYS, *CALL_COLUMNS]
    scopes, params = stored(enclosing(symbols), "scopes"), stored(parameters(symbols), "parameters")
    mean = lambda uses: meanings(uses, symbols, imported, params, scopes)
    py = bindings.filter(F.col("path").endswith(".py"))
    simple = F.col("name").rlike(r"^[A-Za-z_]\w*$")
    said_back = lambda kind: mean(py.filter(F.col("binding") == kind).select(*KEYS, "path", "owner_id", F.col("right_name").alias("name")).filter(simple)).select(*KEYS, "owner_id", "symbol_id", "param_owner", "param_name").distinct()
    relayed = stored(said_back("return-call"), "relayed")
    links = relayed.filter("symbol_id is not null").select(*KEYS, "owner_id", F.col("symbol_id").alias("via"))
    returned = returned_values(said_back("return"), links)
    outer = symbols.select(*KEYS, "symbol_id", "container_id", F.size(F.coalesce("decorators", F.array().cast("array<string>"))).alias("n"), F.col("decorators").alias("all"))
    heads = outer.filter("n > 0").select(*KEYS, "symbol_id", "container_id", F.posexplode("all").alias("at", "text"), "n").withColumn("name", F.regexp_extract("text", r"^([A-Za-z_]\w*)$", 1)).filter("name != ''")
    heads = heads.join(symbols.select(*KEYS, "symbol_id", "path"), [*KEYS, "symbol_id"])
    notes = mean(heads.select(*KEYS, "path", F.col("container_id").alias("owner_id"), "name", F.col("symbol_id").alias("decorated_id"), (F.col("n") - F.col("at")).alias("step"))).filter("symbol_id is not null")
    notes = stored(notes.select(*KEYS, F.col("decorated_id").alias("symbol_id"), "step", F.col("symbol_id").alias("decorator_id"), "owner_id", "path"), "decorations")
    outputs, passed = decorated_values(symbols, notes, returned, params)
    outputs = stored(outputs, "outputs")
    through = lambda calls: calls.join(outputs.select(*KEYS, F.col("symbol_id").alias("to_id"), "value_id"), [*KEYS, "to_id"], "left").withColumn("to_id", F.coalesce("value_id", "to_id")).drop("value_id")
    said = [through(decorated.select(*keep, "to_id")).withColumn("confidence", F.lit(0.72))]
    s = sites.filter("owner_id is not null and path like '%.py'")
    asks = mean(s.filter(F.col("callee_text").rlike(r"^[A-Za-z_]\w*$")).select(*keep, F.col("callee_text").alias("name"))).filter("param_owner is not null")
    asks = stored(asks.select(*keep, "param_owner", "param_name"), "calls-through")
    bound = None
    through_parameters = returned.filter("param_owner is not null").select("repo").unionByName(relayed.filter("param_owner is not null").select("repo"))
    if not asks.isEmpty() or not through_parameters.isEmpty():  # which callables or parameters are passed to which callee
        calls = direct.select(*keep, F.col("to_id").alias("callee_id")).unionByName(said[0].select(*keep, F.col("to_id").alias("callee_id")))
        args = s.select(*keep, F.posexplode("args").alias("position", "arg")).join(calls, keep)
        keyword = F.regexp_extract("arg", r"^([A-Za-z_]\w*)\s*=[^=]", 1)
        args = args.withColumn("keyword", F.when(keyword != "", keyword)).withColumn("name", F.trim(F.when(keyword != "", F.regexp_replace("arg", r"^[A-Za-z_]\w*\s*=", "")).otherwise(F.col("arg")))).filter(simple)
        args = mean(args.select(*KEYS, "path", "owner_id", "name", "callee_id", "position", "keyword"))
        args = args.join(outputs.select(*KEYS, "symbol_id", "value_id"), [*KEYS, "symbol_id"], "left").withColumn("symbol_id", F.coalesce("value_id", "symbol_id"))
        args = args.select(*KEYS, "callee_id", "position", F.col("keyword").alias("name"), "symbol_id", "param_owner", "param_name")
        none = F.lit(None).cast("string")
        given = passed.select(*KEYS, "callee_id", F.lit(0).alias("position"), none.alias("name"), "symbol_id", none.alias("param_owner"), none.alias("param_name"))
        invoked = stored(args.unionByName(given).distinct(), "invocations")
        bound, _ = propagate_callables(invoked, params, asks.select(*KEYS, F.col("param_owner").alias("owner_id"), "param_name"))
        said.append(asks.join(bound.select(*KEYS, F.col("owner_id").alias("param_owner"), F.col("param").alias("param_name"), F.col("symbol_id").alias("to_id")), [*KEYS, "param_owner", "param_name"]).select(*keep, "to_id", F.lit(0.76).alias("confidence")))
    # x = f() .. x(), and f()()
    made = py.filter("binding = 'call-result' and left_name not like 'self.%'").select(*KEYS, "path", "owner_id", F.col("left_name").alias("callee_text"), F.col("line").alias("bound_at"), F.col("right_name").alias("name"))
    late = s.select(*keep).join(made, [*KEYS, "path", "owner_id", "callee_text"]).filter("bound_at < line").withColumn("k", F.row_number().over(W.partitionBy(*keep).orderBy(F.desc("bound_at")))).filter("k = 1").drop("k", "bound_at").withColumn("confidence", F.lit(0.72))
    twice = s.filter(F.col("callee_text").rlike(r"^[A-Za-z_]\w*\(\)$")).select(*keep, F.regexp_extract("callee_text", r"^(\w+)", 1).alias("name"), F.lit(0.70).alias("confidence"))
    makers = mean(late.unionByName(twice)).filter("symbol_id is not null").select(*keep, "confidence", F.col("symbol_id").alias("maker"))
    if bound is not None:  # what returns a parameter, or its result, gives what is passed
        passed_on = bound.select(*KEYS, F.col("owner_id").alias("param_owner"), F.col("param").alias("param_name"), F.col("symbol_id").alias("given"))
        later = relayed.filter("param_owner is not null").join(passed_on, [*KEYS, "param_owner", "param_name"]).select(*KEYS, "owner_id", F.col("given").alias("via"))
        returned = returned_values(returned, links.unionByName(later))
        held = returned.filter("param_owner is not null").join(passed_on, [*KEYS, "param_owner", "param_name"]).select(*KEYS, "owner_id", F.col("given").alias("symbol_id"))
        returned = returned.select(*KEYS, "owner_id", "symbol_id").unionByName(held).distinct()
    gives = returned.filter("symbol_id is not null").select(*KEYS, F.col("owner_id").alias("maker"), F.col("symbol_id").alias("to_id"))
    said.append(through(makers.join(gives, [*KEYS, "maker"]).select(*keep, "to_id", "confidence")))
    applied = notes.filter("owner_id is not null").join(symbols.select(*KEYS, "symbol_id", F.col("line").alias("line")), [*KEYS, "symbol_id"])
    said.append(applied.select(*KEYS, "path", "owner_id", F.lit("@").alias("callee_text"), F.col("line"), (F.col("line") * 10_000).cast("long").alias("ordinal"), F.col("decorator_id").alias("to_id"), F.lit(0.90).alias("confidence")))
    out = said[0]
    for more in said[1:]:
        out = out.unionByName(more.select(out.columns))
    return out.filter("to_id != owner_id").distinct().withColumn("resolver", F.lit("python-static"))
