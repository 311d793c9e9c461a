"""Tool-call linking: calls joined with results by identifier, ordered, validated and serialised.

Everything is a Spark expression: the join is by the hash of the identifier, arguments are parsed as variants and
checked against schemas (fixed, small dictionaries in the plan), and a call's canonical JSON has sorted keys and no spaces.
A call's level is the longest path of dependencies below it: pointer doubling where no call has more than one
dependency (log2 of the depth in rounds), else peeling off the calls whose dependencies all have levels (a round each level).
Order by conversation, level, seq and identifier is a topological order.

Rows: an identifier that several calls have: the first by seq, then name and arguments, is linked, with error
duplicate_call; of several results the first by seq, then content, with error duplicate_result. No result: result is
null, error missing_result. Results without a call are left out. A dependency that no call has is an error
missing_dependency, a cycle leaves level null with error cycle, null identifiers are dropped. Arguments that are null or no JSON object
give invalid_arguments. Arguments and results of any length are serialised whole; repeated rows are duplicates. Empty tables give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: JSON schema types and the variant types they admit.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def _violations(schemas: dict[str, dict[str, dict]]):
    """Errors of name and arguments (variant column `args`): unknown_tool, missing:, type:, unexpected:, range:."""
    checks = [F.when(~F.col("name").isin(*schemas) | F.col("name").isNull(), F.lit("unknown_tool"))]
    for tool, fields in sorted(schemas.items()):
        here = F.col("name") == tool
        for field, rule in sorted(fields.items()):
            value = F.try_variant_get("args", f"$.{field}", "variant")
            kind = F.schema_of_variant(value)
            if rule.get("required", False):
                checks.append(F.when(here & F.col("args").isNotNull() & value.isNull(), F.lit(f"missing:{field}")))
            checks.append(F.when(here & value.isNotNull() & ~kind.rlike(f"^({_TYPES[rule['type']]})$"), F.lit(f"type:{field}")))
            if "max" in rule:
                checks.append(F.when(here & (F.try_variant_get("args", f"$.{field}", "double") > rule["max"]), F.lit(f"range:{field}")))
            if "min_length" in rule:
                checks.append(F.when(here & (F.length(F.try_variant_get("args", f"$.{field}", "string")) < rule["min_length"]), F.lit(f"range:{field}")))
        known = F.array(*map(F.lit, sorted(fields)))
        extra = F.array_except(F.map_keys(F.try_variant_get("args", "$", "map<string,variant>")), known)
        checks.append(F.when(here & (F.size(extra) > 0), F.concat(F.lit("unexpected:"), F.array_join(F.array_sort(extra), ","))))
    return F.array_compact(F.array(*checks))


def levels(deps: DataFrame) -> DataFrame:
    """call_id, depends_on (existing calls only) -> call_id, level; null on or behind a cycle."""
    if deps.filter(F.size("depends_on") > 1).isEmpty():
        now = saved(deps.select("call_id", F.get("depends_on", F.lit(0)).alias("up"), F.size("depends_on").cast("long").alias("level")), "levels")
        n, reach = now.count(), 1
        while reach <= n and not now.filter("up is not null").isEmpty():
            above = now.select(F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
            now = saved(now.join(above, "up", "left").select("call_id", F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
            reach *= 2
        return now.select("call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))
    left = saved(deps.select("call_id", F.explode("depends_on").alias("up")), "edges")
    new = saved(deps.filter(F.size("depends_on") == 0).select("call_id", F.lit(0).cast("long").alias("level")), "levels")
    found, level = new, 0
    while not new.isEmpty() and not left.isEmpty():
        level += 1
        rest = saved(left.join(new.select(F.col("call_id").alias("up")), "up", "left_anti").select("call_id", "up"), "edges")
        freed = left.select("call_id").distinct().join(rest.select("call_id").distinct(), "call_id", "left_anti")
        new, left = saved(freed.withColumn("level", F.lit(level).cast("long")), "levels"), rest
        found = found.union(new)
    return deps.select("call_id").join(found, "call_id", "left")


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """calls: call_id, conv_id, seq, name, arguments (JSON text), depends_on (array of identifiers); results: call_id, seq, content.

    Returns call_id, conv_id, seq, level, name, valid, errors, json.
    """
    calls = calls.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct(F.col("seq").cast("long").alias("seq"), "name", "arguments", F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))).alias("c"), F.count(F.lit(1)).alias("times")).select("call_id", "c.*", "times")
    calls = saved(calls, "calls")
    results = results.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct(F.col("seq").cast("long").alias("seq"), "content")).getField("content").alias("result"), F.count(F.lit(1)).alias("answers"))
    edges = calls.select("call_id", F.explode(F.array_distinct("depends_on")).alias("up"))
    edges = edges.join(calls.select(F.col("call_id").alias("up"), F.lit(True).alias("known")), "up", "left")
    edges = edges.groupBy("call_id").agg(F.array_sort(F.collect_list(F.when(F.col("known"), F.col("up")))).alias("existing"), F.count(F.when(F.col("known").isNull(), 1)).alias("lost"))
    edges = saved(calls.select("call_id").join(edges, "call_id", "left").select("call_id", F.coalesce("existing", F.array().cast("array<string>")).alias("depends_on"), F.coalesce("lost", F.lit(0)).alias("lost")), "edges")
    at = levels(edges.select("call_id", "depends_on"))
    all_ = calls.drop("depends_on").join(results, "call_id", "left").join(edges, "call_id").join(at, "call_id")
    parsed = F.try_parse_json("arguments")
    all_ = all_.withColumn("args", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed))
    flag = lambda on, name: F.when(on, F.lit(name))
    errors = F.concat(F.array_compact(F.array(flag(F.col("args").isNull(), "invalid_arguments"), flag(F.col("times") > 1, "duplicate_call"), flag(F.col("answers").isNull(), "missing_result"), flag(F.col("answers") > 1, "duplicate_result"), flag(F.col("lost") > 0, "missing_dependency"), flag(F.col("level").isNull(), "cycle"))), _violations(schemas))
    all_ = all_.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
    args = F.coalesce(F.to_json("args"), F.to_json(F.struct(F.col("arguments").alias("a")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.lit(1 << 30)))
    args = F.when(F.col("args").isNotNull(), args).otherwise(F.regexp_replace(args, r"\}$", ""))
    rest = F.to_json(F.struct("depends_on", "errors", F.col("call_id").alias("id"), "level", "name", "result", "valid"), {"ignoreNullFields": "false"})
    return all_.select("call_id", "conv_id", "seq", "level", "name", "valid", "errors", F.concat(F.lit('{"arguments":'), args, F.lit(","), rest.substr(F.lit(2), F.lit(1 << 30))).alias("json"))


#: What a turn's arguments must hold when conversations are read as calls.
TURN_SCHEMAS = {role: {"chars": {"type": "integer", "required": True, "max": 4000}, "text": {"type": "string", "required": True, "min_length": 1}} for role in ("system", "user")}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as calls and results.

    A turn that is not the assistant's calls the tool named by its role, with its text and length as arguments, and
    depends on the call two turns before or, failing that, one turn before; the assistant's turn is the result of the turn before it.
    Rows without conv_id, turn or role are left out; a null text is empty.
    """
    at = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null and turn is not null and role is not null")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    calls = at.filter("role <> 'assistant'")
    keys = saved(calls.select(name(F.col("turn")).alias("k")).distinct(), "calls")
    calls = calls.withColumns({"near": name(F.col("turn") - 1), "far": name(F.col("turn") - 2)})
    calls = calls.join(keys.select(F.col("k").alias("near"), F.lit(True).alias("has_near")), "near", "left").join(keys.select(F.col("k").alias("far"), F.lit(True).alias("has_far")), "far", "left")
    up = F.when(F.col("has_near"), F.col("near")).when(F.col("has_far"), F.col("far"))
    calls = calls.select(name(F.col("turn")).alias("call_id"), "conv_id", F.col("turn").alias("seq"), F.col("role").alias("name"), F.to_json(F.struct(F.length("text").alias("chars"), "text")).alias("arguments"), F.array_compact(F.array(up)).alias("depends_on"))
    results = at.filter("role = 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return calls, results
