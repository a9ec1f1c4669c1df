"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

Built from DataFrame operations only. Calls and results are hash-joined by identifier,
levels of a topological order come from joins of calls with what they wait for, arguments
are checked against schemas as variants, and a variant's JSON, whose keys are in order and
which has no blanks, is the canonical form.

Edge cases: a result without a call, a call without a result, an identifier used twice,
an unknown tool, arguments that are no JSON object, a missing, unknown or wrongly typed
argument, and calls that wait for each other each give a defined error in `errors`;
null texts are the empty text. Of several results of one call the first turn counts; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import saved

#: Tools by name: argument to (SQL type of the variant, required).
SCHEMAS = {"reply": {"prompt": ("STRING", True), "turn": ("BIGINT", True), "after": ("STRING", False)}}
CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def canonical(json: Column) -> Column:
    """Compact JSON with keys in order; null if it is not JSON."""
    return F.to_json(F.try_parse_json(json))


def _errors(name: Column, arguments: Column, schemas: dict) -> Column:
    """Violations of a call's arguments as an array of texts, in order."""
    kind = F.schema_of_variant(F.col("variant"))
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    per_tool = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (type_, required) in sorted(fields.items()):
            has = F.array_contains(keys, field)
            typed = F.schema_of_variant(F.try_variant_get("variant", f"$.{field}", "variant"))
            found.append(F.when(has & (typed != type_), F.lit(f"{field}: not {type_}")))
            if required:
                found.append(F.when(~has, F.lit(f"{field}: missing")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*(F.lit(f) for f in sorted(fields))))), lambda k: F.concat(k, F.lit(": unknown")))
        per_tool = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), extra)).otherwise(per_tool)
    return F.when(F.col("variant").isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("arguments: no object"))).otherwise(per_tool)


def levels(calls: DataFrame) -> DataFrame:
    """id, level for calls(id, after): 0 without predecessors among the calls, else one more than the highest of theirs.

    Chains of calls with one predecessor each are first contracted by pointer doubling, in as many joins as
    the logarithm of their length; then each round settles one more level of calls with several
    predecessors. Calls on a cycle, or behind one, get no row.
    """
    ids = saved(calls.select("id").where("id is not null").distinct())
    waits = calls.select("id", F.explode(F.array_distinct("after")).alias("on")).join(ids.select(F.col("id").alias("on")), "on", "left_semi").select("id", "on").distinct()
    waits = saved(waits)
    several = waits.groupBy("id").agg(F.count("*").alias("n"), F.first("on").alias("on"))
    steps = ids.join(several, "id", "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    steps = saved(steps.select("id", F.when(one, F.col("on")).otherwise(F.col("id")).alias("to"), F.when(one, 1).otherwise(0).alias("far"), (~one).alias("done")))
    left = None
    while (open_ := steps.where("not done").count()) not in (0, left):
        left = open_
        next_ = steps.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        jumped = steps.where("not done").join(next_, "to").select("id", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        steps = saved(steps.where("done").unionByName(jumped))
    steps = steps.where("done").drop("done")  # pointers that never arrive are on a cycle or behind one
    roots = several.where("n > 1").select("id")
    behind = waits.join(roots, "id", "left_semi").join(steps.select(F.col("id").alias("on"), "to", "far"), "on", "left")
    behind = saved(behind.select("id", "to", "far"))
    known = saved(ids.join(waits.select("id"), "id", "left_anti").select(F.col("id").alias("to"), F.lit(0).alias("level")))
    while True:
        open_ = behind.join(known.select(F.col("to").alias("id")), "id", "left_anti")
        best = open_.join(known, "to", "left").groupBy("id").agg(F.max(F.col("level") + F.col("far") + 1).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("all"))
        new = saved(best.where("all").select(F.col("id").alias("to"), "level"))
        if new.isEmpty():
            break
        known = saved(known.union(new))
    return steps.join(known, "to").select("id", (F.col("level") + F.col("far")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls(id, name, arguments, after, key...) with level, result_turn, result, errors, valid and json.

    results: id, turn, content. Every call stays a row; of an identifier used twice each row says so.
    """
    first = results.where("id is not null").groupBy("id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    uses = calls.groupBy("id").agg(F.count("*").alias("uses"), F.array_distinct(F.flatten(F.collect_set("after"))).alias("after"))
    # an identifier that very many calls share would gather their predecessors: only distinct lists are kept
    order = levels(uses.select("id", "after"))
    rows = calls.join(first, "id", "left").join(order, "id", "left").join(uses.select("id", "uses"), "id", "left")
    rows = rows.withColumn("variant", F.try_parse_json("arguments"))
    own = _errors(F.col("name"), F.col("arguments"), schemas)
    more = F.array_compact(F.array(F.when(F.col("uses") > 1, F.lit("id: used twice")), F.when(F.col("answer").isNull(), F.lit("no result")), F.when(F.col("level").isNull(), F.lit("cycle"))))
    rows = rows.withColumn("errors", F.concat(own, more)).withColumn("valid", F.size("errors") == 0)
    arguments = F.coalesce(F.to_json("variant"), _string(F.col("arguments")))
    text = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), _string(F.col("id")), F.lit(',"name":'), _string(F.col("name")), F.lit(',"result":'), _string(F.col("answer.content")), F.lit("}"))
    return rows.select(*calls.columns, "level", F.col("answer.turn").alias("result_turn"), "errors", "valid", text.alias("json"))


def _string(c: Column) -> Column:
    """A JSON string, or null."""
    whole = F.to_json(F.struct(c.alias("x")))  # {"x":...}
    return F.when(c.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def from_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results held as JSON in texts: {"tool_calls": [...]} and {"tool_call_id": ..., "content": ...}."""
    parsed = messages.select("conv_id", "turn", F.from_json("text", f"tool_calls {CALLS}, tool_call_id string, content string").alias("m"))
    calls = parsed.select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", "turn", "c.id", "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    results = parsed.where("m.tool_call_id is not null").select(F.col("m.tool_call_id").alias("id"), "turn", F.col("m.content").alias("content"))
    return calls, results


def conversation_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plain conversation as calls and results: a user turn calls `reply`, the assistant turn after it is the result.

    The identifier is made of conversation and turn; a call waits for the one two turns before.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    before = F.when(F.col("turn") >= 2, name(F.col("turn") - 2))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn", before.alias("after")))
    after = F.array_compact(F.array(before))
    calls = rows.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = rows.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("id"), "turn", F.col("text").alias("content"))
    return calls, results


def format_conversations(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, id, level, result_turn, errors, valid, json for every call of every conversation."""
    calls, results = conversation_calls(messages)
    return link(calls, results, schemas).select("conv_id", "turn", "id", "level", "result_turn", F.array_join("errors", "; ").alias("errors"), "valid", "json")
