"""Chat formatting: tool calls linked to their results, in order, checked and written as canonical JSON.

DataFrame operations only.  Calls and results meet in a join on their identifiers; dependency depths come from pointer
doubling, so a chain of n calls takes log n rounds; positions within a conversation come from a range sort with
partition offsets, so one conversation may hold any share of the rows; arguments are parsed into variants, whose JSON
has sorted keys and no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..session import materialize, scratch

ID = ["conv_id", "call_id"]


def json_type(value: Column) -> Column:
    """JSON schema type of a variant."""
    kind = F.schema_of_variant(value)
    return (F.when(value.isNull() | (kind == "VOID"), "null").when(kind == "BIGINT", "integer").when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number"))


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id and depth: how many calls must come before; null on cycles and behind them.

    ``calls`` has unique ids, and ``after``, the id of the call whose result it uses.  An unknown ``after`` counts as none.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(1).alias("there"))
    start = calls.select(*ID, "after").join(known, ["conv_id", "after"], "left")
    state = materialize(start.select(*ID, F.when(F.col("there") == 1, F.col("after")).alias("up"), F.coalesce("there", F.lit(0)).cast("long").alias("depth")))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = state.where("up IS NOT NULL").join(above, ["conv_id", "up"]).select(*ID, F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        state = materialize(state.where("up IS NULL").select(*ID, "up", "depth").unionByName(moved))
    return state.select(*ID, F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def problems(arguments: Column, parameters: Column) -> Column:
    """What is wrong with parsed arguments under an array of (param, type, required), sorted; null parameters: unknown tool."""
    given = arguments.cast("map<string,variant>")
    names = F.transform(parameters, lambda p: p["param"])
    missing = F.transform(F.filter(parameters, lambda p: p["required"] & ~F.array_contains(F.map_keys(given), p["param"])), lambda p: F.concat(F.lit("missing "), p["param"]))
    held = F.filter(parameters, lambda p: F.array_contains(F.map_keys(given), p["param"]))
    kind = lambda p: json_type(F.element_at(given, p["param"]))
    wrong = F.filter(held, lambda p: (kind(p) != p["type"]) & ~((kind(p) == "integer") & (p["type"] == "number")))
    wrong = F.transform(wrong, lambda p: F.concat(F.lit("type "), p["param"]))
    extra = F.transform(F.array_except(F.map_keys(given), names), lambda k: F.concat(F.lit("unexpected "), k))
    found = F.array_sort(F.concat(missing, wrong, extra))
    return (F.when(arguments.isNull(), F.array(F.lit("not JSON"))).when(~F.schema_of_variant(arguments).startswith("OBJECT"), F.array(F.lit("not an object")))
            .when(parameters.isNull(), F.array(F.lit("unknown tool"))).otherwise(found))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call: conv_id, call_id, position, depth, status, problems, json.

    ``calls``: conv_id, call_id, after, turn, name, arguments (JSON text); ``results``: conv_id, call_id, turn, content;
    ``schemas``: name, param, type, required.  Other columns are not read.  Repeated rows count once.  Of several calls with one
    id the first (turn, name, arguments) counts and the others have the status ``duplicate``; of several results the first
    (turn, content) counts.  ``unidentified``: a null id; ``orphan``: a result without call; ``open``: a call without
    result; ``cycle``: a call that waits for itself; ``invalid``: arguments that break the schema; else ``ok``.
    ``json`` has every call's arguments, whatever its status; a text that does not parse (or repeats a key) stands under ``raw``.
    Positions count a conversation's rows from 1 by depth (those without one last), turn, id and text; a null conv_id is a
    conversation of its own.  Empty tables give no rows.
    """
    with scratch(calls.sparkSession) as keep:
        return keep(_linked(calls, results, schemas))


def _linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    calls = calls.select(*ID, "after", "turn", "name", "arguments").distinct()
    spread = F.when(F.col("call_id").isNull(), F.xxhash64("turn", "name", "arguments", "after"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "call_id", spread).orderBy("turn", "name", "arguments", "after"))
    calls = materialize(calls.withColumn("nth", nth))
    proper = calls.where("nth = 1 AND call_id IS NOT NULL AND conv_id IS NOT NULL")
    first = results.groupBy(*ID).agg(F.min(F.struct("turn", "content")).alias("first"))
    first = first.select(*ID, F.col("first.content").alias("result"), F.col("first.turn").alias("result_turn"), F.lit(True).alias("answered"))
    tools = schemas.groupBy("name").agg(F.collect_set(F.struct("param", "type", "required")).alias("parameters"))  # a tool's parameters
    linked = proper.join(depths(proper), ID, "left").join(first, ID, "left").join(tools, "name", "left")
    linked = linked.withColumn("parsed", F.try_parse_json("arguments"))
    linked = linked.withColumn("problems", problems(F.col("parsed"), F.col("parameters")))
    state = (F.when(F.col("depth").isNull(), "cycle").when(F.col("answered").isNull(), "open").when(F.size("problems") > 0, "invalid").otherwise("ok"))
    shared = [*ID, "after", "turn", "name", "depth", "status", "problems", "parsed", "arguments", "result", "result_turn"]
    linked = linked.withColumn("status", state).select(*shared)
    none = {"depth": "bigint", "problems": "array<string>", "result": "string", "result_turn": "bigint"}
    odd = calls.where("nth > 1 OR call_id IS NULL OR conv_id IS NULL").withColumn("status", F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unidentified").otherwise("duplicate"))
    odd = odd.withColumns({"parsed": F.try_parse_json("arguments"), **{c: F.lit(None).cast(t) for c, t in none.items()}}).select(*shared)
    # the kept side of an orphan may hold null ids, which never equal a call's
    orphans = first.join(proper.select(*ID), ID, "left_anti").withColumn("status", F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "unidentified").otherwise("orphan"))
    empty = {"after": "string", "name": "string", "arguments": "string", "depth": "bigint", "problems": "array<string>", "parsed": "variant"}
    orphans = orphans.withColumn("turn", F.col("result_turn")).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()}).select(*shared)
    every = linked.unionByName(odd).unionByName(orphans).withColumn("call_id", F.col("call_id").cast("string"))
    raw = F.when(F.col("parsed").isNull(), F.col("arguments"))  # a text that is not JSON is kept as it is
    body = F.struct(F.col("after").alias("after"), F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("name").alias("name"), raw.alias("raw"), F.col("result").alias("result"), F.col("status").alias("status"))
    every = every.withColumn("json", F.to_json(body)).drop("parsed")
    order = [F.col("depth").asc_nulls_last(), F.col("turn"), F.col("call_id"), F.col("status"), F.col("json")]
    every = every.withColumn("conversation", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    return number_rows(every, order, "position", ["conversation"]).select(*ID, F.col("position").cast("long").alias("position"), "depth", "status", "problems", "json")
