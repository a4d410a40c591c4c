"""Chat messages with linked tool calls as canonical JSON, in SQL functions alone.

A message of role `assistant` whose text is a JSON object with an array `tool_calls` makes calls: id,
name, arguments (an object, or its JSON text) and after (ids of calls whose results it needs). A
message of role `tool` whose text is a JSON object with `tool_call_id` brings a result. Other messages
are plain text.

Calls and results of a conversation are hash-joined by identifier. The first call of an id counts, by
turn and place, later ones are `duplicate`; of several results of an id the first after its call is
the answer, the others `repeated`; a result without a call before it is an `orphan`; a call without an
answer is `unanswered`. Arguments are checked against the tool's schema: required names, known names
and kinds. Steps are ordered topologically: plain messages and calls by turn; a call after the answers
of the calls that it names, and an answer after its call. A call whose needs form a ring, or name no
call of the conversation, has no level and stands last.

Canonical JSON: keys in alphabetical order, no spaces, numbers as written by the SQL function.

Defined cases: null text is an empty message, null role is "unknown"; null conversation ids form one
conversation, null turns come first; repeated rows are repeated steps; malformed JSON is plain text; an
empty table gives no steps; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.session import cut

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"

#: A tool's schema: (name, {argument: (kind, required)}); kinds are string, integer, number, boolean.
Schemas = Sequence[tuple[str, dict[str, tuple[str, bool]]]]
_KINDS = {"string": '^".*"$', "integer": "^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$", "boolean": "^(true|false)$"}


def quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v")))
    return F.substring(whole, F.lit(6), F.char_length(whole) - 6)


def canonical_object(pairs: Column) -> Column:
    """JSON object of a map<string, string> whose values are JSON already."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def argument_map(arguments: Column) -> Column:
    """Top-level arguments as name -> JSON text; null if they are no object."""
    names = F.json_object_keys(arguments)
    parsed = F.try_parse_json(arguments).try_cast("map<string,variant>")
    return F.when(names.isNotNull(), F.transform_values(parsed, lambda _, v: F.coalesce(F.to_json(v), F.lit("null"))))


def problems(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Names of missing, unknown and ill-typed arguments, as sorted texts; `tool` for an unknown tool."""
    out = F.array(F.lit("tool:unknown"))
    for tool, fields in schemas:
        known = F.array(*[F.lit(f) for f in fields]) if fields else F.array().cast("array<string>")
        need = [F.when(~F.coalesce(F.map_contains_key(arguments, F.lit(f)), F.lit(False)), F.lit(f"missing:{f}")) for f, (_, required) in fields.items() if required]
        wrong = [F.when(F.map_contains_key(arguments, F.lit(f)) & ~F.try_element_at(arguments, F.lit(f)).rlike(_KINDS[kind]), F.lit(f"type:{f}")) for f, (kind, _) in fields.items()]
        extra = F.transform(F.array_except(F.map_keys(arguments), known), lambda n: F.concat(F.lit("unknown:"), n))
        found = F.array_compact(F.concat(F.array(*need, *wrong).cast("array<string>"), F.coalesce(extra, F.array().cast("array<string>"))))
        found = F.when(arguments.isNull(), F.array(F.lit("arguments:not an object"))).otherwise(F.array_sort(found))
        out = F.when(name == tool, found).otherwise(out)
    return out


def steps(messages: DataFrame, schemas: Schemas, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per step: conversation, turn, place (in the turn), kind, id, status, problems, level, json.

    kind: message, call or result. level: length of the longest chain of needs before the step; steps in
    order of level, turn and place are in topological order. json: the step as canonical JSON.
    """
    rows = messages.select(
        F.col(f"`{conversation}`").cast("long").alias("_conv"), F.col(f"`{turn}`").cast("long").alias("_turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("unknown")).alias("_role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )
    calls_of = F.from_json("_text", CALLS)["tool_calls"]
    looks = F.col("_text").startswith("{")
    rows = rows.withColumn("_calls", F.when(looks & (F.col("_role") == "assistant"), calls_of)).withColumn("_result", F.when(looks & (F.col("_role") == "tool"), F.from_json("_text", RESULT)))
    rows = cut(rows)  # what the messages tell is read from them once
    is_call, is_result = F.col("_calls").isNotNull(), F.col("_result.tool_call_id").isNotNull()
    plain = rows.filter(~F.coalesce(is_call, F.lit(False)) & ~F.coalesce(is_result, F.lit(False))).select(
        "_conv", "_turn", F.lit(0).alias("_place"), F.lit("message").alias("_kind"), F.lit(None).cast("string").alias("_id"), F.lit("plain").alias("_status"),
        F.array().cast("array<string>").alias("_problems"), F.array().cast("array<string>").alias("_after"),
        F.concat(F.lit('{"content":'), quoted(F.col("_text")), F.lit(',"role":'), quoted(F.col("_role")), F.lit("}")).alias("_json"),
    )
    call = rows.filter(is_call).select("_conv", "_turn", F.posexplode("_calls").alias("_place", "_call"))
    call = call.select(
        "_conv", "_turn", "_place", F.col("_call.id").alias("_id"), F.coalesce("_call.name", F.lit("")).alias("_name"),
        F.coalesce("_call.after", F.array().cast("array<string>")).alias("_after"), argument_map(F.col("_call.arguments")).alias("_arguments"),
    )
    call = cut(call)
    result = rows.filter(is_result).select("_conv", "_turn", F.col("_result.tool_call_id").alias("_id"), F.coalesce("_result.content", F.lit("")).alias("_content"))
    # Hash joins by conversation and identifier; a group is reduced to its first row, never gathered.
    first_call = call.filter(F.col("_id").isNotNull()).groupBy("_conv", "_id").agg(F.min(F.struct(F.coalesce("_turn", F.lit(-1)).alias("t"), F.col("_place").alias("p"))).alias("_first"))
    keyed = lambda a, b: a["_conv"].eqNullSafe(b["_c"]) & (a["_id"] == b["_i"])
    firsts = first_call.select(F.col("_conv").alias("_c"), F.col("_id").alias("_i"), "_first")
    at = lambda t: F.coalesce(t, F.lit(-1))
    linked = result.join(firsts, keyed(result, firsts), "left").drop("_c", "_i")
    linked = cut(linked.withColumn("_late", F.coalesce(at(F.col("_turn")) >= F.col("_first.t"), F.lit(False))).drop("_first"))
    answers = linked.filter("_late").groupBy("_conv", "_id").agg(F.min(F.struct(at(F.col("_turn")).alias("t"), F.col("_content").alias("c"))).alias("_answer"))
    answers = cut(answers.select(F.col("_conv").alias("_c"), F.col("_id").alias("_i"), "_answer"))
    results = linked.join(answers, keyed(linked, answers), "left").drop("_c", "_i").select(
        "_conv", "_turn", F.lit(0).alias("_place"), F.lit("result").alias("_kind"), "_id",
        F.when(~F.col("_late"), "orphan").when((at(F.col("_turn")) == F.col("_answer.t")) & (F.col("_content") == F.col("_answer.c")), "answer").otherwise("repeated").alias("_status"),
        F.array().cast("array<string>").alias("_problems"), F.array("_id").alias("_after"),
        F.concat(F.lit('{"content":'), quoted(F.col("_content")), F.lit(',"role":"tool","tool_call_id":'), quoted(F.col("_id")), F.lit("}")).alias("_json"),
    )
    marked = call.join(firsts, keyed(call, firsts), "left").drop("_c", "_i")
    marked = marked.join(answers, keyed(marked, answers), "left").drop("_c", "_i")
    is_first = (at(F.col("_turn")) == F.col("_first.t")) & (F.col("_place") == F.col("_first.p"))
    calls = marked.select(
        "_conv", "_turn", "_place", F.lit("call").alias("_kind"), "_id",
        F.when(F.col("_id").isNull(), "unnamed").when(~is_first, "duplicate").when(F.col("_answer").isNull(), "unanswered").otherwise("answered").alias("_status"),
        problems(F.col("_name"), F.col("_arguments"), schemas).alias("_problems"), "_after",
        F.concat(
            F.lit('{"after":['), F.array_join(F.transform(F.array_sort(F.array_distinct("_after")), quoted), ","), F.lit('],"arguments":'),
            F.coalesce(canonical_object(F.col("_arguments")), F.lit("null")), F.lit(',"id":'), quoted(F.col("_id")), F.lit(',"name":'), quoted(F.col("_name")),
            F.lit(',"role":"assistant"}'),
        ).alias("_json"),
    )
    calls = cut(calls)
    levels = _levels(calls.filter(F.col("_status").isin("answered", "unanswered")).select("_conv", "_id", "_after"))
    every = plain.unionByName(calls).unionByName(results)
    levels = levels.select(F.col("_conv").alias("_c"), F.col("_id").alias("_i"), "_level")
    level = F.when(F.col("_kind") == "message", 0).when(F.col("_kind") == "call", F.col("_level")).otherwise(F.col("_level") + 1)
    return every.join(levels, keyed(every, levels), "left").select(
        F.col("_conv").alias(conversation), F.col("_turn").alias(turn), F.col("_place").alias("place"), F.col("_kind").alias("kind"), F.col("_id").alias("id"),
        F.col("_status").alias("status"), F.array_join("_problems", ";").alias("problems"), level.cast("int").alias("level"), F.col("_json").alias("json"),
    )


def _levels(calls: DataFrame) -> DataFrame:
    """Level of each call: 0 without needs, else one more than the highest level among its needs.

    Every round settles the calls whose needs are settled; there are as many as the longest chain is long.
    """
    needs = calls.select("_conv", "_id", F.explode(F.array_distinct("_after")).alias("_need")).filter(F.col("_need").isNotNull())
    settled = calls.filter(F.size(F.filter("_after", lambda x: x.isNotNull())) == 0).select("_conv", "_id", F.lit(0).alias("_level"))
    open_ = cut(needs.groupBy("_conv", "_id").agg(F.count("*").alias("_n")))
    needs, settled = cut(needs), cut(settled)
    out, newest = settled, settled
    done = needs.limit(0).select(F.col("_conv"), F.col("_id"), F.lit(0).cast("long").alias("_got"), F.lit(0).alias("_high"))
    while not open_.isEmpty() and not newest.isEmpty():
        fresh = newest.select(F.col("_conv").alias("_c"), F.col("_id").alias("_need"), F.col("_level").alias("_l"))
        met = needs.join(fresh, needs["_conv"].eqNullSafe(fresh["_c"]) & (needs["_need"] == fresh["_need"])).groupBy("_conv", "_id").agg(F.count("*").alias("_got"), F.max("_l").alias("_high"))
        done = cut(done.unionByName(met.withColumn("_high", F.col("_high").cast("int"))).groupBy("_conv", "_id").agg(F.sum("_got").alias("_got"), F.max("_high").alias("_high")))
        ready = open_.alias("o").join(done.alias("d"), F.col("o._conv").eqNullSafe(F.col("d._conv")) & (F.col("o._id") == F.col("d._id")) & (F.col("_got") == F.col("_n")))
        newest = cut(ready.select("o._conv", "o._id", (F.col("_high") + 1).alias("_level")))
        gone = newest.select(F.col("_conv").alias("_c"), F.col("_id").alias("_i"))
        open_ = cut(open_.join(gone, open_["_conv"].eqNullSafe(gone["_c"]) & (open_["_id"] == gone["_i"]), "left_anti"))
        out = out.unionByName(newest)
    return out
