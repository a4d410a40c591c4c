"""Query of operator 9: the given conversations, with tool messages that Spark derives from their rows.

The given table holds no tool calls. Every assistant message therefore also makes a call, and most of
them a second one that needs the first; identifiers, arguments, faults and answers follow from the
message's turn, length and first word, so that the SQL can state the expected steps by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import tool_calls

SCHEMAS = [
    ("search", {"limit": ("integer", False), "query": ("string", True)}),
    ("lookup", {"exact": ("boolean", False), "key": ("string", True)}),
]


def with_tool_messages(conversations: DataFrame) -> DataFrame:
    base = conversations.select("conv_id", "turn", "role", "text")
    told = base.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), F.split(F.coalesce("text", F.lit("")), " ", 2)[0].alias("w")
    )
    told = told.withColumn("id", F.when(F.col("turn") % 6 == 5, "c1").otherwise(F.concat(F.lit("c"), F.col("turn"))))
    need = F.when(F.col("turn") % 4 == 1, F.array(F.concat(F.lit("c"), F.col("turn") - 2))).when(F.col("turn") % 8 == 7, F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>"))
    quoted = tool_calls.quoted(F.col("w"))
    first = F.concat(
        F.lit("{"), F.when(F.col("n") % 7 != 0, F.concat(F.lit('"query":'), quoted, F.lit(","))).otherwise(""),
        F.lit('"limit":'), F.when(F.col("n") % 11 == 0, F.lit('"many"')).otherwise(F.col("n").cast("string")), F.lit("}"),
    )
    second = F.concat(F.lit('{"key":'), quoted, F.when(F.col("n") % 3 == 0, F.lit(',"mode":null')).otherwise(""), F.lit(',"exact":true}'))
    one = F.struct(F.col("id"), F.lit("search").alias("name"), first.alias("arguments"), need.alias("after"))
    two = F.struct(F.concat("id", F.lit("b")).alias("id"), F.when(F.col("n") % 2 == 0, "lookup").otherwise("find").alias("name"), second.alias("arguments"), F.array("id").alias("after"))
    calls = F.when(F.col("n") % 4 == 0, F.array(one)).otherwise(F.array(one, two))
    asked = told.select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(calls.alias("tool_calls"))).alias("text"))
    target = F.when(F.col("n") % 13 == 0, "x").otherwise(F.col("id"))
    answered = told.filter(F.col("n") % 5 != 0).select(
        "conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(target.alias("tool_call_id"), F.col("w").alias("content"))).alias("text")
    )
    return base.unionByName(asked).unionByName(answered)


def steps(conversations: DataFrame) -> DataFrame:
    return tool_calls.steps(with_tool_messages(conversations), SCHEMAS)


SQL = """
WITH RECURSIVE told AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS n, split_part(coalesce(text, ''), ' ', 1) AS w,
    CASE WHEN turn % 6 = 5 THEN 'c1' ELSE 'c' || turn END AS id,
    CASE WHEN turn % 4 = 1 THEN 'c' || (turn - 2) WHEN turn % 8 = 7 THEN 'zz' END AS need
  FROM conversations WHERE role = 'assistant'
),
call AS (
  SELECT conv_id, turn, 0 AS place, id, need, 'search' AS name,
    '{"limit":' || (CASE WHEN n % 11 = 0 THEN '"many"' ELSE CAST(n AS VARCHAR) END) || (CASE WHEN n % 7 <> 0 THEN ',"query":' || CAST(to_json(w) AS VARCHAR) ELSE '' END) || '}' AS args,
    concat_ws(';', CASE WHEN n % 7 = 0 THEN 'missing:query' END, CASE WHEN n % 11 = 0 THEN 'type:limit' END) AS problems
  FROM told
  UNION ALL
  SELECT conv_id, turn, 1, id || 'b', id, CASE WHEN n % 2 = 0 THEN 'lookup' ELSE 'find' END,
    '{"exact":true,"key":' || CAST(to_json(w) AS VARCHAR) || (CASE WHEN n % 3 = 0 THEN ',"mode":null' ELSE '' END) || '}',
    CASE WHEN n % 2 <> 0 THEN 'tool:unknown' WHEN n % 3 = 0 THEN 'unknown:mode' ELSE '' END
  FROM told WHERE n % 4 <> 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn, place) AS k FROM call),
result AS (SELECT conv_id, turn, CASE WHEN n % 13 = 0 THEN 'x' ELSE id END AS id, w FROM told WHERE n % 5 <> 0),
linked AS (
  SELECT r.*, c.turn IS NOT NULL AS late, CASE WHEN c.turn IS NOT NULL THEN row_number() OVER (PARTITION BY r.conv_id, r.id, c.turn IS NOT NULL ORDER BY r.turn, r.w) END AS k
  FROM result r LEFT JOIN ranked c ON c.conv_id = r.conv_id AND c.id = r.id AND c.k = 1 AND r.turn >= c.turn
),
answer AS (SELECT conv_id, id FROM linked WHERE late GROUP BY ALL),
levels AS (
  SELECT conv_id, id, 0 AS level FROM ranked WHERE k = 1 AND need IS NULL
  UNION ALL
  SELECT c.conv_id, c.id, l.level + 1 FROM levels l JOIN ranked c ON c.conv_id = l.conv_id AND c.need = l.id AND c.k = 1
)
SELECT conv_id, turn, 0 AS place, 'message' AS kind, NULL AS id, 'plain' AS status, '' AS problems, 0 AS level,
  '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'unknown')) AS VARCHAR) || '}' AS json
FROM conversations
UNION ALL
SELECT r.conv_id, r.turn, r.place, 'call', r.id, CASE WHEN r.k > 1 THEN 'duplicate' WHEN a.id IS NULL THEN 'unanswered' ELSE 'answered' END, r.problems, l.level,
  '{"after":[' || (CASE WHEN r.need IS NULL THEN '' ELSE CAST(to_json(r.need) AS VARCHAR) END) || '],"arguments":' || r.args || ',"id":' || CAST(to_json(r.id) AS VARCHAR) || ',"name":' || CAST(to_json(r.name) AS VARCHAR) || ',"role":"assistant"}'
FROM ranked r LEFT JOIN answer a USING (conv_id, id) LEFT JOIN levels l USING (conv_id, id)
UNION ALL
SELECT r.conv_id, r.turn, 0, 'result', r.id, CASE WHEN NOT r.late THEN 'orphan' WHEN r.k = 1 THEN 'answer' ELSE 'repeated' END, '', l.level + 1,
  '{"content":' || CAST(to_json(r.w) AS VARCHAR) || ',"role":"tool","tool_call_id":' || CAST(to_json(r.id) AS VARCHAR) || '}'
FROM linked r LEFT JOIN levels l USING (conv_id, id)
"""
