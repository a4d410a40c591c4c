import json

from freshet.llm import tool_calls as tc

SCHEMAS = [("search", {"limit": ("integer", False), "query": ("string", True)}), ("now", {})]


def call(i, name="search", arguments=None, after=()):
    return {"id": i, "name": name, "arguments": {"query": "q"} if arguments is None else arguments, "after": list(after)}


def calls(*given):
    return json.dumps({"tool_calls": list(given)})


def result(i, content="r"):
    return json.dumps({"tool_call_id": i, "content": content})


def steps(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS _conv", "2 AS id", "'x' AS json")
    return [r.asDict() for r in tc.steps(df, SCHEMAS).collect()]


def test_links_order_and_checks(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 1, "assistant", calls(call("a"), call("b", after=["a"]), call("c", after=["a", "b"]))),
        (1, 2, "tool", result("b", "rb")), (1, 2, "tool", result("a")), (1, 3, "tool", result("a", "again")), (1, 0, "tool", result("a", "early")),
        (1, 4, "tool", result("zz")), (1, 5, "assistant", calls(call("a", "now", {}), call("d", after=["e"]), call("e", after=["d"]), call("f", after=["nope"]))),
        (2, 0, "assistant", calls(call("a", arguments={"limit": "3", "extra": {"b": 1, "a": [2]}}), call(None), call("x", "who"), call("y", arguments="text"))),
        (2, 1, "tool", result("a", "other conversation")), (2, 2, "assistant", '{"tool_calls": broken'), (2, 3, "tool", "no json"), (2, 4, None, None),
    ]
    found = steps(spark, rows)
    by = {}
    for s in found:
        by.setdefault((s["conv_id"], s["kind"], s["id"]), []).append(s)
    status = lambda *k: sorted(s["status"] for s in by[k])
    assert status(1, "call", "a") == ["answered", "duplicate"] and status(1, "call", "b") == ["answered"] and status(1, "call", "c") == ["unanswered"]
    assert status(1, "result", "a") == ["answer", "orphan", "repeated"] and status(1, "result", "zz") == ["orphan"]
    assert status(2, "call", "a") == ["answered"] and status(2, "call", None) == ["unnamed"] and status(2, "result", "a") == ["answer"]
    level = {k: s[0]["level"] for k, s in by.items() if k[0] == 1 and k[1] == "call"}
    assert level == {(1, "call", "a"): 0, (1, "call", "b"): 1, (1, "call", "c"): 2, (1, "call", "d"): None, (1, "call", "e"): None, (1, "call", "f"): None}
    assert by[(1, "result", "b")][0]["level"] == 2
    problem = {k[2]: s[0]["problems"] for k, s in by.items() if k[:2] == (2, "call")}
    assert problem == {"a": "missing:query;type:limit;unknown:extra", None: "", "x": "tool:unknown", "y": "arguments:not an object"}
    a = by[(2, "call", "a")][0]["json"]
    assert a == '{"after":[],"arguments":{"extra":{"a":[2],"b":1},"limit":"3"},"id":"a","name":"search","role":"assistant"}'
    assert by[(1, "message", None)][0]["json"] == '{"content":"say \\"hi\\"\\n","role":"user"}'
    assert {json.loads(s["json"])["content"] for s in by[(2, "message", None)]} == {'{"tool_calls": broken', "no json", ""}
    for s in found:
        assert json.dumps(json.loads(s["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == s["json"]


def test_long_chain_nulls_repeats_and_empty(spark):
    chain = [(None, 0, "assistant", calls(*[call(f"n{i}", after=[f"n{i - 1}"] if i else []) for i in range(12)]))]
    found = steps(spark, chain + [(None, 1, "tool", result("n5")), (5, None, "user", "x"), (5, None, "user", "x")])
    assert {s["id"]: s["level"] for s in found if s["kind"] == "call"} == {f"n{i}": i for i in range(12)}
    assert [s["level"] for s in found if s["kind"] == "result"] == [6] and sum(s["conv_id"] == 5 for s in found) == 2
    assert steps(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = tc.steps(df, SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
