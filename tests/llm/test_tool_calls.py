"""Tool calls on hand-made conversations."""

import json

from annalake.llm import tool_calls

CALLS = "conv_id bigint, call_id string, follows string, tool string, arguments string"
RESULTS = "conv_id bigint, call_id string, content string"
TOOLS = [("add", "a", "BIGINT", True), ("add", "b", "DECIMAL", False), ("say", "text", "STRING", True), ("say", "to", "ARRAY", False)]


def linked(spark, calls, results):
    tools = spark.createDataFrame(TOOLS, "tool string, field string, type string, required boolean")
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), tools).collect()
    return rows, {(r.conv_id, r.call_id): r for r in rows if r.call_id is not None}


def test_levels_of_long_paths_and_cycles(spark):
    path = [(1, f"c{i}", f"c{i - 1}" if i else None, "add", '{"a":1}') for i in range(20)]
    more = [(1, "x", "y", "add", "{}"), (1, "y", "x", "add", "{}"), (1, "z", "x", "add", "{}"), (1, "w", "gone", "add", "{}"), (2, "c5", "c4", "add", "{}"), (None, "n", None, "add", "{}"), (None, "m", "n", "add", "{}")]
    _, by = linked(spark, path + more, [])
    assert [by[1, f"c{i}"].level for i in range(20)] == list(range(20))
    assert {by[1, c].state for c in "xyz"} == {"cyclic"} and by[1, "x"].level is None
    assert by[1, "w"].level == 0 and by[2, "c5"].level == 0 and by[None, "m"].level == 1


def test_states_and_repeats(spark):
    calls = [(1, "a", None, "add", '{"a":1}'), (1, "a", None, "add", '{"a":1}'), (1, "b", None, "add", '{"a":2}'), (1, None, None, "say", '{"text":"x"}')]
    results = [(1, "a", "2"), (1, "a", "1"), (1, "q", "lost"), (1, None, "no name"), (2, "b", "elsewhere")]
    rows, by = linked(spark, calls, results)
    assert (by[1, "a"].state, by[1, "a"].n_calls, by[1, "a"].n_results) == ("answered", 2, 2)
    assert json.loads(by[1, "a"].record)["result"] == "1"
    assert (by[1, "b"].state, by[1, "q"].state, by[2, "b"].state) == ("pending", "orphan", "orphan")
    assert by[1, "q"].valid is None
    unnamed = [r for r in rows if r.call_id is None]
    assert [r.state for r in unnamed] == ["unnamed"] * 2 and sorted(r.n_calls for r in unnamed) == [0, 1]
    assert len(rows) == 6


def test_arguments_against_fields(spark):
    cases = {
        "ok": ("add", '{"b": 1.5, "a": 1}', ""),
        "missing": ("add", '{"b": 1.5}', "missing a"),
        "kind": ("add", '{"a": "1"}', "not bigint: a"),
        "both": ("add", '{"b": true, "zz": 1, "c": 2}', "missing a; not decimal: b; unknown c; unknown zz"),
        "list": ("say", '{"text": "t", "to": ["x"]}', ""),
        "null": ("add", '{"a": null}', "not bigint: a"),
        "no_json": ("add", "{a", "arguments are not JSON"),
        "nothing": ("add", None, "arguments are not JSON"),
        "array": ("add", "[1]", "arguments are not an object"),
        "repeated": ("add", '{"a": 1, "a": 2}', "arguments are not JSON"),
        "strange": ("fly", "{}", "unknown tool"),
        "toolless": (None, "{}", "unknown tool"),
    }
    _, by = linked(spark, [(1, name, None, tool, text) for name, (tool, text, _) in cases.items()], [])
    assert {name: by[1, name].errors for name in cases} == {name: error for name, (_, _, error) in cases.items()}
    assert {name for name in cases if by[1, name].valid} == {"ok", "list"}


def test_records_are_canonical(spark):
    _, by = linked(spark, [(1, "a", None, "add", '{ "b": {"z": 1, "y": [1, {"q": 2, "p": "é\\n\\""}]}, "a": 1 }')], [(1, "a", 'say "hi"\n')])
    record = by[1, "a"].record
    assert record == json.dumps(json.loads(record), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(record) == {"arguments": {"a": 1, "b": {"z": 1, "y": [1, {"q": 2, "p": 'é\n"'}]}}, "id": "a", "result": 'say "hi"\n', "tool": "add"}


def test_empty_tables_and_odd_conversations(spark):
    assert linked(spark, [], [])[0] == []
    rows = [(1, 0, "user", None, 1), (1, 0, "user", None, 1), (1, 1, "assistant", "", 1), (None, 0, "user", "x", 1), (2, None, "user", "x", 1), (3, 0, None, "x", 1), (4, 0, "user", "long " * 50_000, 1), (5, 0, "assistant", "first", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, level int")
    found = tool_calls.link(*tool_calls.from_conversations(df)).collect()
    assert sorted(r.state for r in found) == ["answered", "orphan", "pending", "unnamed", "unnamed"]


def test_main_path_runs_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = tool_calls.link(*tool_calls.from_conversations(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
