import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from counterpoise.llm import tool_calls

CALLS = "conversation string, call_id string, position bigint, name string, arguments string, depends_on array<string>, level int"
RESULTS = "conversation string, call_id string, position bigint, content string, step string"
SCHEMAS = {
    "add": {
        "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"], "maximum": 9}, "mode": {"enum": ["x", 2]}, "s": {"type": "string", "minLength": 1, "maxLength": 3, "pattern": "^k"}},
        "required": ["a"],
        "additionalProperties": False,
    },
    "free": {},
}


def run(spark, calls, results=()):
    rows = tool_calls.link(spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), SCHEMAS)
    return sorted(rows.collect(), key=lambda r: (r.conversation or "", r.step or 99, r.call_id or ""))


def call(chat, id_, at, deps=None, name="free", args="{}"):
    return (chat, id_, at, name, args, deps, 7)


@pytest.mark.parametrize(
    "args, errors",
    [
        ('{"a": 1}', []),
        ('{"a": 1.0, "b": null, "mode": 2, "s": "kk"}', []),
        ('{"a": -1, "b": 10}', ["a: below 0", "b: above 9"]),
        ('{"a": "1", "mode": "y", "s": ""}', ["a: not of type integer", "mode: not an allowed value", "s: does not match the pattern", "s: shorter than 1"]),
        ('{"s": "kkkk", "extra": 1}', ["a: missing", "arguments: unknown property", "s: longer than 3"]),
        ("[1]", ["arguments: not an object"]),
        ("{", ["arguments: not JSON"]),
        ('{"a":1,"a":2}', ["arguments: not JSON"]),
        (None, ["arguments: missing"]),
        ("", ["arguments: not JSON"]),
    ],
)
def test_arguments(spark, args, errors):
    row = run(spark, [call("c", "1", 0, name="add", args=args)])[0]
    assert row.errors == errors and row.valid == (not errors)


NESTED = {
    "deep": {
        "type": "object",
        "description": "a note",
        "properties": {
            "list": {"type": "array", "items": {"type": "integer", "minimum": 0}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
            "at": {"type": "object", "properties": {"x": {"type": "number", "exclusiveMaximum": 5}, "tags": {"items": {"type": "object", "properties": {"k": {"const": "v"}}, "required": ["k"]}}}, "required": ["x"], "additionalProperties": False},
            "n": {"multipleOf": 0.5, "exclusiveMinimum": 0},
            "c": {"const": {"b": 1, "a": [2]}},
        },
        "minProperties": 1,
        "maxProperties": 4,
    }
}


@pytest.mark.parametrize(
    "args, errors",
    [
        ('{"list": [1, 2], "at": {"x": 4.5, "tags": [{"k": "v"}]}, "n": 1.5, "c": {"a": [2], "b": 1}}', []),
        ('{"list": [], "n": 0}', ["list: fewer items than 1", "n: not above 0"]),
        ('{"list": [1, 1, -1, "x"]}', ["list: items are not unique", "list: more items than 3", "list[]: below 0", "list[]: not of type integer"]),
        ('{"at": {"y": 1}}', ["at.x: missing", "at: unknown property"]),
        ('{"at": {"x": 5, "tags": [{"k": "w"}, {}, 3]}}', ["at.tags[].k: missing", "at.tags[].k: not the one allowed value", "at.tags[]: not of type object", "at.x: not below 5"]),
        ('{"n": 1.3, "c": {"b": 1}}', ["c: not the one allowed value", "n: not a multiple of 0.5"]),
        ('{"at": 3, "list": "x"}', ["at: not of type object", "list: not of type array"]),
        ("{}", ["arguments: fewer properties than 1"]),
        ('{"a": 1, "b": 2, "d": 3, "e": 4, "f": 5}', ["arguments: more properties than 4"]),
    ],
)
def test_nested_schemas(spark, args, errors):
    rows = tool_calls.link(spark.createDataFrame([call("c", "1", 0, name="deep", args=args)], CALLS), spark.createDataFrame([], RESULTS), NESTED)
    assert rows.first().errors == errors


@pytest.mark.parametrize("schema", [{"oneOf": []}, {"properties": {"a": {"$ref": "#/x"}}}, {"additionalProperties": {"type": "string"}}, {"properties": {"a": {"items": [{}]}}}])
def test_schemas_that_cannot_be_checked_are_refused(spark, schema):
    with pytest.raises(ValueError):
        tool_calls.link(spark.createDataFrame([call("c", "1", 0, name="t")], CALLS), spark.createDataFrame([], RESULTS), {"t": schema})


def test_backward_chain_in_few_jobs(spark):
    """Each call waits for the next one of the chat."""

    def jobs(n):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "count")
        rows = run(spark, [call("a", str(i), i, [str(i + 1)] if i < n - 1 else None) for i in range(n)])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [int(r.call_id) for r in rows] == list(range(n))[::-1] and not any(r.in_cycle for r in rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(20), jobs(3_000)
    assert many < few + 80


def test_levels_by_doubling_and_by_peeling_agree(spark):
    rng = random.Random(4)
    rows = [("c", str(i), str(rng.randint(max(0, i - 3), i - 1))) for i in range(1, 40) if rng.random() < 0.9]
    rows += [("c", "50", "51"), ("c", "51", "52"), ("c", "52", "50"), ("c", "53", "51"), ("c", "54", "54"), ("d", "1", "0")]
    edges = spark.createDataFrame(rows, "chat string, id string, dep string")
    one = sorted(map(tuple, tool_calls._chain_levels(edges).collect()))
    assert one == sorted(map(tuple, tool_calls._peeled(edges).collect()))
    assert any(r[3] for r in one) and any(r[2] and r[2] > 2 for r in one)


def test_order_and_cycles(spark):
    rows = run(
        spark,
        [
            call("a", "1", 0),
            call("a", "2", 1, ["1"]),
            call("b", "late", 5),
            call("b", "first", 1, ["late", "mid"]),
            call("b", "mid", 2, ["late", "late"]),
            call("b", "x", 3, ["y"]),
            call("b", "y", 4, ["x"]),
            call("b", "behind", 6, ["y", "late"]),
            call("b", "self", 7, ["self"]),
            call("b", "lost", 8, ["nobody"]),
        ],
    )
    order = [r.call_id for r in rows if r.conversation == "b"]
    assert order == ["late", "lost", "mid", "first", "x", "y", "behind", "self"]
    assert [r.step for r in rows if r.conversation == "b"] == list(range(1, 9))
    assert {r.call_id for r in rows if r.in_cycle} == {"x", "y", "behind", "self"}
    assert [r.errors for r in rows if r.call_id == "lost"] == [["depends_on: no call nobody"]]


def test_long_chain_in_chat_order(spark):
    n = 3_000
    rows = run(spark, [call("a", str(i), i, [str(i - 1)] if i else None) for i in range(n)])
    assert [r.call_id for r in rows if r.step] == [str(i) for i in range(n)]


def test_defined_results(spark):
    calls = [
        call("c", "1", 3, args='{"z": [1, {"b": 1, "a": "é\\n"}], "a": 1.50}'),
        call("c", "1", 2, args='{"k": 0}'),
        call("c", "1", 2, args='{"k": 0}'),
        call(None, "1", 0),
        call("c", None, 4),
        call("c", None, 5, name=None),
        call("c", "6", 6),
        call("", "", None, name="none"),
    ]
    results = [("c", "1", 9, "done", "s"), ("c", "1", 8, None, "s"), ("c", "6", 1, "early", "s"), ("c", "nobody", 1, "x" * 200_000, "s"), (None, None, None, None, None)]
    rows = run(spark, calls, results)
    found = {(r.conversation, r.call_id, r.status): r for r in rows}
    one = found["c", "1", "linked"]
    assert (one.n_calls, one.n_results) == (3, 2)
    assert json.loads(one.canonical) == {"arguments": {"k": 0}, "call_id": "1", "content": None, "depends_on": [], "name": "free", "position": 2}
    assert found["c", "6", "early_result"].n_results == 1
    orphan = found["c", "nobody", "orphan_result"]
    assert orphan.step is None and not orphan.valid and len(json.loads(orphan.canonical)["content"]) == 200_000
    assert sum(r.call_id is None and r.status == "no_result" for r in rows) == 2
    assert (None, None, "orphan_result") in found and (None, "1", "no_result") in found
    assert found["", "", "no_result"].errors == ["name: unknown tool"]
    assert run(spark, []) == []
    assert [r.status for r in run(spark, [], results[:1])] == ["orphan_result"]


def test_canonical_json_sorts_keys_at_every_depth(spark):
    args = '{"z": [1, {"b": 1, "a": "é\\n"}], "a": 1.50, "B": "\\u0041/"}'
    row = run(spark, [call("c", "1", 0, args=args)])[0]
    wanted = json.dumps(json.loads(args), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert row.canonical.startswith('{"arguments":' + wanted + ',"call_id":')


def test_plan_has_no_python(spark):
    frame = tool_calls.link(spark.createDataFrame([call("c", "1", 0)], CALLS).filter(F.lit(True)), spark.createDataFrame([("c", "1", 1, "x", "s")], RESULTS), SCHEMAS)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
