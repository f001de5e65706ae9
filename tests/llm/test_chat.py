"""Tool calls: statuses, order, canonical JSON, and no Python in the plan."""

import json

import pytest

from lookweave.llm import chat

CALLS = "conv_id long, call_id string, after string, turn long, name string, arguments string, status string"
RESULTS = "conv_id long, call_id string, turn long, content string, json string"
SCHEMAS = "name string, param string, type string, required boolean"


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame([("search", "q", "string", True), ("search", "limit", "number", False)], SCHEMAS)


def linked(spark, schemas, calls, results):
    made = chat.link(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS), schemas)
    return made, [tuple(r) for r in made.orderBy("conv_id", "position").collect()]


def test_statuses_and_order(spark, schemas):
    calls = [(1, "b", "a", 2, "search", '{"limit":"3","q":"y","z":{"b":1,"a":[1,2.5]}}'), (1, "a", None, 1, "search", '{"q":"x", "limit": 3}'),
             (1, "a", None, 1, "search", '{"q":"x", "limit": 3}'), (1, "a", None, 9, "search", "{}"), (1, "c", "d", 3, "other", "{bad"), (1, "d", "c", 4, "search", "[1]"),
             (1, "e", "c", 5, "search", None), (2, None, None, 1, "search", "{}"), (None, "q", None, 1, "search", "{}"), (2, "q", "zz", 1, "search", '{"q":"é\\n"}'), (2, "u", None, 1, "other", "{}")]
    results = [(1, "a", 2, "ra"), (1, "a", 1, "r0"), (1, "a", 1, "r0"), (1, "b", 3, "rb"), (2, "zz", 3, "o"), (2, None, 3, "o"), (2, "u", 2, None)]
    made, got = linked(spark, schemas, calls, results)
    assert "Python" not in made._jdf.queryExecution().toString()
    short = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got]
    assert short == [
        (None, "q", 1, None, "unidentified", None),
        (1, "a", 1, 0, "ok", []), (1, "b", 2, 1, "invalid", ["type limit", "unexpected z"]),
        (1, "c", 3, None, "cycle", ["not JSON"]), (1, "d", 4, None, "cycle", ["not an object"]), (1, "e", 5, None, "cycle", ["not JSON"]), (1, "a", 6, None, "duplicate", None),
        (2, "q", 1, 0, "open", []), (2, "u", 2, 0, "invalid", ["unknown tool"]), (2, None, 3, None, "unidentified", None), (2, None, 4, None, "unidentified", None), (2, "zz", 5, None, "orphan", None)]
    assert got[2][6] == '{"after":"a","arguments":{"limit":"3","q":"y","z":{"a":[1,2.5],"b":1}},"id":"b","name":"search","result":"rb","status":"invalid"}'
    texts = {(r[0], r[1], r[4]): json.loads(r[6]) for r in got}
    assert texts[1, "c", "cycle"]["raw"] == "{bad" and texts[1, "a", "duplicate"]["arguments"] == {} and texts[None, "q", "unidentified"]["arguments"] == {}
    assert "raw" not in texts[1, "e", "cycle"]
    for row in got:
        body = json.loads(row[6])
        assert json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == row[6]


def test_long_chain(spark, schemas):
    calls = [(1, f"c{i}", f"c{i - 1}", 100 - i, "search", '{"q":"x"}') for i in range(50)]
    _, got = linked(spark, schemas, calls, [(1, f"c{i}", i, "r") for i in range(50)])
    assert [(r[1], r[2], r[3], r[4]) for r in got] == [(f"c{i}", i + 1, i, "ok") for i in range(50)]


def test_empty_tables(spark, schemas):
    assert linked(spark, schemas, [], [])[1] == []
    _, got = linked(spark, schemas.limit(0), [(1, "a", None, 1, "search", "{}")], [])
    assert [(r[4], r[5]) for r in got] == [("open", ["unknown tool"])]


def test_a_text_with_a_repeated_key_is_kept(spark, schemas):
    _, got = linked(spark, schemas, [(1, "a", None, 1, "search", '{"q":"x","q":"y"}')], [])
    assert json.loads(got[0][6]) == {"id": "a", "name": "search", "raw": '{"q":"x","q":"y"}', "status": "open"}
