import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.operators import nested

DEEP = {"role": "user", "content": [{"type": "text", "text": "a"}, {"content": [{"content": "inner"}, "plain"]}, "s"], "other": {"content": [1, None]}}


def paths(value):
    """Block paths by plain recursion."""
    out = set()

    def go(v, pre):
        if isinstance(v, dict):
            for k, x in v.items():
                if k == "content" and isinstance(x, list):
                    for n, y in enumerate(x):
                        out.add(f"{pre}{n}")
                        go(y, f"{pre}{n}.")
                elif k == "content" and isinstance(x, str):
                    if x:
                        out.add(f"{pre}0")
                else:
                    go(x, pre)
        elif isinstance(v, list):
            for y in v:
                go(y, pre)

    go(value, "")
    return out


def found(spark, records):
    rows = spark.createDataFrame([(str(i), r) for i, r in enumerate(records)], "id string, message string")
    nodes = nested.label(rows, "message", ["id"], nested.CONTENT)
    out = {}
    for r in nested.content_elements(nodes).collect():
        out.setdefault(int(r.id), set()).add(r.block_path)
    return out


def test_encodings_and_unreadable(spark):
    text = json.dumps(DEEP)
    records = [text, json.dumps(text), repr(DEEP), json.dumps(repr(DEEP)), text[:30], "", None, "not json", "5", json.dumps({"content": ""}), json.dumps({"content": None}), json.dumps({"content": "x" * 300_000}), "[" * 5000]
    got = found(spark, records)
    assert [got.get(i) for i in range(4)] == [paths(DEEP)] * 4
    assert {i: v for i, v in got.items() if i >= 4} == {11: {"0"}}


JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.text(max_size=2)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.sampled_from(["content", "a", "[]", ".content"]), x, max_size=3)), max_leaves=12)


@settings(max_examples=3, deadline=None)
@given(st.lists(JSON, min_size=1, max_size=30))
def test_paths_against_recursion(values):
    from pyspark.sql import SparkSession

    got = found(SparkSession.getActiveSession(), [json.dumps(v) for v in values])
    for i, v in enumerate(values):
        assert got.get(i, set()) == (paths(v) if isinstance(v, (dict, list)) else set())


def test_links(spark):
    rows = spark.createDataFrame([("r", json.dumps(DEEP), 1)] * 2, "id string, message string, dewey int")
    nodes = nested.label(rows, "message", ["id"])
    assert nodes.count() == 2 * len(list(nested.walk(DEEP)))
    nodes = nested.label(rows.limit(1), "message", ["id"])
    labels = {r.node: r for r in nested.table_of(nodes, "").collect()}
    assert labels[""].parent is None and labels[""].fields == {"role": "user"}
    assert all(r.parent in labels for r in labels.values() if r.node)
    elements = {r.block_path: r for r in nested.content_elements(nodes).collect()}
    assert elements["1.0.0"].parent_path == "1.0" and elements["1"].parent_path is None and elements["1.0.0"].node_value == "inner"


def test_text_encoded_many_times(spark):
    text = json.dumps({"content": ["a", "b"]})
    for _ in range(9):
        text = json.dumps(text)
    assert found(spark, [text]) == {0: {"0", "1"}}
    assert nested.decode(json.dumps("plain words")) == "plain words" and nested.decode("'5'") == 5


def test_tables_link_every_row_to_the_row_above(spark):
    record = {"role": "user", "n": 1, "o": {"k": True, "deep": {"x": None}}, "l": [[1, {"y": "z"}], {"m": []}, None], "e": []}
    rows = spark.createDataFrame([("r", json.dumps(record)), ("s", "[[1], 2]"), ("t", "7"), ("u", "{")], "id string, message string")
    got = {(r.id, r.node): r for r in nested.flat(nested.label(rows, "message", ["id"])).collect()}
    seen = {(r.table_path, r.parent, r.place, repr(r.fields and dict(sorted(r.fields.items()))), r.node_value) for (i, _), r in got.items() if i == "r"}
    assert seen == {
        ("$", None, None, "{'n': '1', 'role': 'user'}", None), ("$.o", "", None, "{'k': 'true'}", None), ("$.o.deep", "2", None, "{'x': None}", None), ("$.l[][]", "", 0, "None", "1"),
        ("$.l[][]", "", 1, "{'y': 'z'}", None), ("$.l[]", "", 1, "{}", None), ("$.l[]", "", 2, "None", None),
    }
    assert {(r.table_path, r.parent, r.place) for (i, _), r in got.items() if i == "s"} == {("$[][]", "", 0), ("$[]", "", 1)} and not [i for i, _ in got if i in "tu"]
    assert all(r.parent is None or r.parent == "" or (i, r.parent) in got for (i, _), r in got.items())


def test_empty(spark):
    rows = spark.createDataFrame([], "id string, message string")
    assert nested.content_elements(nested.label(rows, "message", ["id"])).count() == 0
    with pytest.raises(ValueError):
        nested.label(rows, "message", ["nope"])


def test_whole_subtrees_link_by_label(spark):
    rows = spark.createDataFrame([("r", json.dumps({"content": [{"type": "toolCall", "arguments": {"a": [1, None]}}, {"arguments": "text"}]}))], "id string, message string")
    nodes = nested.label(rows, "message", ["id"], nested.CONTENT + r"|\.arguments$", r"\.arguments$")
    given = {r.parent: r.node_value for r in nested.table_of(nodes, r"\.arguments$").collect()}
    assert given == {"0.0": '{"a": [1, null]}', "0.1": "text"}
