import json

from sessionloom.operators import drift

SCHEMA = "rec_id bigint, stream_id string, file_no bigint, event_type string, payload string, field string"


def make(spark, files):
    rows, n = [], 0
    for stream, kind, no, payloads in files:
        for p in payloads:
            rows.append((n, stream, no, kind, p if isinstance(p, str) or p is None else json.dumps(p), "own column"))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {tuple(r) for r in df.select("stream_id", "file_no", "event_type", "change_kind", "old_field", "new_field").collect()}


FILES = [
    ("s", "m", 1, [{"a": 1, "b": "x", "c": None, "d": True}, {"a": 2, "b": "y"}]),
    ("s", "m", 2, [{"aa": 2, "b": 5, "e": [1]}, {"aa": 3, "b": 6, "d": False}, "{broken", None, "[1]", "7"]),
    ("s", "m", 4, [{"aa": 9, "b": 7, "e": None, "d": True}]),
    ("s", "other", 3, [{"z": 1}]),
    ("s", "m", 5, ["{nothing readable"]),
    ("s", "m", 6, [{"aa": "9", "b": 7, "e": {"k": 1}, "d": True}] * 3),
    ("t", "m", 2, [{"q": 1}]),
    (None, "m", 1, [{"w": 1}]), (None, "m", 2, [{"v": 1}]), ("s", None, 1, [{"w": 1}]), ("s", "m", None, [{"w": 1}]),
]
EXPECTED = {
    ("s", 2, "m", "renamed", "a", "aa"), ("s", 2, "m", "retyped", "b", "b"), ("s", 2, "m", "removed", "c", ""), ("s", 2, "m", "added", "", "e"),
    ("s", 6, "m", "retyped", "aa", "aa"),
}


def test_changes(spark):
    assert found(drift.changes(make(spark, FILES))) == EXPECTED
    assert found(drift.changes(make(spark, FILES + FILES))) == EXPECTED  # delivered again


def test_the_pair_with_more_in_common_goes_first(spark):
    files = [
        ("s", "m", 1, [{"p": 1, "q": 2}, {"p": 3, "q": 4}]),
        ("s", "m", 2, [{"x": 1, "y": 3}, {"x": 3, "y": 2}, {"x": 8, "y": 9}]),
    ]
    assert found(drift.changes(make(spark, files))) == {("s", 2, "m", "renamed", "p", "x"), ("s", 2, "m", "renamed", "q", "y")}


def test_same_value_of_another_type_is_no_rename(spark):
    files = [("s", "m", 1, [{"p": 1}]), ("s", "m", 2, [{"x": "1"}])]
    assert found(drift.changes(make(spark, files))) == {("s", 2, "m", "removed", "p", ""), ("s", 2, "m", "added", "", "x")}


def test_empty(spark):
    none = make(spark, [])
    assert drift.changes(none).count() == 0
    assert drift.unify(none, drift.changes(none), ["rec_id", "stream_id", "event_type", "file_no"]).count() == 0


KEYS = ["rec_id", "stream_id", "event_type", "file_no"]


def test_unified_table(spark):
    rows = make(spark, FILES)
    got = drift.unify(rows, drift.changes(rows), KEYS)
    assert got.count() == rows.count()
    kinds = dict(got.dtypes)
    assert kinds["f_d"] == "boolean" and kinds["f_a"] == "string" and kinds["f_q"] == "bigint" and "f_aa" not in kinds
    by = {r.rec_id: r for r in got.collect()}
    assert by[0].f_a == "1" and by[2].f_a == "2" and by[2].f_e == "[1]" and by[4].f_a is None and by[0].f_b == "x"
    again = drift.unify(rows.unionAll(rows), drift.changes(rows), KEYS)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))


def test_chain_of_renames(spark):
    files = [("s", "m", k, [{name: 7}]) for k, name in enumerate(["one", "two", "three", "one"], 1)]
    rows = make(spark, files)
    names = {(r.file_no, r.field): r.lineage for r in drift.lineages(drift.changes(rows)).collect()}
    assert names == {(2, "one"): "one#2", (2, "two"): "one", (3, "two"): "two", (3, "three"): "one", (4, "three"): "three", (4, "one"): "one"}
    got = drift.unify(rows, drift.changes(rows), KEYS)
    assert got.columns == [*KEYS, "f_one"] and [r.f_one for r in got.orderBy("rec_id").collect()] == [7] * 4


def test_a_name_that_passes_from_field_to_field(spark):
    both = [{"a": 1, "b": 9}, {"a": 2, "b": 8}]
    files = [("s", "m", 1, both), ("s", "m", 3, [{"x": 1, "b": 9}]), ("s", "m", 5, [{"y": 1, "b": 9}]), ("s", "m", 7, [{"x": 9}]), ("s", "m", 8, [{"x": 9, "a": "new"}])]
    rows = make(spark, files)
    log = drift.changes(rows)
    assert {t[3:] for t in found(log) if t[3] == "renamed"} == {("renamed", "a", "x"), ("renamed", "x", "y"), ("renamed", "b", "x")}
    got = {r.rec_id: r.asDict() for r in drift.unify(rows, log, KEYS).collect()}
    assert [got[4][f] for f in ("f_a", "f_b", "f_a#2")] == [None, 9, None] and [got[3][f] for f in ("f_a", "f_b")] == [1, 9]
    assert [got[5][f] for f in ("f_a", "f_b", "f_a#2")] == [None, 9, "new"]


def test_no_digit_is_lost(spark):
    rows = make(spark, [("s", "m", 1, ['{"n": 12345678901234567890, "m": 1, "w": 9007199254740993, "x": 1e3, "t": 1e3, "d": 0.10}', '{"n": 1, "m": 0.25, "w": 1, "x": 2, "t": 9007199254740993, "d": 1e-2}'])])
    got = drift.unify(rows, drift.changes(rows), KEYS)
    kinds = dict(got.dtypes)
    assert [kinds[f"f_{c}"] for c in "nmwxtd"] == ["decimal(20,0)", "decimal(21,2)", "bigint", "double", "string", "double"]
    a, b = got.orderBy("rec_id").collect()
    assert int(a.f_n) == 12345678901234567890 and a.f_w == 9007199254740993 and b.f_t == "9007199254740993" and float(b.f_m) == 0.25


def test_the_rarest_fields_share_a_column(spark):
    rows = make(spark, [("s", "m", 1, [{"a": 1, "z": 1, "y": "q"}]), ("s", "m", 2, [{"a": 1, "z": 3}])])
    got = drift.unify(rows, drift.changes(rows), KEYS, max_columns=2)
    assert got.columns == [*KEYS, "f_a", "f_z", "f_rest"]
    assert [r.f_rest for r in got.orderBy("rec_id").collect()] == ['{"y":"q"}', "{}"]


def test_names_that_differ_in_case(spark):
    rows = make(spark, [("s", "m", 1, [{"A": 1, "a": "x", "k`y": True, "b c": None}])])
    got = drift.unify(rows, drift.changes(rows), ["rec_id", "stream_id", "event_type", "file_no"])
    assert got.columns[4:] == ["f_A", "f_a_2", "f_b c", "f_k`y"]
    assert got.first()[4:] == (1, "x", None, True)
