import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionloom.operators import hierarchy as h

SCHEMA = "g string, id string, p string, o bigint"


def brute(rows):
    """(node -> link, root, depth, number of descendants, path) of one group, by walking."""
    up = {}
    for _, i, p, o in sorted(rows, key=lambda r: (r[3], r[2] is not None, r[2] or "")):
        if i is not None:
            up.setdefault(i, p)
    out = {}
    for i in up:
        chain, j = [], i
        while j is not None and j in up and j not in chain:
            chain.append(j)
            j = up[j]
        if j is not None and j in up:
            out[i] = ("cycle" if j == i else "below-cycle", None, None, None, None)
        else:
            link = "child" if len(chain) > 1 else "orphan" if up[i] is not None else "root"
            out[i] = (link, chain[-1], len(chain) - 1, 0, "/".join(reversed(chain)))
    for i, v in out.items():
        if v[1] is not None:
            n = sum(1 for j, w in out.items() if w[4] is not None and w[4].startswith(v[4] + "/"))
            out[i] = (*v[:3], n, v[4])
    return out


def check(spark, rows, **how):
    got = h.nested_sets(spark.createDataFrame(rows, SCHEMA), "g", "id", "p", "o", paths=True, **how).collect()
    for g in {r[0] for r in rows if r[0] is not None}:
        want = brute([r for r in rows if r[0] == g])
        mine = {r.node: (r.link, r.root, r.depth, r.n_descendants, r.path) for r in got if r.grp == g}
        assert mine == want
        starts = sorted(r.range_start for r in got if r.grp == g and r.range_start is not None)
        assert starts == list(range(len(starts)))
        for a in got:  # the ranges hold exactly the descendants
            if a.grp == g and a.range_start is not None:
                inside = {b.node for b in got if b.grp == g and b.range_start is not None and a.range_start < b.range_start <= a.range_start + a.n_descendants}
                assert inside == {n for n, v in want.items() if v[4] is not None and v[4].startswith(a.path + "/")}


TREE = [
    ("s", "a", None, 0), ("s", "b", "a", 1), ("s", "c", "a", 2), ("s", "d", "b", 3), ("s", "e", "gone", 4), ("s", "f", "e", 5),
    ("s", "x", "y", 6), ("s", "y", "x", 7), ("s", "z", "y", 8), ("s", "zz", "z", 9), ("s", "self", "self", 10), ("s", "b", "a", 1),
    ("t", "a", "b", 0), ("t", "c", "", 1), ("s", None, "a", 11), (None, "q", None, 0), ("u", "n", None, None),
]


@pytest.mark.parametrize("size", [h.GROUP_ROWS, 3])
def test_links_ranges_and_paths(spark, size):
    check(spark, TREE, group_rows=size)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert h.nested_sets(empty, "g", "id", "p", "o", paths=True).count() == 0
    extra = spark.createDataFrame([("s", "a", None, 0, 1, 2)], "g string, id string, p string, o bigint, node int, link int")
    assert [r.link for r in h.nested_sets(extra, "g", "id", "p", "o").collect()] == ["root"]
    with pytest.raises(ValueError):
        h.nested_sets(empty, "g", "id", "nope", "o")


def test_long_chain(spark):
    n = 3000
    rows = [("s", str(i), str(i - 1) if i else None, i) for i in range(n)]
    got = h.nested_sets(spark.createDataFrame(rows, SCHEMA), "g", "id", "p", "o")
    r = got.where("node = '0'").first()
    assert (r.n_descendants, r.range_start) == (n - 1, 0) and got.agg({"depth": "max"}).first()[0] == n - 1
    large = h.nested_sets(spark.createDataFrame(rows[:70], SCHEMA), "g", "id", "p", "o", group_rows=10)
    assert large.agg({"depth": "max"}).first()[0] == 69


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 14), min_size=1, max_size=15))
def test_solve_against_walking(parents):
    parents = [p if p < len(parents) else -1 for p in parents]
    r = h.solve(np.array(parents))
    rows = [("s", str(i), str(p) if p >= 0 else None, i) for i, p in enumerate(parents)]
    want = brute(rows)
    for i in range(len(parents)):
        link, root, depth, n, _ = want[str(i)]
        if root is None:
            assert r["start"][i] == -1 and r["size"][i] == 0
        else:
            assert (str(r["root"][i]), r["depth"][i], r["size"][i] - 1) == (root, depth, n)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(-1, 11), min_size=5, max_size=12))
def test_pointer_doubling_against_walking(parents):
    from pyspark.sql import SparkSession

    rows = [("s", str(i), str(p) if 0 <= p < len(parents) else None, i) for i, p in enumerate(parents)]
    check(SparkSession.getActiveSession(), rows, group_rows=1)


def test_descendants(spark):
    places = h.nested_sets(spark.createDataFrame(TREE, SCHEMA), "g", "id", "p", "o")
    wanted = spark.createDataFrame([("s", "a"), ("s", "d"), ("s", "e")], "grp string, node string")
    assert {(r.node, r.descendant) for r in h.descendants(places, wanted).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("e", "f")}


def test_relations_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(g, f"n{i}", f"n{rng.randrange(max(1, i - 6), i)}" if i > 1 and rng.random() < 0.95 else None, i) for g in "ab" for i in range(1, 300)] + [("a", "self", "self", 0)]
    places = h.nested_sets(spark.createDataFrame(rows, "g string, id string, up string, k int"), "g", "id", "up", "k").cache()
    up = {(g, i): p for g, i, p, _ in rows if i != "self"}

    def above(g, i):
        while i := up[g, i]:
            yield i

    want = {(g, i, x) for g, i in up for x in above(g, i)}
    asked = places.select("grp", "node")
    assert {tuple(r) for r in h.ancestors(places, asked.unionAll(asked)).collect()} == want
    assert {(r.grp, r.descendant, r.node) for r in h.descendants(places, asked).collect()} == want


def test_both_ways_agree_above_the_bound(spark):
    rng = random.Random(5)
    n = h.GROUP_ROWS + 1
    parent = [-1 if i < 40_000 else rng.randrange(max(0, i - 50_000), i) for i in range(n)]  # many roots
    rows = spark.createDataFrame(pd.DataFrame({"g": "big", "id": [f"{i:07d}" for i in range(n)], "up": [None if p < 0 else f"{p:07d}" for p in parent], "k": range(n)}))
    got = h.nested_sets(rows, "g", "id", "up", "k").orderBy("node").toPandas()
    want = h.solve(np.array(parent))
    assert (got["range_start"].to_numpy() == want["start"]).all() and (got["n_descendants"].to_numpy() + 1 == want["size"]).all() and (got["depth"].to_numpy() == want["depth"]).all()


def test_relations_of_all_records(spark, tmp_path):
    from sessionloom.plans import registry

    rows = [(n, *r) for n, r in enumerate(TREE, 1)]  # no line's number is divisible by 50
    spark.createDataFrame(rows, "line_id bigint, session_id string, id string, parent_id string, seq bigint").write.parquet(str(tmp_path / "transcript_lines.parquet"))
    want = set()
    for s in "stu":
        for node, (_, _, _, _, path) in brute([r for r in TREE if r[0] == s]).items():
            want |= {(s, above, node) for above in (path or "").split("/")[:-1]}
    got = {n: registry.queries()[n](spark, str(tmp_path)).collect() for n in ("p3_all_descendants", "p3_all_ancestors")}
    below, above = ([(r.session_id, r.id, r.descendant) for r in got["p3_all_descendants"]], [(r.session_id, r.ancestor, r.id) for r in got["p3_all_ancestors"]])
    assert sorted(below) == sorted(above) == sorted(want) and ("s", "a", "d") in want
