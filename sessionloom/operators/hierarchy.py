"""Parent-child links to full hierarchies, by nested sets.

Within a group, subtree sizes are added up from the leaves, then each node
hands its children their preorder ranges, which are prefix sums over the
siblings' sizes. A node's descendants are the nodes whose preorder number lies
in its range. Nodes that the upward pass never frees are on a cycle or below
one.

Groups of up to ``group_rows`` rows are done in one task each, many to a task.
Larger groups are done by all tasks together: the tour that enters and leaves
each node is a linked list, and doubling its pointers gives the same prefix
sums in a logarithmic number of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom import runtime
from sessionloom.operators import ordering

#: A group with more rows is never gathered in one task.
GROUP_ROWS = 100_000
_BATCH_BYTES = 8 << 20
_KIND = ("root", "child", "orphan", "cycle", "below-cycle")


def solve(parent: np.ndarray) -> dict[str, np.ndarray]:
    """Nested sets of one forest. ``parent`` holds row numbers, -1 for roots.

    Children come in row order. Nodes on or below a cycle have size 0.
    """
    n = len(parent)
    waiting = np.bincount(parent[parent >= 0], minlength=n) if n else np.zeros(0, int)
    up, left, total = parent.tolist(), waiting.tolist(), [1] * n
    ready = [i for i in range(n) if not left[i]]
    while ready:  # upward: a node is freed by its last child
        i = ready.pop()
        p = up[i]
        if p >= 0:
            total[p] += total[i]
            left[p] -= 1
            if not left[p]:
                ready.append(p)
    # The upward pass also frees the leaves below a cycle; only what hangs from a root has a place.
    start, depth, root = [-1] * n, [-1] * n, [-1] * n
    kids: dict[int, list[int]] = {}
    for i in range(n):
        if up[i] >= 0:
            kids.setdefault(up[i], []).append(i)
    at, todo = 0, []
    for i in range(n):
        if up[i] < 0:
            start[i], depth[i], root[i] = at, 0, i
            at += total[i]
            todo.append(i)
    while todo:  # downward: ranges of siblings are prefix sums of their sizes
        i = todo.pop()
        at_child = start[i] + 1
        for c in kids.get(i, ()):
            start[c], depth[c], root[c] = at_child, depth[i] + 1, root[i]
            at_child += total[c]
            todo.append(c)
    start = np.array(start, np.int64)
    return {"start": start, "size": np.where(start >= 0, np.array(total, np.int64), 0), "depth": np.array(depth, np.int64), "root": np.array(root, np.int64)}


def _cyclic(parent: np.ndarray, stuck: np.ndarray) -> np.ndarray:
    """Those of the unplaced nodes that lie on a cycle themselves."""
    on = np.zeros(len(parent), bool)
    seen = np.zeros(len(parent), np.int64)
    for k, i in enumerate(np.flatnonzero(stuck), 1):
        j = int(i)
        while not seen[j]:
            seen[j] = k
            j = int(parent[j])
        if seen[j] == k and not on[j]:
            while not on[j]:
                on[j] = True
                j = int(parent[j])
    return on


def _solve_group(g: pd.DataFrame, paths: bool, separator: str) -> Iterator[pd.DataFrame]:
    ids = g["node"].to_numpy(object)
    at = {v: i for i, v in enumerate(ids)}
    named = g["above"].to_numpy(object)
    parent = np.array([-1 if v is None or v != v else at.get(v, -1) for v in named], np.int64)
    r = solve(parent)
    placed, cyclic = r["start"] >= 0, None
    cyclic = _cyclic(parent, ~placed) if not placed.all() else ~placed
    has = np.array([v is not None and v == v for v in named], bool)
    kind = np.where(~placed, np.where(cyclic, 3, 4), np.where(parent >= 0, 1, np.where(has, 2, 0)))
    out = pd.DataFrame(
        {
            "grp": pd.Series(g["grp"].to_numpy(object), dtype=object), "node": pd.Series(ids, dtype=object), "link": pd.Series([_KIND[k] for k in kind], dtype=object),
            "root": pd.Series([ids[x] if x >= 0 else None for x in r["root"]], dtype=object),
            "depth": pd.array(np.where(placed, r["depth"], 0), "Int64"),
            "range_start": pd.array(r["start"], "Int64"),
            "n_descendants": pd.array(np.maximum(r["size"] - 1, 0), "Int64"),
        }
    )
    for c in ("depth", "range_start", "n_descendants"):
        out.loc[~placed, c] = pd.NA
    if not paths:
        yield out
        return
    text, begun, held = [], 0, 0
    for i in range(len(ids)):  # a path is as long as the node is deep, so they leave in bounded batches
        walk, j = [], i
        while placed[i] and j >= 0:
            walk.append(ids[j])
            j = int(parent[j])
        text.append(separator.join(reversed(walk)) if placed[i] else None)
        held += len(text[-1] or "")
        if held >= _BATCH_BYTES:
            yield out.iloc[begun : i + 1].assign(path=np.array(text, object))
            text, begun, held = [], i + 1, 0
    if text:
        yield out.iloc[begun:].assign(path=np.array(text, object))


_SCHEMA = "grp string, node string, link string, root string, depth bigint, range_start bigint, n_descendants bigint"


def _by_group(batches: Iterator[pd.DataFrame], paths: bool, separator: str) -> Iterator[pd.DataFrame]:
    """Groups come one after another in a sorted partition; small ones are sent on together."""
    held: list[pd.DataFrame] = []
    ready, rows = [], 0

    def flush(last: bool):
        nonlocal held
        if not held:
            return
        have = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        edge = np.flatnonzero((have["grp"] != have["grp"].shift()).to_numpy())
        ends = np.append(edge[1:], len(have))
        done = len(edge) if last else len(edge) - 1
        for a, b in zip(edge[:done], ends[:done]):
            yield from _solve_group(have.iloc[a:b], paths, separator)
        held = [have.iloc[edge[done] :]] if not last else []

    for b in batches:
        held.append(b)
        for out in flush(False):
            ready.append(out)
            rows += len(out)
            if rows >= 4096 or paths:
                yield pd.concat(ready, ignore_index=True)
                ready, rows = [], 0
    for out in flush(True):
        ready.append(out)
        rows += len(out)
        if rows >= 4096 or paths:
            yield pd.concat(ready, ignore_index=True)
            ready, rows = [], 0
    if ready:
        yield pd.concat(ready, ignore_index=True)


def nested_sets(
    rows: DataFrame, group: str, node: str, parent: str, order: str, paths: bool = False, separator: str = "/", group_rows: int = GROUP_ROWS
) -> DataFrame:
    """One row per distinct node of each group, with its place in the hierarchy.

    Columns: ``grp``, ``node``, ``link`` (root, child, orphan: the parent named
    isn't there, so the node heads a tree; cycle: the node lies on one;
    below-cycle: its chain of parents runs into one), ``root``, ``depth`` (0 at
    a root), ``range_start`` and ``n_descendants``: the descendants of a node
    are those of its group with a range_start above its own by at most
    n_descendants. ``path`` (with ``paths``) joins the ids from the root. On or
    below a cycle all places are null.

    Rows with a null node or group are left out: they can't be linked to. Of
    rows with the same node the one with the least order, then parent, counts.
    A node that names itself is a cycle. Siblings follow ``order``, then id.
    Other columns of ``rows``, whatever their names, aren't touched.
    """
    runtime.require_columns(rows, group, node, parent, order)
    spark = rows.sparkSession
    c = lambda name, kind: F.col(f"`{name}`").cast(kind)
    links = rows.select(c(group, "string").alias("grp"), c(node, "string").alias("node"), c(parent, "string").alias("above"), c(order, "bigint").alias("ord"))
    links = links.where("grp is not null and node is not null")
    links = links.groupBy("grp", "node").agg(F.min(F.struct(F.col("ord"), F.col("above"))).alias("x")).select("grp", "node", "x.above", "x.ord")
    links = runtime.materialise(links, "links")
    sizes = links.groupBy("grp").count().where(F.col("count") > group_rows)
    large = runtime.materialise(sizes.select("grp"), "large-groups")
    schema = _SCHEMA + (", path string" if paths else "")
    some = bool(large.take(1))
    small = links.join(large, "grp", "left_anti") if some else links
    out = (
        small.repartition(runtime.shuffle_width(spark), "grp")
        .sortWithinPartitions("grp", "ord", "node")
        .mapInPandas(lambda b: _by_group(b, paths, separator), schema)
    )
    if some:
        out = out.unionByName(_large_groups(links.join(large, "grp", "left_semi"), paths, separator))
    return out


def _large_groups(links: DataFrame, paths: bool, separator: str) -> DataFrame:
    """The same for groups of any size, by pointer doubling; see the module's text."""
    materialise = runtime.materialise
    known = links.select("grp", F.col("node").alias("above"), F.lit(True).alias("there"))
    linked = materialise(
        links.join(known, ["grp", "above"], "left").select(
            "grp", "node", "ord", F.when(F.col("there"), F.col("above")).alias("above"), F.col("above").isNotNull().alias("named")
        ),
        "linked",
    )
    # Ancestors by doubling: nodes that never reach a root are on or below a cycle.
    up = linked.select("grp", "node", F.coalesce("above", "node").alias("top"), F.when(F.col("above").isNull(), 0).otherwise(1).cast("bigint").alias("far"), F.col("above").isNull().alias("done"))
    reach = _double(up)
    # A node lies on a cycle if the walk of as many steps as there are rows ends on it or passes it: nodes that are a far end.
    far_ends = reach.where(~F.col("done")).select("grp", F.col("top").alias("node")).distinct()
    on_cycle = _close(far_ends, linked)
    rooted = reach.where("done").select("grp", "node", F.col("top").alias("root"), F.col("far").alias("depth"))
    placed = materialise(linked.join(rooted, ["grp", "node"]), "placed")
    # The tour: enter each node, its children in order, leave it. Roots follow one another.
    # All roots of a group are siblings, so siblings are numbered over blocks and meet by number.
    family = placed.select("grp", "node", "above", "ord", F.concat_ws("\x1f", "grp", F.concat(F.lit("<"), "above")).alias("family"))
    kin = ordering.with_position(ordering.cut_by_range(family, "family", ["ord", "node"], "b"), "family", ["ord", "node"], "k", F.col("b"))
    kin = materialise(kin.select("grp", "node", "above", "family", "k"), "kin")
    kin = kin.join(kin.select("family", (F.col("k") - 1).alias("k"), F.col("node").alias("next_sib")), ["family", "k"], "left")
    first = kin.where("k = 0 and above is not null").select("grp", F.col("above").alias("node"), F.col("node").alias("first_child"))
    kin = kin.join(first, ["grp", "node"], "left")
    enter = kin.select("grp", F.concat(F.lit("<"), "node").alias("node"), F.coalesce(F.concat(F.lit("<"), "first_child"), F.concat(F.lit(">"), "node")).alias("top"), F.lit(1).cast("bigint").alias("far"))
    leave = kin.select("grp", F.concat(F.lit(">"), "node").alias("node"), F.coalesce(F.concat(F.lit("<"), "next_sib"), F.concat(F.lit(">"), "above"), F.concat(F.lit(">"), "node")).alias("top"), F.lit(0).cast("bigint").alias("far"))
    last = F.col("node") == F.col("top")
    tour = enter.unionByName(leave).withColumn("done", last)
    ranks = _double(tour)
    total = placed.groupBy("grp").count().withColumnRenamed("count", "n")
    place = (
        ranks.withColumn("is_enter", F.col("node").startswith("<"))
        .withColumn("node", F.expr("substring(node, 2)"))
        .groupBy("grp", "node")
        .agg(F.max(F.when(F.col("is_enter"), F.col("far"))).alias("after_enter"), F.max(F.when(~F.col("is_enter"), F.col("far"))).alias("after_leave"))
        .join(total, "grp")
        .select("grp", "node", (F.col("n") - F.col("after_enter")).alias("range_start"), (F.col("after_enter") - F.col("after_leave") - 1).alias("n_descendants"))
    )
    full = linked.join(rooted, ["grp", "node"], "left").join(place, ["grp", "node"], "left").join(on_cycle.withColumn("cyc", F.lit(True)), ["grp", "node"], "left")
    link = (
        F.when(F.col("cyc"), _KIND[3]).when(F.col("root").isNull(), _KIND[4])
        .when(F.col("above").isNotNull(), _KIND[1]).when(F.col("named"), _KIND[2]).otherwise(_KIND[0])
    )
    out = full.select("grp", "node", link.alias("link"), "root", "depth", "range_start", "n_descendants")
    return out.join(_doubled_paths(linked, rooted, separator), ["grp", "node"], "left") if paths else out


def _double(pointers: DataFrame) -> DataFrame:
    """Follow ``top`` pointers to their end: each round squares the distance covered.

    Stops when all are done, or after as many rounds as reach across the
    largest group: what then isn't done runs in a circle.
    """
    materialise = runtime.materialise
    now = materialise(pointers, "pointers")
    longest = now.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(longest).bit_length()):
        if not now.where(~F.col("done")).take(1):
            break
        ahead = now.select("grp", F.col("node").alias("top"), F.col("top").alias("top2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moving = now.where(~F.col("done")).join(ahead, ["grp", "top"])
        moved = moving.select("grp", "node", F.col("top2").alias("top"), F.when(F.col("done2") & (F.col("top") == F.col("top2")) & (F.col("far2") == 0), F.col("far")).otherwise(F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        now = materialise(now.where("done").unionByName(moved), "pointers")
    return now


def _close(ends: DataFrame, linked: DataFrame) -> DataFrame:
    """All nodes of the cycles that ``ends`` lie on: walk on from them until nothing is new."""
    on = runtime.materialise(ends, "cycle")
    reach = on
    steps = linked.select("grp", "node", "above")
    jump = steps.where("above is not null")
    while True:  # parents of cycle nodes are cycle nodes; each round also squares the step
        new = reach.join(jump, ["grp", "node"]).select("grp", F.col("above").alias("node")).distinct().join(on, ["grp", "node"], "left_anti")
        new = runtime.materialise(new, "cycle")
        if not new.take(1):
            return on
        on = runtime.materialise(on.unionByName(new), "cycle")
        reach = on
        twice = jump.select("grp", F.col("node").alias("above"), F.col("above").alias("above2"))
        jump = runtime.materialise(
            jump.unionByName(jump.join(twice, ["grp", "above"]).select("grp", "node", F.col("above2").alias("above"))).distinct().join(on.unionByName(new).distinct(), ["grp", "node"], "left_semi"), "jump"
        )


def _doubled_paths(linked: DataFrame, rooted: DataFrame, separator: str) -> DataFrame:
    """Path texts by doubling: each round puts the path of the node reached in front."""
    now = linked.join(rooted.select("grp", "node"), ["grp", "node"], "left_semi").select("grp", "node", F.col("above").alias("top"), F.col("node").alias("path"))
    now = runtime.materialise(now, "paths")
    while now.where("top is not null").take(1):
        ahead = now.select("grp", F.col("node").alias("top"), F.col("top").alias("top2"), F.col("path").alias("path2"))
        moved = now.where("top is not null").join(ahead, ["grp", "top"]).select("grp", "node", F.col("top2").alias("top"), F.concat("path2", F.lit(separator), "path").alias("path"))
        now = runtime.materialise(now.where("top is null").unionByName(moved), "paths")
    return now.select("grp", "node", "path")


def descendants(places: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """All (grp, node, descendant) of the nodes in ``wanted`` (grp, node), or of all nodes, by their ranges.

    The ranges are cut into blocks of the numbering, so the join is an
    equi-join on (grp, block) with a filter.
    """
    block = 1024
    own = places if wanted is None else places.join(wanted.select("grp", "node").distinct(), ["grp", "node"], "left_semi")
    heads = (
        own.where("n_descendants > 0")
        .select("grp", "node", "range_start", (F.col("range_start") + F.col("n_descendants")).alias("range_end"))
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("range_start") / block), F.floor(F.col("range_end") / block))))
    )
    below = places.where("range_start is not null").select("grp", F.col("node").alias("descendant"), F.col("range_start").alias("at"), F.floor(F.col("range_start") / block).alias("block"))
    return heads.join(below, ["grp", "block"]).where("at > range_start and at <= range_end").select("grp", "node", "descendant")


LEVELS = 40


def ancestors(places: DataFrame, wanted: DataFrame) -> DataFrame:
    """All (grp, node, ancestor) of the nodes in ``wanted`` (grp, node), by their ranges.

    The range below each node is cut into aligned blocks of sizes that are
    powers of two, at most two of a size, and a place lies in one block of each
    size. So the join is by equality, and each of its pairs is in the result.
    """
    own = places.join(wanted.select("grp", "node").distinct(), ["grp", "node"], "left_semi").where("range_start is not null")
    groups = own.select("grp").distinct()
    low, high = "shiftright(lo + shiftleft(1L, l) - 1, l)", "shiftright(hi, l)"
    block = lambda odd, at: f"named_struct('level', l, 'at', if({odd} % 2 = 1 and {low} < {high}, {at}, null))"
    blocks = F.expr(f"filter(flatten(transform(sequence(0, {LEVELS}), l -> array({block(low, low)}, {block(high, high + ' - 1')}))), x -> x.at is not null)")
    heads = places.where("n_descendants > 0").join(groups, "grp", "left_semi").select("grp", F.col("node").alias("ancestor"), (F.col("range_start") + 1).alias("lo"), (F.col("range_start") + F.col("n_descendants") + 1).alias("hi"))
    heads = heads.select("grp", "ancestor", F.explode(blocks).alias("x")).select("grp", "ancestor", "x.*")
    points = own.select("grp", "node", F.explode(F.expr(f"transform(sequence(0, {LEVELS}), l -> named_struct('level', l, 'at', shiftright(range_start, l)))")).alias("x")).select("grp", "node", "x.*")
    return points.join(heads, ["grp", "level", "at"]).select("grp", "node", "ancestor")
