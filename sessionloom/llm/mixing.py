"""Sources mixed to target shares, by balanced sampling with the cube method.

Every document of a source has the same expected number of copies. The whole
part is certain; the rest is a probability that a random walk moves to 0 or 1
for one document after another, always within the null space of the balancing
equations, so the number of documents and the number of tokens stay what they
were. The few documents per task that the walk leaves are walked together, and
the last two per source are rounded to the nearest total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import runtime

#: A source's documents are walked in so many strands at least, and in as many that none has more than its share of documents.
STRANDS, STRAND_ROWS = 64, 200_000
#: Documents per source that are rounded together at the end.
LAST = 14
_EPS = 1e-9


def plan(totals: list[tuple[str, int]], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """Expected copies per document of each source.

    The mix is as large as the scarcest source allows at its highest number of
    repeats. Sources without tokens or without a share are left out, and the
    others keep their proportions.
    """
    have = dict(totals)
    wanted = [(s, share, cap) for s, share, cap in targets if share and share > 0 and cap and cap > 0 and have.get(s)]
    if not wanted:
        return {}
    size = min(have[s] * cap / share for s, share, cap in wanted)
    return {s: min(share * size / have[s], cap) for s, share, cap in wanted}


class Walk:
    """The flight phase over a stream: at most two documents stay undecided."""

    def __init__(self, seed: str):
        self.random = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "big")))
        self.active: list[list] = []

    def add(self, item, size: float, p: float) -> list[tuple[object, int]]:
        """Take one in; returns those that are decided, with 0 or 1."""
        if p <= _EPS or p >= 1 - _EPS:
            return [(item, int(p > 0.5))]
        self.active.append([item, size, p])
        return self._move() if len(self.active) == 3 else []

    def _move(self) -> list[tuple[object, int]]:
        a, b, c = (x[1] for x in self.active)
        way = (c - b, a - c, b - a)  # orthogonal to (1, 1, 1) and to the sizes
        if not any(way):
            way = (1.0, -1.0, 0.0)
        p = [x[2] for x in self.active]
        up = min((1 - q) / u if u > 0 else q / -u for q, u in zip(p, way) if u)
        down = min(q / u if u > 0 else (1 - q) / -u for q, u in zip(p, way) if u)
        step = up if self.random.random() * (up + down) < down else -down
        out, left = [], []
        for x, u in zip(self.active, way):
            x[2] += step * u
            if x[2] <= _EPS or x[2] >= 1 - _EPS:
                out.append((x[0], int(x[2] > 0.5)))
            else:
                left.append(x)
        self.active = left
        return out


_SCHEMA = "doc_id bigint, source string, n_tokens bigint, base bigint, p double, chosen int"


def _flight(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by source and strand; undecided ones leave with their probability."""
    walk, now = None, None

    def rest():
        return [] if walk is None else [(*x[0], x[2], None) for x in walk.active]

    for b in batches:
        out = []
        for doc, source, size, base, p, strand in zip(b["doc_id"], b["source"], b["n_tokens"], b["base"], b["p"], b["strand"]):
            if (source, strand) != now:
                out += rest()
                walk, now = Walk(f"{seed}|{source}|{strand}"), (source, strand)
            out += [(*item, float(d), d) for item, d in walk.add((doc, source, size, base), size, p)]
        yield _frame(out)
    yield _frame(rest())


def _landing(key: tuple, rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """At most two documents for each strand of one source.

    All but a few of every size are walked once more; of all ways to round the
    rest the one nearest to the totals of tokens and of documents is taken. The
    walk hardly moves a document far larger than the others, so those few must
    be able to make up for it.
    """
    rows = rows.sort_values(["n_tokens", "doc_id"], ascending=False)
    todo = list(zip(rows["doc_id"], rows["source"], rows["n_tokens"], rows["base"], rows["p"]))
    walk, out = Walk(f"{seed}|{key[0]}|landing"), []
    kept = {round(i) for i in np.linspace(0, len(todo) - 1, min(LAST, len(todo)))} if todo else set()
    for i, (*item, p) in enumerate(todo):
        if i not in kept:
            out += [(*x, float(d), d) for x, d in walk.add(tuple(item), item[2], p)]
    left = [(tuple(x[0]), x[1], x[2]) for x in walk.active] + [(t[:4], t[2], t[4]) for i, t in enumerate(todo) if i in kept]
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    size, p = np.array([x[1] for x in left], float), np.array([x[2] for x in left], float)
    miss = np.abs(ways @ size - size @ p) / max(1.0, size.mean() if len(left) else 1.0) + 0.1 * np.abs(ways.sum(1) - p.sum())
    best = ways[int(miss.argmin())]
    return _frame(out + [(*x[0], x[2], int(k)) for x, k in zip(left, best)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["doc_id", "source", "n_tokens", "base", "p", "chosen"])
    return df.astype({"doc_id": "int64", "source": object, "n_tokens": "int64", "base": "int64", "p": "float64", "chosen": "Int32"})


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 0, strands: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents in the mix, each used ``copies`` times.

    ``sizes`` has doc_id, source and n_tokens, best already materialised;
    ``targets`` has source_name, target_share and max_repeats and goes to the
    driver, so it is as short as a list of sources. Documents of other sources,
    of none, or without tokens aren't used; a repeated row is a document of its
    own. The same input, seed and number of strands give the same selection,
    since each strand is sorted.
    """
    runtime.require_columns(sizes, "doc_id", "source", "n_tokens")
    spark, width = sizes.sparkSession, runtime.shuffle_width(sizes.sparkSession)
    wanted = [tuple(r) for r in targets.select("source_name", "target_share", "max_repeats").collect()]
    usable = sizes.where("n_tokens > 0 and doc_id is not null").join(targets.select(F.col("source_name").alias("source")).distinct(), "source")
    totals = usable.groupBy("source").agg(F.sum("n_tokens"), F.count("*")).collect()  # a row per target
    strands = strands or max(STRANDS, -(-max((r[2] for r in totals), default=0) // STRAND_ROWS))
    copies = plan([(r[0], r[1]) for r in totals], wanted)
    if not copies:
        return usable.where("false").select("doc_id", "source", "n_tokens", F.lit(0).cast("bigint").alias("copies"))
    each = usable.join(spark.createDataFrame([(s, float(e)) for s, e in copies.items()], "source string, e double"), "source")
    each = each.withColumn("base", F.floor(F.col("e") + _EPS)).select(
        "doc_id", "source", "n_tokens", "base", F.greatest(F.col("e") - F.col("base"), F.lit(0.0)).alias("p"), F.pmod(F.xxhash64("doc_id"), F.lit(strands)).cast("int").alias("strand")
    )
    walked = (
        each.repartition(width, "source", "strand")
        .sortWithinPartitions("source", "strand", F.xxhash64("doc_id", F.lit(seed)), "doc_id", "n_tokens")
        .mapInPandas(lambda b: _flight(b, seed), _SCHEMA)
    )
    walked = runtime.materialise(walked, "flight")
    landed = walked.where("chosen is null").drop("chosen").groupBy("source").applyInPandas(lambda k, g: _landing(k, g, seed), _SCHEMA)
    decided = walked.where("chosen is not null").unionByName(landed)
    return decided.withColumn("copies", F.col("base") + F.col("chosen")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target source with its actual share of the tokens; sources that gave nothing have share 0."""
    got = selection.groupBy(F.col("source").alias("source_name")).agg(
        F.sum("copies").alias("n_uses"), F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"), F.max("copies").alias("most_copies")
    )
    every = Window.partitionBy(F.lit(0))  # as few rows as there are targets
    share = F.coalesce(F.try_divide("n_tokens", F.sum("n_tokens").over(every)), F.lit(0.0))
    return targets.select("source_name", "target_share", "max_repeats").join(got, "source_name", "left").na.fill(0).withColumn("actual_share", share)
