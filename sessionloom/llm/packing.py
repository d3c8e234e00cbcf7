"""Documents packed into containers of a fixed capacity.

Each task keeps a fixed number of open windows, puts an item where it fits
best, and sends the fullest window on when it fits nowhere. What is open at the
end of a task is packed again, in ever fewer tasks, until one is left. Only
documents above the capacity are split.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom import runtime

OPEN_WINDOWS = 64
#: Tasks whose leftovers are packed together in the next round.
FAN_IN = 16
_ITEM = [("doc_id", pa.int64()), ("piece_no", pa.int64()), ("n_pieces", pa.int64()), ("token_start", pa.int64()), ("token_stop", pa.int64())]
_ARROW = pa.schema([*_ITEM, ("container_id", pa.string()), ("is_open", pa.bool_())])
_DDL = "doc_id bigint, piece_no bigint, n_pieces bigint, token_start bigint, token_stop bigint, container_id string, is_open boolean"
_ROWS = 8192


class Windows:
    """At most ``limit`` open windows, ordered by free space."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []
        self.items: dict[int, list] = {}
        self.made = 0

    def put(self, size: int, item) -> tuple[int, list] | None:
        """Place the item best-fit; returns the window (number, items) that had to go."""
        at, gone = bisect_left(self.free, (size, -1)), None
        if at == len(self.free):
            if len(self.free) >= self.limit:
                _, k = self.free.pop(0)
                gone = k, self.items.pop(k)
            space, k = self.capacity, self.made
            self.items[k] = []
            self.made += 1
        else:
            space, k = self.free.pop(at)
        self.items[k].append(item)
        if space == size:  # full
            done = k, self.items.pop(k)
            return done if gone is None else (None, [gone, done])
        insort(self.free, (space - size, k))
        return gone


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, limit: int, stage: int) -> Iterator[pa.RecordBatch]:
    windows = Windows(capacity, limit)
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    out: list[tuple] = []

    def name(k: int) -> str:
        return f"{stage}-{task}-{k}"

    def send() -> pa.RecordBatch:
        nonlocal out
        columns = zip(*out) if out else [()] * len(_ARROW)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
        out = []
        return batch

    for b in batches:
        for item in zip(*(c.to_pylist() for c in b.columns)):
            gone = windows.put(item[4] - item[3], item)
            for k, items in [] if gone is None else gone[1] if gone[0] is None else [gone]:
                out += [(*i, name(k), False) for i in items]
            if len(out) >= _ROWS:
                yield send()
    for k, items in windows.items.items():
        out += [(*i, name(k), True) for i in items]
    yield send()


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """One row per piece of each document of ``sizes`` (doc_id, n_tokens): all but the last of an oversized one are full."""
    n = F.ceil(F.col("n_tokens") / capacity)
    cut = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", n.alias("n_pieces"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece_no"))
    return cut.select(
        "doc_id", "piece_no", "n_pieces", (F.col("piece_no") * capacity).alias("token_start"), F.least((F.col("piece_no") + 1) * capacity, "n_tokens").alias("token_stop")
    )


def pack(sizes: DataFrame, capacity: int, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(container_id, doc_id, piece_no, n_pieces, token_start, token_stop) of each piece of each document.

    ``sizes`` has doc_id and n_tokens, best already materialised. Documents
    without tokens (null or empty texts) need no container and have no row.
    Repeated rows are packed each. No container holds more than ``capacity``.
    The order of the input is fixed by sorting, so a task that is run again
    gives the same containers.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    runtime.require_columns(sizes, "doc_id", "n_tokens")
    spark = sizes.sparkSession
    # 64 full windows of small documents are a fraction of a task, so a task should have many.
    tasks, stage = runtime.shuffle_width(spark), 0
    todo = pieces(sizes, capacity)
    order = [F.xxhash64("doc_id", "piece_no"), "doc_id", "piece_no", "token_stop"]
    names = [n for n, _ in _ITEM]
    closed = None
    while True:
        ranged = todo.select(*names).repartition(tasks, "doc_id", "piece_no").sortWithinPartitions(*order)
        k = stage
        packed = runtime.materialise(ranged.mapInArrow(lambda b: _pack(b, capacity, open_windows, k), _DDL), f"packed-{stage}")
        done = packed if tasks == 1 else packed.where("not is_open")
        closed = done if closed is None else closed.unionByName(done)
        if tasks == 1:
            return closed.select("container_id", *names)
        todo, tasks, stage = packed.where("is_open"), max(1, tasks // FAN_IN), stage + 1


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity that is used."""
    each = packed.groupBy("container_id").agg(F.sum(F.col("token_stop") - F.col("token_start")).alias("used"))
    return each.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("largest"), (F.sum("used") / (F.count("*") * capacity)).alias("used_share"))
