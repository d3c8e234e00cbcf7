"""Values carried along an order within keys, where one key may hold a large part of all rows.

Rows of a key are cut into blocks that are contiguous in the order. What a
block passes on is one row, so the blocks are ordered in as many tasks as there
are blocks and the carry is a window over a table of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import runtime

#: Rows of a block where blocks are cut by a running number.
BLOCK_ROWS = 8192


def cut_by_range(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """``rows`` with the block number ``out``, from a range partitioning on key and order."""
    ranged = rows.repartitionByRange(runtime.shuffle_width(rows.sparkSession), key, *order)
    return runtime.materialise(ranged.withColumn(out, F.spark_partition_id()), "ranges")


def with_previous(rows: DataFrame, key: str, order: list[str], value: str, out: str, block: Column) -> DataFrame:
    """The last non-null ``value`` before each row, within ``key`` by ``order``; null where there is none.

    ``block`` must not fall along the order. ``rows`` is read twice: materialise
    it if it is costly.
    """
    over = rows.withColumn("__block", block)
    within = Window.partitionBy(key, "__block").orderBy(*order)
    rank = F.struct(*order)
    ends = over.groupBy(key, "__block").agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), rank)).alias("__end"))
    carried = (
        ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
        .where("__carry is not null")
        .select(key, "__block", "__carry")
    )
    inner = over.withColumn("__prev", F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    return inner.join(carried, [key, "__block"], "left").withColumn(out, F.coalesce("__prev", "__carry")).drop("__block", "__prev", "__carry")


def with_position(rows: DataFrame, key: str, order: list[str], out: str, block: Column) -> DataFrame:
    """The position of each row from 0, within ``key`` by ``order``; ``block`` as in ``with_previous``."""
    over = rows.withColumn("__block", block)
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = over.groupBy(key, "__block").count().withColumn("__base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inner = over.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__block").orderBy(*order)))
    return inner.join(counts, [key, "__block"], "left").withColumn(out, F.col("__base") + F.col("__n") - 1).drop("__block", "__base", "__n")
