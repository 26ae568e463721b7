"""Dense ranks and running sums over a whole table without a one-partition window.

The rows are range-sorted once and written; partition and place come from one id made while writing. The offsets of the partitions,
a row for each, are the only thing summed in one task, and are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semirix.runtime import table


def _sorted(df: DataFrame, order: list[str | Column]) -> DataFrame:
    kept = table(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    return kept.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))


def ranked(df: DataFrame, order: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """``name``: the number of each row in ``order``, from ``first`` on. Ties are numbered in any order."""
    rows = _sorted(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place") + first).drop("_part", "_place", "_before")


def ranked_within(df: DataFrame, group: list[str], order: list[str | Column], name: str, first: int = 0) -> DataFrame:
    """``name``: the number of each row in its group, by ``order``. One range sort over all rows, so a group of any size is many tasks' work;
    the groups' first numbers, a row for each, are joined back."""
    rows = ranked(df, [*group, *order], name)
    start = rows.groupBy(*group).agg(F.min(name).alias("_start"))
    return rows.join(start, group).withColumn(name, F.col(name) - F.col("_start") + first).drop("_start")


def running(df: DataFrame, order: list[str | Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before this one (exclusive)."""
    rows = _sorted(df, order)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    w = Window.partitionBy("_part").orderBy("_place")
    own = F.sum(value).over(w) - F.col(value)
    return rows.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + own).cast("bigint")).drop("_part", "_place", "_before")
