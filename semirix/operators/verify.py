"""Comparison of result vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, tolerance: float = 1e-4, first_rows: int | None = None, on: str = "row") -> DataFrame:
    """One row: rows, rows of one side only, greatest |a - b|, greatest |a - b| / (1 + |b|), greatest |a|, mismatches, passed.

    A missing row fails whatever the tolerance. ``first_rows`` compares only rows below it.
    """
    both = a.select(on, F.col("y").cast("double").alias("a"), F.lit(1).alias("in_a")).join(b.select(on, F.col("y").cast("double").alias("b"), F.lit(1).alias("in_b")), on, "full_outer")
    if first_rows is not None:
        both = both.filter(F.col(on) < first_rows)
    diff = F.abs(F.col("a") - F.col("b"))
    out = both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("unmatched"), F.coalesce(F.max(diff), F.lit(0.0)).alias("max_abs"),
        F.coalesce(F.max(diff / (1 + F.abs("b"))), F.lit(0.0)).alias("max_rel"), F.coalesce(F.max(F.abs("a")), F.lit(0.0)).alias("max_a"), F.count_if(F.col("a") != F.col("b")).alias("mismatches"),
    )
    return out.withColumn("passed", (F.col("unmatched") == 0) & (F.col("max_rel") < tolerance))


def clipped(y: DataFrame, top: float = 1e9) -> DataFrame:
    """y with infinities and what is above ``top`` as ``top``, for comparison with other libraries."""
    return y.withColumn("y", F.least(F.col("y").cast("double"), F.lit(top)))


def as_bits(y: DataFrame) -> DataFrame:
    """y as 1 where it isn't 0: path counts against Boolean results."""
    return y.withColumn("y", (F.col("y") != 0).cast("int"))


def cross_check(products: dict[str, DataFrame], tolerance: float = 1e-4) -> DataFrame:
    """One row for each other name: its y against that of the first, as ``compare`` does. For all ways to one product."""
    (first, base), *others = products.items()
    out = None
    for name, y in others:
        row = compare(y, base, tolerance).select(F.lit(first).alias("base"), F.lit(name).alias("name"), "n", "unmatched", "max_abs", "mismatches", "passed")
        out = row if out is None else out.unionByName(row)
    return out


def columns_equal(batch: DataFrame, single: DataFrame) -> DataFrame:
    """One row: batch cells, and those that differ from the single result of their row."""
    both = batch.join(single.withColumnRenamed("y", "one"), "row", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("y").eqNullSafe(F.col("one"))).alias("different"))
