"""Sparse matrices as (row, col, val) tables, and their products with vectors over a semiring.

A product is one equi-join on the column and one aggregate by row. Every row has a result: the rows' identities are added as
leaves before the aggregate, whose partial sums make them cheap, so no second join is needed. Which side is broadcast is left to
Spark's size estimates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirix.functions.semiring import Semiring, get
from semirix.plans.prefix import running



@dataclass(frozen=True)
class Matrix:
    """entries: row, col (bigint, from 0) and val; duplicates are legal and empty rows have no entry."""

    entries: DataFrame
    rows: int
    cols: int

    @classmethod
    def from_entries(cls, entries: DataFrame, rows: int | None = None, cols: int | None = None, drop_zeros: bool = True) -> Matrix:
        """Stored zeros go, unless told otherwise (a zero weight is an edge in the tropical semiring). Missing dimensions are the extent."""
        own = entries.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("val").cast("double").alias("val"))
        own = own.filter("val <> 0") if drop_zeros else own
        if rows is None or cols is None:
            r, c = extent(own).first()
            rows, cols = rows if rows is not None else r, cols if cols is not None else c
        return cls(own, rows, cols)

    @property
    def spark(self) -> SparkSession:
        return self.entries.sparkSession

    def check(self) -> Matrix:
        """Raises where an index is outside the dimensions."""
        bad = self.entries.filter((F.col("row") < 0) | (F.col("row") >= self.rows) | (F.col("col") < 0) | (F.col("col") >= self.cols)).limit(1).collect()
        if bad:
            raise ValueError(f"entry ({bad[0]['row']}, {bad[0]['col']}) is outside {self.rows} x {self.cols}")
        return self

    def transposed(self) -> Matrix:
        return Matrix(self.entries.select(F.col("col").alias("row"), F.col("row").alias("col"), "val"), self.cols, self.rows)

    def multiply(self, x: DataFrame, semiring: str | Semiring = "plustimes") -> DataFrame:
        """x (col, x) -> (row, y) with a row for each of the matrix."""
        s = get(semiring)
        leaves = self.entries.join(x.select(F.col("col").cast("bigint").alias("col"), "x"), "col").select("row", s.leaf(F.col("val"), F.col("x")).alias("w"))
        every = self.spark.range(self.rows).select(F.col("id").alias("row"), F.lit(None).cast(leaves.schema["w"].dataType).alias("w"))
        return leaves.unionAll(every).groupBy("row").agg(s.y(F.col("w")).alias("y"))

    def left_multiply(self, x: DataFrame, semiring: str | Semiring = "plustimes") -> DataFrame:
        """x (row, x) -> (col, y): the product of a row vector with the matrix."""
        return self.transposed().multiply(x.withColumnRenamed("row", "col"), semiring).withColumnRenamed("row", "col")

    def multiply_batch(self, x: DataFrame, size: int, semiring: str | Semiring = "plustimes") -> DataFrame:
        """x (col, b, x) with b in [0, size) -> (row, b, y)."""
        s = get(semiring)
        wide = x.groupBy(F.col("col").cast("bigint").alias("col")).agg(*[F.max(F.when(F.col("b") == b, F.col("x"))).alias(f"x{b}") for b in range(size)])
        y = self.multiply_arrays(wide.select("col", F.array(*[f"x{b}" for b in range(size)]).alias("xs")), size, s)
        return y.select("row", F.posexplode("ys").alias("b", "y"))

    def multiply_arrays(self, x: DataFrame, size: int, semiring: str | Semiring = "plustimes") -> DataFrame:
        """x (col, xs array of ``size``) -> (row, ys array): the structure is joined and shuffled once for all vectors."""
        s = get(semiring)
        joined = self.entries.join(x, "col").select("row", *[s.leaf(F.col("val"), F.col("xs")[b]).alias(f"w{b}") for b in range(size)])
        every = self.spark.range(self.rows).select(F.col("id").alias("row"), *[F.lit(None).cast(joined.schema[f"w{b}"].dataType).alias(f"w{b}") for b in range(size)])
        return joined.unionAll(every).groupBy("row").agg(F.array(*[s.y(F.col(f"w{b}")) for b in range(size)]).alias("ys"))

    def row_pointers(self) -> DataFrame:
        """(row, row_ptr, nnz): the exclusive running count, a row for each of the matrix."""
        counts = self.entries.groupBy("row").agg(F.count(F.lit(1)).alias("nnz"))
        every = self.spark.range(self.rows).select(F.col("id").alias("row")).join(counts, "row", "left").select("row", F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"))
        return running(every, ["row"], "nnz", "row_ptr").select("row", "row_ptr", "nnz")

    def density(self) -> DataFrame:
        """One row: rows, cols, nnz, distinct values, duplicate cells, density in per cent."""
        cells = self.entries.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))
        dup = cells.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"))
        kinds = self.entries.agg(F.count_distinct("val").alias("distinct_values"))
        return dup.join(F.broadcast(kinds)).select(  # two rows of one
            F.lit(self.rows).cast("bigint").alias("rows"), F.lit(self.cols).cast("bigint").alias("cols"), F.col("nnz").cast("bigint").alias("nnz"), "distinct_values", F.col("duplicates").cast("bigint").alias("duplicates"),
            F.expr(f"100.0D * nnz / {max(1, self.rows * self.cols)}").alias("density_pct"),
        )


def extent(entries: DataFrame) -> DataFrame:
    """One row: the greatest indices and 1."""
    return entries.agg(F.coalesce(F.max("row") + 1, F.lit(0)).cast("bigint").alias("rows"), F.coalesce(F.max("col") + 1, F.lit(0)).cast("bigint").alias("cols"))


def replicate(x: DataFrame, size: int) -> DataFrame:
    """x (col, x) -> (col, b, x) with the same vector ``size`` times."""
    return x.select("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("b"), "x")


def random_vector(spark: SparkSession, cols: int, semiring: str | Semiring, seed: int = 123) -> DataFrame:
    """(col, x) from a hash of the column: [0, 1) for plustimes, 0 or 1 for boolean, 0 to 99 and a tenth INF for tropical."""
    s = get(semiring)
    h = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 40))
    if s.name == "boolean":
        x = (h % 2).cast("double")
    elif s.name == "tropical":
        x = F.when(h % 10 == 0, F.lit(float(s.zero))).otherwise(F.floor(h / 10) % 100).cast("double")
    else:
        x = h / float(1 << 40)
    return spark.range(cols).select(F.col("id").alias("col"), x.alias("x"))


def checked_vector(x: DataFrame, cols: int) -> DataFrame:
    """x if it has one value for each column, else an error."""
    n, kinds, low, high = x.agg(F.count(F.lit(1)), F.count_distinct("col"), F.min("col"), F.max("col")).first()
    if n != cols or kinds != cols or (cols and (low != 0 or high != cols - 1)):
        raise ValueError(f"the vector has {n} values for {cols} columns")
    return x
