"""The row stream of a matrix as codes: 1 + value index * cols + column, with 0 between rows in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semirix.plans.matrix import Matrix
from semirix.plans.prefix import ranked


def value_dictionary(entries: DataFrame) -> DataFrame:
    """(val_idx, val): the distinct values in ascending order, numbered from 0."""
    return ranked(entries.select("val").distinct(), ["val"], "val_idx").select(F.col("val_idx").cast("bigint").alias("val_idx"), "val")


def code(val_idx: str | Column, col: str | Column, cols: int) -> Column:
    val_idx, col = (F.col(c) if isinstance(c, str) else c for c in (val_idx, col))
    return (val_idx * cols + col + 1).cast("bigint")


def parts(sym: str, cols: int) -> tuple[Column, Column]:
    """The value index and the column of a code."""
    return F.expr(f"({sym} - 1) div {cols}"), F.expr(f"({sym} - 1) % {cols}")


def encode(matrix: Matrix, dictionary: DataFrame | None = None) -> DataFrame:
    """(row, pos, code): the cells of each row in order of column, then value."""
    dictionary = value_dictionary(matrix.entries) if dictionary is None else dictionary
    coded = matrix.entries.join(dictionary, "val").select("row", "col", code("val_idx", "col", matrix.cols).alias("code"))
    at = F.row_number().over(Window.partitionBy("row").orderBy("col", "code")) - 1
    return coded.select("row", at.cast("bigint").alias("pos"), "code")


def decode(stream: DataFrame, dictionary: DataFrame, cols: int, symbol: str = "code") -> DataFrame:
    """(row, col, val) of coded cells. Values not in the dictionary are an error of the data and are dropped by the join."""
    idx, col = parts(symbol, cols)
    return stream.select("row", col.cast("bigint").alias("col"), idx.alias("val_idx")).join(dictionary, "val_idx").select("row", "col", "val")


def compacted(codes: DataFrame, symbol: str = "code") -> DataFrame:
    """(code, id): the distinct codes in ascending order, numbered from 1; 0 stays the delimiter."""
    return ranked(codes.select(F.col(symbol).alias("code")).filter("code <> 0").distinct(), ["code"], "id", 1)
