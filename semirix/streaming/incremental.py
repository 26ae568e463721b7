"""Products kept up to date while entries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.functions.semiring import Semiring, get


def running_product(entries: DataFrame, x: DataFrame, semiring: str | Semiring = "plustimes") -> DataFrame:
    """A stream of entries (row, col, val) and a static vector (col, x) -> the rows' sums, for update or complete mode.

    Addition is commutative, so inserts can come in any order and no watermark is needed; the state is one value for each row
    seen. Rows without an entry yet are not in the result.
    """
    s = get(semiring)
    leaves = entries.join(x, "col").select("row", s.leaf(F.col("val"), F.col("x")).alias("w"))
    return leaves.groupBy("row").agg(s.y(F.col("w")).alias("y"))
