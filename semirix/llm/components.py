"""Connected components by alternating stars, for link tables of any size.

Each round, every node links its larger neighbours to the least node of its neighbourhood (large star), then its smaller
neighbours and itself to the least of them (small star). Neighbourhoods are only summed (min), never collected, so a hub is
no hot task: the minimum is partly taken before the shuffle, and the join back is an equi-join that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import discard, table

#: Link tables up to this many rows need no shuffle: one task holds them.
SMALL = 100_000


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a, b) with a <> b, both long -> (id, root): a row for each linked id, root the least id reachable."""
    links = table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(rounds):
        size, before = links.count(), links
        links = links.coalesce(1) if size <= SMALL else links
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        both = both.coalesce(1) if size <= SMALL else both
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        kept = large = table(large, "large")
        large = large.coalesce(1) if size <= SMALL else large
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        small = small.coalesce(1) if size <= SMALL else small
        written = new = table(small.distinct(), "small")
        discard(before, kept)
        # settled: every larger end has one link, and no smaller end is a larger one
        new = new.coalesce(1) if size <= SMALL else new
        ends = new.select("a", F.lit(0).alias("low")).unionAll(new.select(F.col("b").alias("a"), F.lit(1).alias("low")).distinct())
        ends = ends.coalesce(1) if size <= SMALL else ends
        if not ends.groupBy("a").agg(F.count_if(F.col("low") == 0).alias("up"), F.max("low").alias("low")).filter("up > 1 or (up > 0 and low > 0)").limit(1).count():
            return new.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(new.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        links = written
    raise RuntimeError("the links did not settle")
