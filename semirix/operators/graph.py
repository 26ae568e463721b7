"""Queries by repeated products: breadth-first levels, shortest paths, reachability, fixpoints.

The edges are written once, so that a round doesn't compute them anew. Each round is one join of what changed in the round before with the
edges; only what changes is written, beside the earlier rounds, so what a loop writes grows with its result and not with its square, and
a lost executor costs a round at most. What a loop has written goes, but for its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.functions.semiring import INF, Semiring, get
from semirix.plans.matrix import Matrix
from semirix.runtime import Increments, discard, table


def bfs(edges: DataFrame, start: int, rounds: int = 1 << 30) -> DataFrame:
    """edges (src, dst) -> (id, level) of the nodes that can be reached."""
    spark = edges.sparkSession
    steps = table(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")), "edges")
    seen, k = Increments(spark, "id long, level long", "seen"), 0
    frontier = seen.add(spark.createDataFrame([(start, 0)], "id long, level long"))
    while k < rounds:
        k += 1
        reached = frontier.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = seen.add(reached.join(seen.all(), "id", "left_anti").select("id", F.lit(k).cast("long").alias("level")))
        if not frontier.limit(1).count():
            break
    discard(steps)
    return seen.all()


def sssp(edges: DataFrame, start: int, weight: str | None = None, rounds: int = 1 << 30) -> DataFrame:
    """(id, dist): least sums of weights, 1 for each edge without ``weight``. Weights aren't negative."""
    spark = edges.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    steps = table(edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), w.alias("w")), "edges")
    told, k = Increments(spark, "id long, dist double", "dist"), 0
    frontier = told.add(spark.createDataFrame([(start, 0.0)], "id long, dist double"))
    best = lambda: told.all().groupBy("id").agg(F.min("dist").alias("dist"))
    while k < rounds:
        k += 1
        offers = frontier.join(steps, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        frontier = told.add(offers.join(best(), "id", "left").filter("dist is null or offer < dist").select("id", F.col("offer").alias("dist")))
        if not frontier.limit(1).count():
            break
    dist = table(best(), "dist")
    discard(steps, told.all())
    return dist


def fixpoint(matrix: Matrix, x: DataFrame, semiring: str | Semiring = "boolean", rounds: int = 1000) -> DataFrame:
    """(row, y): y = x + M x until nothing changes, on a square matrix, for the idempotent semirings.

    As these add nothing twice, only the rows that changed in a round are multiplied in the next.
    """
    s = get(semiring)
    if s.name not in ("boolean", "tropical") or matrix.rows != matrix.cols:
        raise ValueError("a fixpoint needs an idempotent semiring and a square matrix")
    steps = table(matrix.entries, "entries")
    told = Increments(matrix.spark, f"row long, y {s.type}", "y")
    changed = told.add(x.groupBy(F.col("col").cast("bigint").alias("row")).agg(s.y(s.leaf(F.lit(s.one), F.col("x"))).alias("y")).filter(F.col("y") != s.zero))
    best = lambda: told.all().groupBy("row").agg(s.y(F.col("y")).alias("y"))
    for _ in range(rounds):
        leaves = steps.join(changed.select(F.col("row").alias("col"), F.col("y").alias("x")), "col").select("row", s.leaf(F.col("val"), F.col("x")).alias("w"))
        offers = leaves.groupBy("row").agg(s.y(F.col("w")).alias("offer"))
        better = offers.join(best(), "row", "left").withColumn("old", F.coalesce("y", F.lit(s.zero).cast(s.type))).filter(s.plus(F.col("old"), F.col("offer")) != F.col("old"))
        changed = told.add(better.select("row", F.col("offer").alias("y")))
        if not changed.limit(1).count():
            every = matrix.spark.range(matrix.rows).select(F.col("id").alias("row"), F.lit(None).cast(s.type).alias("y"))
            y = table(told.all().unionAll(every).groupBy("row").agg(s.y(F.col("y")).alias("y")), "y")
            discard(steps, told.all())
            return y
    raise RuntimeError("no fixpoint within the rounds")


def apsp(matrix: Matrix, sources: list[int], rounds: int = 1000) -> DataFrame:
    """(row, b, y): least weights of paths from each row to the b-th source, as one batched tropical loop over the rows that changed."""
    size, spark, s = len(sources), matrix.spark, get("tropical")
    far = F.lit(INF).cast("bigint")
    least = lambda: F.array(*[F.min(F.col("xs")[b]) for b in range(size)]).alias("xs")
    steps = table(matrix.entries, "entries")
    told = Increments(spark, "col long, xs array<bigint>", "y")
    changed = told.add(spark.createDataFrame([(v, [0 if v == u else INF for u in sources]) for v in dict.fromkeys(sources)], "col long, xs array<bigint>"))
    for _ in range(rounds):
        joined = steps.join(changed, "col").select("row", *[s.leaf(F.col("val"), F.col("xs")[b]).alias(f"w{b}") for b in range(size)])
        offers = joined.groupBy(F.col("row").alias("col")).agg(F.array(*[F.min(f"w{b}") for b in range(size)]).alias("more"))
        known = offers.join(told.all().groupBy("col").agg(least()), "col", "left").withColumn("xs", F.coalesce("xs", F.array_repeat(far, size)))
        better = known.filter(F.exists(F.arrays_zip("xs", "more"), lambda p: p["more"] < p["xs"]))
        changed = told.add(better.select("col", F.zip_with("xs", "more", lambda a, b: F.least(a, b)).alias("xs")))
        if not changed.limit(1).count():
            every = spark.range(matrix.rows).select(F.col("id").alias("col"), F.array_repeat(far, size).alias("xs"))
            y = table(told.all().unionAll(every).groupBy("col").agg(least()).select(F.col("col").alias("row"), F.posexplode("xs").alias("b", "y")), "y")
            discard(steps, told.all())
            return y
    raise RuntimeError("paths did not settle within the rounds")
