"""Timing of products, as rows of a metrics table."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "label string, vectors long, total_ms double, ms_per_batch double, ms_per_vector double, peak_mb double"
#: Rows beyond which a product isn't checked against the entries unless forced, and GB of a batch beyond which it isn't run.
CHECKED_ROWS, BATCH_GB = 30_000_000, 90.0


def peak_mb(spark: SparkSession) -> float | None:
    """The greatest resident memory of the driver's JVM so far, which on a local master is all; None where the system doesn't tell."""
    try:
        pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
        found = re.search(r"VmHWM:\s+(\d+) kB", Path(f"/proc/{pid}/status").read_text())
    except OSError:
        return None
    return int(found[1]) / 1024 if found else None


def batch_gb(codes: int, width: int, rows: int, cols: int, batch: int) -> float:
    """GB that a batch needs in the layered form: 4 bytes for each code, both frontiers, column and row of each vector."""
    return 4 * batch * (codes + 2 * width + cols + rows) / 1e9


def guarded(rows: int, gb: float, force: bool = False) -> dict[str, bool]:
    """Whether to check against the entries, and whether to run the batch."""
    return {"check": force or rows <= CHECKED_ROWS, "batch": gb <= BATCH_GB}


def timed(spark: SparkSession, label: str, make: Callable[[], DataFrame], times: int = 1, batch: int = 1) -> DataFrame:
    """One row for ``times`` runs of ``make``, each of ``batch`` vectors, after a run that isn't counted; results go to the noop sink."""
    run = lambda: make().write.format("noop").mode("overwrite").save()
    run()
    began = time.perf_counter()
    for _ in range(times):
        run()
    total = 1000 * (time.perf_counter() - began)
    return spark.createDataFrame([(label, times * batch, total, total / times, total / times / batch, peak_mb(spark))], METRICS)


def lines(metrics: DataFrame) -> DataFrame:
    """(key, n, line): metrics as the lines of a log, a block for each label, which the reports read."""
    shown = F.array(
        F.concat(F.lit("## "), F.col("label")), F.format_string("GPU kernel: %.3f ms total over %d vectors = %.6f ms/vector.", "total_ms", "vectors", "ms_per_vector"), F.when(F.col("peak_mb").isNotNull(), F.format_string("MEM peak bytes: %d", (F.col("peak_mb") * 1048576).cast("long"))),
    )
    return metrics.select(F.col("label").alias("key"), F.posexplode(F.array_compact(shown)).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


def by_blocks(spark: SparkSession, make: Callable[[int], DataFrame], blocks: int, label: str) -> DataFrame:
    """Each block's product timed on its own: a row for each."""
    out = None
    for i in range(blocks):
        row = timed(spark, f"{label}/{i}", lambda i=i: make(i))
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], METRICS)


def with_sizes(metrics: DataFrame, stats: DataFrame) -> DataFrame:
    """Metrics beside a grammar's figures (one row)."""
    return metrics.join(F.broadcast(stats))


def best_batch(metrics: DataFrame) -> DataFrame:
    """Of all rows whose label is ``name/B``: each name's least time of a vector, and its B."""
    parts = F.split("label", "/")
    rows = metrics.select(parts[0].alias("name"), parts[1].cast("int").alias("b"), "ms_per_vector")
    return rows.groupBy("name").agg(F.min(F.struct("ms_per_vector", "b")).alias("m")).select("name", F.col("m.b").alias("b"), F.col("m.ms_per_vector").alias("ms_per_vector"))
