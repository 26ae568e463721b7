"""Intermediate tables in the folder that driver and executors share, and small sampling helpers."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semirix.runtime import discard, table, work_dir

__all__ = ["bucket", "discard", "labelled_texts", "majority", "sampled", "table", "work_dir"]


def bucket(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: fixes folds."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, stratum: Column, key: str, bound: int, seed: int = 7, count_of: DataFrame | None = None) -> DataFrame:
    """``bound`` rows of each stratum at most, those with the least hash of ``key`` (in ``_draw``): the same rows at any partitioning.

    Strata are few (labels, languages): their counts come to the driver. ``count_of`` may hold more rows than ``df``, if it
    is cheaper to count; the sample is then smaller in proportion.
    """
    df = df.withColumn("_stratum", stratum.cast("string")).filter(F.col("_stratum").isNotNull())
    counted = df if count_of is None else count_of.select(stratum.cast("string").alias("_stratum")).filter(F.col("_stratum").isNotNull())
    counts = {r["_stratum"]: r["count"] for r in counted.groupBy("_stratum").count().collect()}
    df = df.withColumn("_draw", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    if not counts:
        return df
    # about an eighth more than wanted by their hash, of which the first are kept: a window over few rows
    limit = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, float(min(1.0, (bound + 4 * bound**0.5 + bound / 8) / n)))])
    few = df.filter(F.pmod(F.col("_draw"), F.lit(1 << 30)) / float(1 << 30) < limit[F.col("_stratum")])
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy(F.pmod(F.col("_draw"), F.lit(1 << 30)), "_draw"))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= bound).drop("_rank")


def majority(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(_id, _y) with 0 or 1: what most labels of an id say. An id with as many of either has none; other labels and null ids don't count."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull())
    return rows.groupBy("_id").agg(F.avg("_y").alias("_y")).filter("_y <> 0.5").select("_id", (F.col("_y") > 0.5).cast("int").alias("_y"))


def labelled_texts(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str, class_chars: int, least: int) -> DataFrame:
    """(_id, _y, _text) of the sampled labels ``parts`` (_id, _y, _draw), one row for each id that has a text, written.

    Whole texts, whose characters sum to ``class_chars`` at most in each class in the order of ``_draw``; ``least`` rows of each stay anyway.
    Texts aren't shuffled: a task hands on the first row of each id that it meets, so an id of any number of rows costs one for each task, and which
    rows stay is found out on the ids and lengths alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        seen, place = set(), TaskContext.get().partitionId() << 33
        for b in batches:
            fresh = [i for i, x in enumerate(b.column("_id").to_pylist()) if not (x in seen or seen.add(x))]
            if fresh:
                own = b.take(pa.array(fresh))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(range(place, place + len(fresh)), pa.int64())], ["_id", "_y", "_draw", "_text", "_place"])
                place += len(fresh)

    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    found = text.join(F.broadcast(parts), "_id").select("_id", "_y", "_draw", "_text")
    found = table(found.mapInArrow(run, f"_id {kind}, _y int, _draw long, _text string, _place long"), "labelled")
    light = found.select("_id", "_y", "_draw", "_place", F.length("_text").alias("_size"))
    light = light.withColumn("_copy", F.row_number().over(Window.partitionBy("_id").orderBy("_place"))).filter("_copy = 1")
    w = Window.partitionBy("_y").orderBy("_draw")
    light = light.withColumns({"_sum": F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_rank": F.row_number().over(w)})
    places = light.filter((F.col("_sum") <= class_chars) | (F.col("_rank") <= least)).select("_place")  # rows of ``parts`` at most
    out = found.join(F.broadcast(places), "_place", "left_semi").select("_id", "_y", "_text")
    out._semirix_path = found._semirix_path
    return out
