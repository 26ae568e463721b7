"""Relation matrices out of a triple store (s, p, o)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.plans.prefix import ranked_within


def analyze(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """Each predicate's name, triples, distinct subjects and objects, and the bytes and MB of its dense matrix."""
    counts = triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))
    size = (F.col("subjects") * F.col("objects") * 4).alias("dense_bytes")
    named = counts.join(predicates, "p", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("Unknown_"), F.col("p").cast("string"))))
    return named.select("p", "name", "n", "subjects", "objects", size).withColumn("dense_mb", F.round(F.col("dense_bytes") / 1048576.0, 2))


def _dense(values: DataFrame, name: str) -> DataFrame:
    """(p, value) -> the value's rank among its predicate's distinct values, from 0."""
    return ranked_within(values.distinct().select("p", "value"), ["p"], ["value"], name).select("p", "value", F.col(name).cast("bigint").alias(name))


def sparse(triples: DataFrame, predicates: list[int]) -> DataFrame:
    """(p, row, col) of several predicates in one scan, ids dense by predicate; duplicates stay."""
    own = triples.filter(F.col("p").isin(predicates))
    rows = _dense(own.select("p", F.col("s").alias("value")), "row").withColumnRenamed("value", "s")
    cols = _dense(own.select("p", F.col("o").alias("value")), "col").withColumnRenamed("value", "o")
    return own.join(rows, ["p", "s"]).join(cols, ["p", "o"]).select("p", "row", "col")


def build(triples: DataFrame, predicate: int) -> DataFrame:
    """(row, col, val = 1) of one predicate; duplicates fold into one cell."""
    return sparse(triples, [predicate]).select("row", "col").distinct().withColumn("val", F.lit(1.0))


def square(triples: DataFrame, predicate: int) -> tuple[DataFrame, DataFrame]:
    """nodes (id, orig) and edges (src, dst) with subjects and objects in one id space."""
    own = triples.filter(F.col("p") == predicate)
    both = own.select("p", F.col("s").alias("value")).union(own.select("p", F.col("o").alias("value")))
    nodes = _dense(both, "id").select("id", F.col("value").alias("orig"))
    src, dst = nodes.select(F.col("id").alias("src"), F.col("orig").alias("s")), nodes.select(F.col("id").alias("dst"), F.col("orig").alias("o"))
    return nodes, own.join(src, "s").join(dst, "o").select("src", "dst")


def bipartite(entries: DataFrame, rows: int) -> DataFrame:
    """(src, dst): columns become nodes behind the rows."""
    return entries.select(F.col("row").alias("src"), (F.col("col") + rows).alias("dst"))
