"""Text inputs: edge lists, triples, dictionaries, CSV matrices, variants, logs; and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(row, col) of lines ``row col``."""
    return edges_of(spark.read.text(path))


def edges_of(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(parts) >= 2).select(parts[0].cast("bigint").alias("row"), parts[1].cast("bigint").alias("col"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of lines with exactly three fields; others are dropped."""
    return triples_of(spark.read.text(path))


def triples_of(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(F.size(parts) == 3).select(*[parts[i].cast("bigint").alias(n) for i, n in enumerate("spo")])


def read_predicates(spark: SparkSession, path: str) -> DataFrame:
    return predicates_of(spark.read.text(path))


def predicates_of(lines: DataFrame) -> DataFrame:
    """(p, name) of lines ``id name...``, split once."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.filter(F.size(parts) == 2).select(parts[0].cast("bigint").alias("p"), parts[1].alias("name"))


def csv_cells(lines: DataFrame) -> DataFrame:
    """(row, value) lines of comma-separated numbers -> (row, col, val) without zeros."""
    cells = lines.select("row", F.posexplode(F.split("value", ",")).alias("col", "text"))
    return cells.select("row", F.col("col").cast("bigint").alias("col"), F.trim("text").cast("double").alias("val")).filter("val <> 0")


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ref, alt, gts) of a VCF file, idx in the file's order."""
    return variants_of(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))


def variants_of(lines: DataFrame) -> DataFrame:
    """(n, value) lines -> variants: '#' lines go, tabs part the fields, genotypes are from the tenth on."""
    parts = F.split(F.rtrim("value"), "\t")
    body = lines.filter(~F.col("value").startswith("#") & (F.size(parts) > 9))
    return body.select(F.col("n").alias("idx"), parts[3].alias("ref"), parts[4].alias("alt"), F.slice(parts, 10, 1 << 30).alias("gts"))


def log_blocks(lines: DataFrame) -> DataFrame:
    """(file, n, line) -> the lines below a ``## key`` line, with its key; what is above the first is dropped. Logs are small; a file is one window."""
    key = F.regexp_extract("line", r"^##\s+(\S+)", 1)
    marked = lines.withColumn("mark", F.when(key != "", key))
    w = Window.partitionBy("file").orderBy("n")
    filled = marked.withColumn("key", F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.filter(F.col("mark").isNull() & F.col("key").isNotNull()).select("file", "key", "n", "line")


def parts_of(blocks: DataFrame, marker: str) -> DataFrame:
    """The lines of each block with ``part``: how many lines that match ``marker`` are at or above it."""
    w = Window.partitionBy("file", "key").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("part", F.sum(F.col("line").rlike(marker).cast("int")).over(w))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV of results; N/A and blanks are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "N/A").csv(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Lines ``row col`` in order; the range sort's files follow each other."""
    edges.select("row", "col").orderBy("row", "col").write.option("sep", " ").csv(path)


def append_result(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("header", True).csv(path)


def write_lines(lines: DataFrame, order: str, path: str) -> None:
    """A report's lines, a handful, as one text file."""
    lines.orderBy(order).select("value").coalesce(1).write.mode("overwrite").text(path)
