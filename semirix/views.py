"""Matrices and vectors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirix.plans.grammar import GrammarMatrix
from semirix.plans.matrix import Matrix
from semirix.plans.prefix import ranked


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(df: DataFrame, key: str) -> int:
    """The greatest key and 1: from the file's statistics, a scan of one column."""
    return (df.agg(F.max(key)).first()[0] or -1) + 1


def quantities(spark: SparkSession, sf_dir: str) -> Matrix:
    """Orders x parts, l_quantity; duplicates stay."""
    rows, cols = _size(read(spark, sf_dir, "orders"), "o_orderkey"), _size(read(spark, sf_dir, "part"), "p_partkey")
    return Matrix.from_entries(read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as row", "l_partkey as col", "l_quantity as val"), rows, cols)


def discounts(spark: SparkSession, sf_dir: str) -> Matrix:
    """Orders x parts, whole per cents of discount; zeros go."""
    rows, cols = _size(read(spark, sf_dir, "orders"), "o_orderkey"), _size(read(spark, sf_dir, "part"), "p_partkey")
    return Matrix.from_entries(read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as row", "l_partkey as col", "round(100 * l_discount) as val"), rows, cols)


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def one_hot(spark: SparkSession, sf_dir: str) -> Matrix:
    """Customers x (25 nations, 5 segments, 5 regions), 1: few different rows."""
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    segment = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row"), F.explode(F.array(F.col("n_nationkey").cast("bigint"), 25 + segment, (30 + F.col("n_regionkey")).cast("bigint"))).alias("col"))
    return Matrix.from_entries(own.withColumn("val", F.lit(1.0)), _size(c, "c_custkey"), 35)


def wide_one_hot(spark: SparkSession, sf_dir: str) -> Matrix:
    """Line items, numbered in a total order, x one-hot of return flag (0-2), status (3-4), discount (5-15), tax (16-24); val is the column's group."""
    l = read(spark, sf_dir, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_shipdate"]
    own = ranked(l.select(*cols), cols, "row")
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1
    hot = F.array(place("l_returnflag", "ANR"), 3 + place("l_linestatus", "FO"), 5 + F.round(100 * F.col("l_discount")).cast("bigint"), 16 + F.round(100 * F.col("l_tax")).cast("bigint"))
    return Matrix.from_entries(own.select("row", F.posexplode(hot).alias("g", "col")).select("row", "col", (F.col("g") + 1).alias("val")), l.count(), 25)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(col, x): p_size of each part."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("col"), F.col("p_size").cast("double").alias("x"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -1-> order -2-> part -3-> supplier -4-> nation -5-> region."""
    l = read(spark, sf_dir, "lineitem")
    parts = [
        read(spark, sf_dir, "orders").selectExpr("o_custkey as s", "1L as p", "o_orderkey as o"), l.selectExpr("l_orderkey as s", "2L as p", "l_partkey as o"), l.selectExpr("l_partkey as s", "3L as p", "l_suppkey as o"),
        read(spark, sf_dir, "supplier").selectExpr("s_suppkey as s", "4L as p", "cast(s_nationkey as bigint) as o"), read(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as s", "5L as p", "cast(n_regionkey as bigint) as o"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


PREDICATES = [(1, "places"), (2, "contains"), (3, "supplied_by"), (4, "based_in")]


#: Codes of the grammar of parts: two values by 25 columns.
PART_VALUES, PART_COLS = (1.0, 3.0), 25
PART_ALPHA = len(PART_VALUES) * PART_COLS + 1


def part_grammar(spark: SparkSession, sf_dir: str) -> GrammarMatrix:
    """A rule for each part k, whose children are the rules of parts k div 2 and k div 3 or codes, a tenth of them runs; the rows are orders,
    whose symbols are the rules of their parts, and for every fifth order a code. Deep and shared, and the same in any run."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    inner = lambda d: F.expr(f"{PART_ALPHA}L + p_partkey div {d}")
    left = F.when((k % 4 == 0) | (k < 2), size % (PART_ALPHA - 1) + 1).otherwise(inner(2))
    run = (k % 11 == 5) & (k >= 2)
    right = F.when((k % 3 == 0) & (k >= 3), inner(3)).otherwise((k * 7) % (PART_ALPHA - 1) + 1)
    rules = read(spark, sf_dir, "part").select(
        F.lit(0).cast("long").alias("block"), (k + PART_ALPHA).alias("sym"), F.when(run, "RUNLEN").otherwise("BINARY").alias("kind"), left.cast("long").alias("left"), F.when(~run, right).cast("long").alias("right"),
        F.when(run, 2 + size % 2).otherwise(1).cast("int").alias("rep"),
    )
    l, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    top = l.select(F.lit(0).cast("long").alias("block"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_partkey") + PART_ALPHA).alias("sym"))
    top = top.unionAll(o.filter("o_orderkey % 5 = 0").select(F.lit(0).cast("long").alias("block"), F.col("o_orderkey").alias("row"), F.lit(1000).cast("long").alias("pos"), (F.col("o_custkey") % (PART_ALPHA - 1) + 1).alias("sym")))
    values = spark.createDataFrame(list(enumerate(PART_VALUES)), "val_idx long, val double")
    return GrammarMatrix(rules, top, values, PART_ALPHA, _size(o, "o_orderkey"), PART_COLS)


def supplier_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, nat, n, q, c: each supplier's nation, line items, quantity and orders; what the logs of ``supplier_log`` tell."""
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("q"), F.count_distinct("l_orderkey").alias("c"))
    every = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("nat"))
    return every.join(own, "k", "left").select("k", "nat", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in "nqc"])


def supplier_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, n, line): a log for each nation, with a block of three parts for each of its suppliers."""
    f = F.format_string
    lost = F.col("k") % 7 == 0
    lines = F.array(
        f("## s%d (%d x %d)", "k", "c", "n"), f("Max depth (L): %d, Max width (w*): %d, Total layered rules: %d (raw NTs: %d, +pt: %d), emissions: %d+%d term", F.col("nat") + 1, "n", F.col("q") + F.col("c"), "c", "q", "n", "c"),
        f("GPU kernel: %d ms total over 100 vectors = %.2f ms/vector.", "n", F.col("n") / 100), f("MEM analytic bytes: %d", F.col("q") * 1000), f("ENERGY mJ/vector: %.2f", F.col("c") / 4), f("B=16: %d ms/batch, %.3f ms/vector", "n", F.col("n") / 200),
        f("B=32: %d ms/batch, %.2f ms/vector", "n", F.col("n") / 100), F.when(F.col("k") % 5 == 0, "FAILURE: differs").otherwise("SUCCESS: results match"), f("Library x %d thread(s): %d ms", F.col("nat") + 1, "n"), F.lit("--- LIBRARY ---"),
        F.when(lost, "out of memory").otherwise(f("Average time: %.2f ms/vector", F.col("n") / 50)), F.when(lost, "").otherwise(f("MEM analytic bytes: %d", F.col("n") * 4000)), F.when(lost, "").otherwise(f("ENERGY mJ/vector: %.1f", F.col("c") / 2)),
        F.when(F.col("k") % 3 == 0, f("NNZ: %d", F.col("n") * 1000)).otherwise(""), F.lit("--- GRAMMAR ---"), f(" >> repair time: %.2f", F.col("n") / 4), f(" >> total time: %.2f", F.col("n") / 2), f(" >> matrix dense size: %d bytes", F.col("q") * 64),
        f(" >> RE32  size: %d bytes", F.col("n") * 8), f(" >> REANS size: %d bytes", F.col("c") * 500),
    )
    rows = supplier_facts(spark, sf_dir).select(f("nation%d", "nat").alias("file"), "k", F.posexplode(lines).alias("at", "line"))
    head = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("n"), F.lit("# a log").alias("line"))
    return head.unionAll(rows.select("file", (F.col("k") * 100 + F.col("at")).alias("n"), "line"))
