"""What Spark makes of the plans: one shuffle, pruned and filtered scans, no Python in products of entries."""

import re

import pytest

from semirix import runtime, views
from semirix.plans.matrix import Matrix


def explained(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(0, 1, 5.0, "x")], "l_orderkey long, l_partkey long, l_quantity double, l_comment string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "n", 3)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("semiring", ["plustimes", "boolean", "tropical"])
def test_product_plan(spark, tables, semiring):
    plan = explained(views.quantities(spark, tables).multiply(views.sizes(spark, tables), semiring))
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan and "struct<p_partkey:bigint,p_size:int>" in plan
    assert "Not(EqualTo(l_quantity,0.0))" in plan
    assert len(re.findall(r"hashpartitioning", plan)) == 1 and plan.count("partial_") and not re.search("Python|Arrow|Pandas|Cartesian|SinglePartition", plan)


def test_batch_plan_shuffles_once(spark, tables):
    x = views.sizes(spark, tables).selectExpr("col", "array(x, x, x) as xs")
    plan = explained(views.quantities(spark, tables).multiply_arrays(x, 3))
    assert len(re.findall(r"hashpartitioning", plan)) == 1


def test_joins_shuffle_beyond_the_threshold(spark, tables):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        m = views.quantities(spark, tables)
        assert "BroadcastHashJoin" not in explained(m.multiply(views.sizes(spark, tables)))
        assert [tuple(r) for r in m.multiply(views.sizes(spark, tables)).collect()] == [(0, 15.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_batches_are_bounded(spark):
    assert runtime._bytes("64m") == runtime._bytes("67108864b") == 64 << 20 and runtime._bytes("-1") > 1 << 60
    runtime.ship(spark)
    assert runtime._bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= runtime.BATCH_BYTES


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    df = runtime.table(spark.range(3), "t")
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in df.inputFiles()) and df.count() == 3


def test_transposed_twice(spark, tables):
    m = views.quantities(spark, tables)
    assert isinstance(m.transposed().transposed(), Matrix) and m.transposed().transposed().entries.collect() == m.entries.collect()


def test_cleared_tables_are_gone(spark):
    from pathlib import Path

    at = Path(runtime.table(spark.range(3), "t")._semirix_path.removeprefix("file:"))
    assert at.is_dir()
    runtime.clear(spark)
    assert not at.exists() and runtime.table(spark.range(3), "t").count() == 3


def test_no_rank_is_in_one_partition(spark):
    """Dense ids of triples, slots of a grammar: range sorts, no window by predicate or level; single rows only are summed in one task."""
    from semirix.operators import triples
    from semirix.plans.grammar import GrammarMatrix

    t = spark.createDataFrame([(1, 2, 3)], "s long, p long, o long")
    g = GrammarMatrix.of(spark, [(3, "BINARY", 1, 2, 1)], [(0, 0, 3)], [1.0], 3, 1, 2)
    for df in (triples.build(t, 2), triples.sparse(t, [2]), triples.square(t, 2)[1], g.slots()):
        plan = explained(df)
        windows = re.findall(r"windowspecdefinition\(([^)]*)", plan)
        assert windows and all(w.startswith("_part") for w in windows), windows


def test_discarded_tables_are_gone(spark):
    from pathlib import Path

    df, other = runtime.table(spark.range(3), "t"), spark.range(2)
    at = Path(df._semirix_path.removeprefix("file:"))
    assert at.is_dir()
    runtime.discard(df, None, other, df)
    assert not at.exists() and other.count() == 2
