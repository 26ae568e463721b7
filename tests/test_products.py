"""Products over the three semirings, against plain Python."""

import pytest
from pyspark.sql import functions as F

from semirix.functions import semiring
from semirix.functions.semiring import INF
from semirix.operators import verify
from semirix.plans.grammar import GrammarMatrix
from semirix.plans.matrix import Matrix, checked_vector, random_vector, replicate

# the 8 x 7 worked example: rows of three kinds
A, B, C = [2.3, 0, 1.2, 1.2, 1.2, 2.3, 1.2], [1.2, 4.5, 3.4, 1.2, 1.2, 2.3, 4.5], [0, 4.5, 3.4, 2.3, 2.3, 0, 4.5]
WORKED = [A, B, B, A, B, C, C, A]
X = [2, 1, 1, 2, 1, 1, 1]


def matrix(spark, dense, drop_zeros=True):
    cells = [(i, j, float(v)) for i, row in enumerate(dense) for j, v in enumerate(row)]
    return Matrix.from_entries(spark.createDataFrame(cells, "row long, col long, val double"), len(dense), len(dense[0]), drop_zeros)


def vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "col long, x double")


def rows(df):
    return {r["row"]: r["y"] for r in df.collect()}


def plain(dense, x, name):
    out = {}
    for i, row in enumerate(dense):
        cells = [(v, x[j]) for j, v in enumerate(row) if v != 0]
        if name == "plustimes":
            out[i] = sum(v * w for v, w in cells)
        elif name == "boolean":
            out[i] = int(any(w != 0 for _, w in cells))
        else:
            out[i] = min([INF, *(INF if int(v) >= INF or int(w) >= INF else int(v) + int(w) for v, w in cells)])
    return out


def pattern(n=50):
    """50 x 50 of five repeated row patterns over {0, 1, 2}, and an empty row."""
    kinds = [[(7 * k + 3 * j + j * j * (k + 1)) % 3 for j in range(n)] for k in range(5)]
    dense = [kinds[(i * i + 3 * i) % 5] for i in range(n)]
    dense[17] = [0] * n
    return dense


def test_worked_example(spark):
    expected = [12.9, 20.7, 20.7, 12.9, 20.7, 19.3, 19.3, 12.9]
    m = matrix(spark, WORKED)
    got = rows(m.multiply(vector(spark, X)))
    assert [round(got[i], 6) for i in range(8)] == expected
    assert m.density().first()["nnz"] == 49 and m.density().first()["distinct_values"] == 4
    g = GrammarMatrix.compress(m, 8)
    got = rows(g.multiply(vector(spark, X)))
    assert [round(got[i], 6) for i in range(8)] == expected


@pytest.mark.parametrize("name", ["plustimes", "boolean", "tropical"])
def test_plans_agree(spark, name):
    dense = pattern()
    m = matrix(spark, dense)
    x = [float(r["x"]) for r in random_vector(spark, 50, name, 456).orderBy("col").collect()]
    expected = plain(dense, x, name)
    g = GrammarMatrix.compress(m, 20)
    for y in (m.multiply(vector(spark, x), name), g.multiply(vector(spark, x), name), g.multiply(vector(spark, x), name, plan="levels"), g.multiply(vector(spark, x), name, plan="entries")):
        got = rows(y)
        assert got.keys() == expected.keys()
        assert all(abs(got[i] - expected[i]) < 1e-9 * max(1, abs(expected[i])) for i in expected)


@pytest.mark.parametrize("name", ["plustimes", "boolean", "tropical"])
def test_batch_columns_equal_single(spark, name):
    dense = pattern()
    m = matrix(spark, dense)
    x = random_vector(spark, 50, name).withColumn("x", F.floor(F.col("x") * 8) if name == "plustimes" else F.col("x"))
    single = m.multiply(x, name)
    assert verify.columns_equal(m.multiply_batch(replicate(x, 3), 3, name), single).first().asDict() == {"cells": 150, "different": 0}
    g = GrammarMatrix.compress(m, 25)
    assert verify.columns_equal(g.multiply_batch(replicate(x, 3), 3, name), single).first()["different"] == 0


def test_tropical_edges(spark):
    m = Matrix.from_entries(spark.createDataFrame([(0, 0, 2.7), (1, 1, -2.7), (2, 2, 2e9), (3, 3, 0.0), (4, 4, 999_999_999.0)], "row long, col long, val double"), 6, 6, drop_zeros=False)
    got = rows(m.multiply(vector(spark, [0, 0, 1, 5, 7, 1]), "tropical"))
    assert got == {0: 2, 1: -2, 2: INF, 3: 5, 4: INF, 5: INF}


def test_duplicates_and_empty_rows(spark):
    m = Matrix.from_entries(spark.createDataFrame([(0, 0, 2.0), (0, 0, 2.0)], "row long, col long, val double"), 2, 1)
    x = vector(spark, [3])
    assert rows(m.multiply(x)) == {0: 12.0, 1: 0.0}
    assert rows(m.multiply(x, "bool")) == {0: 1, 1: 0}
    assert rows(m.multiply(x, "minplus")) == {0: 5, 1: INF}
    g = GrammarMatrix.compress(m)
    assert rows(g.multiply(x)) == {0: 12.0, 1: 0.0}
    assert sorted((r["row"], r["col"], r["val"]) for r in g.entries().collect()) == [(0, 0, 2.0), (0, 0, 2.0)]


def test_empty_matrix(spark):
    m = Matrix.from_entries(spark.createDataFrame([], "row long, col long, val double"), 3, 2)
    assert rows(m.multiply(vector(spark, [1, 1]))) == {0: 0.0, 1: 0.0, 2: 0.0}
    g = GrammarMatrix.compress(m)
    assert rows(g.multiply(vector(spark, [1, 1]))) == {0: 0.0, 1: 0.0, 2: 0.0}
    assert g.entries().count() == 0 and g.stats().first()["depth"] == 0


def test_left_product_and_pointers(spark):
    m = matrix(spark, [[1, 0, 2], [0, 0, 0], [3, 4, 0]])
    x = spark.createDataFrame([(0, 1.0), (1, 5.0), (2, 10.0)], "row long, x double")
    assert {r["col"]: r["y"] for r in m.left_multiply(x).collect()} == {0: 31.0, 1: 40.0, 2: 2.0}
    assert sorted(tuple(r) for r in m.row_pointers().select("row", "row_ptr", "nnz").collect()) == [(0, 0, 2), (1, 2, 0), (2, 2, 2)]


def test_validation(spark):
    with pytest.raises(ValueError):
        semiring.get("maxplus")
    with pytest.raises(ValueError):
        checked_vector(vector(spark, [1, 2]), 3)
    with pytest.raises(ValueError):
        Matrix.from_entries(spark.createDataFrame([(5, 0, 1.0)], "row long, col long, val double"), 3, 1).check()


def test_own_semiring(spark):
    base = semiring.TROPICAL
    longest = semiring.register(semiring.Semiring("maxplus-test", -INF, "bigint", base.leaf, F.max, lambda a, b: F.greatest(a, b), lambda w, n: w, lambda y: y, __import__("numpy").maximum, base.times, base.repeat, base.dtype))
    assert rows(matrix(spark, [[1, 2]]).multiply(vector(spark, [5, 1]), longest)) == {0: 6}


def test_compare(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row long, y double")
    assert verify.compare(a, a).first()["passed"]
    assert not verify.compare(a, a.filter("row = 0")).first()["passed"]
    off = a.withColumn("y", F.col("y") + F.when(F.col("row") == 1, 0.5).otherwise(0.0))
    assert verify.compare(off, a).first()["mismatches"] == 1 and not verify.compare(off, a).first()["passed"]
    assert verify.compare(off, a, first_rows=1).first()["passed"]
    assert verify.clipped(off.withColumn("y", F.lit(2e9))).first()["y"] == 1e9
