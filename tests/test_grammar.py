"""Grammars: the four-rule fixture, codes, compression, expansion, files."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semirix.plans import csrv, grammar, repair, sweep
from semirix.plans.grammar import GrammarMatrix, csr_bytes, engine_bytes, stream_bytes
from semirix.plans.matrix import Matrix
from semirix.sources import binary


@pytest.fixture
def fixture(spark):
    rules = [(5, "BINARY", 1, 2, 1), (6, "BINARY", 3, 5, 1), (7, "RUNLEN", 6, None, 3), (8, "BINARY", 7, 5, 1)]
    return GrammarMatrix.of(spark, rules, [(0, 0, 8)], [1.5, 2.5], 5, 2, 3).check()


@pytest.mark.parametrize("plan", ["sweep", "levels"])
def test_structure(fixture, plan):
    assert {r["sym"]: (r["lvl"], r["maxref"]) for r in fixture.schedule(plan).collect()} == {5: (1, 4), 6: (2, 3), 7: (3, 4), 8: (4, 4)}
    assert [r["width"] for r in fixture.widths().orderBy("lvl").collect()] == [1, 2, 3, 3]
    s = fixture.stats().first()
    assert (s["depth"], s["raw_rules"], s["pass_throughs"], s["total_rules"], s["max_width"]) == (4, 4, 5, 9, 3)


@pytest.mark.parametrize("plan", ["sweep", "levels", "entries"])
def test_fixture_product(spark, fixture, plan):
    x = spark.createDataFrame([(0, 0.5), (1, -0.5), (2, 1.0)], "col long, x double")
    assert sorted((r["row"], r["y"]) for r in fixture.multiply(x, plan=plan).collect()) == [(0, 4.5), (1, 0.0)]


def test_fixture_expansion(fixture):
    codes = [r["code"] for r in fixture.csrv().orderBy("row", "pos").collect()]
    assert codes == [3, 1, 2] * 3 + [1, 2] and [codes.count(c) for c in (1, 2, 3)] == [4, 4, 3]


def test_same_symbol_twice_counts_twice(spark):
    g = GrammarMatrix.of(spark, [(3, "BINARY", 1, 2, 1)], [(0, 0, 3), (0, 1, 3), (1, 0, 1)], [2.0], 3, 2, 2)
    x = spark.createDataFrame([(0, 1.0), (1, 10.0)], "col long, x double")
    for plan in ("sweep", "levels"):
        assert sorted((r["row"], r["y"]) for r in g.multiply(x, plan=plan).collect()) == [(0, 44.0), (1, 2.0)]


def test_invalid_grammars(spark):
    for rules in ([(5, "BINARY", 0, 1, 1)], [(5, "BINARY", 6, 1, 1), (6, "BINARY", 1, 1, 1)], [(5, "RUNLEN", 1, None, 1)]):
        with pytest.raises(ValueError):
            GrammarMatrix.of(spark, rules, [(0, 0, 5)], [1.0], 5, 1, 4).check()
    with pytest.raises(ValueError):
        GrammarMatrix.of(spark, [], [(4, 0, 1)], [1.0], 5, 1, 4).check()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), max_size=30), max_size=12))
def test_compression_round_trip(rows):
    stream = np.array([c for r in rows for c in [*r, 0]], np.int64)
    s, rules = repair.compress(stream, 7)
    assert not (rules == 0).any() and (s == 0).sum() == len(rows)
    assert all(a < 7 + i and b < 7 + i for i, (a, b) in enumerate(rules.tolist()))
    sym, one = 7 + np.arange(len(rules)), np.ones(len(rules), np.int64)
    assert sweep.expand(7, sym, rules[:, 0], rules[:, 1], one, s)[0].tolist() == stream.tolist()
    pairs = [(a, b) for a, b in zip(s[:-1], s[1:], strict=True) if a and b and a != b]
    assert not pairs or max(pairs.count(p) for p in pairs) < 2


def test_repetitive_rows_compress():
    stream = np.array(([1, 5, 9, 2, 8, 3, 0] * 1000), np.int64)
    s, rules = repair.compress(stream, 10)
    assert len(s) == 2000 and len(rules) == 5


def test_codes(spark):
    cells = [(0, 1, 2.5), (0, 0, 1.5), (2, 1, 1.5), (2, 1, 1.5)]
    m = Matrix.from_entries(spark.createDataFrame(cells, "row long, col long, val double"), 3, 2)
    values = csrv.value_dictionary(m.entries)
    assert [tuple(r) for r in values.orderBy("val_idx").collect()] == [(0, 1.5), (1, 2.5)]
    stream = csrv.encode(m, values)
    assert sorted(tuple(r) for r in stream.collect()) == [(0, 0, 1), (0, 1, 4), (2, 0, 2), (2, 1, 2)]
    assert sorted(tuple(r) for r in csrv.decode(stream, values, 2).collect()) == sorted(cells)
    assert sorted((r["code"], r["id"]) for r in csrv.compacted(stream).collect()) == [(1, 1), (2, 2), (4, 3)]


def test_files(spark, tmp_path):
    base = str(tmp_path / "m")
    np.array([1.5, 2.5]).tofile(f"{base}.val")
    np.array([5, 1, 2, 3, 5], "<i4").tofile(f"{base}.vc.R")
    np.array([6, 0, 0, 1, 6, 0, 4], "<i4").tofile(f"{base}.vc.C")
    g = binary.read_grammar(spark, base, 5, 2)
    assert g.alpha == 5 and sorted((r["sym"], r["left"], r["right"]) for r in g.rules.collect()) == [(5, 1, 2), (6, 3, 5)]
    assert sorted((r["row"], r["pos"], r["sym"]) for r in g.top.collect()) == [(0, 0, 6), (2, 0, 1), (2, 1, 6), (3, 0, 4)]
    np.array([1.0, 10.0], "<f4").tofile(f"{base}.x")
    x = binary.read_vector(spark, f"{base}.x", 2)
    got = sorted((r["row"], r["y"]) for r in g.multiply(x).collect())
    assert got == [(0, 2.5 + 1.5 + 15), (1, 0.0), (2, 1.5 + 2.5 + 1.5 + 15), (3, 25.0), (4, 0.0)]
    with pytest.raises(ValueError):
        binary.read_vector(spark, f"{base}.x", 3)
    np.array([[1, 0], [0, 7]], "<i4").tofile(f"{base}.dense")
    assert sorted(tuple(r) for r in binary.read_dense(spark, f"{base}.dense", 2).collect()) == [(0, 0, 1.0), (1, 1, 7.0)]
    binary.write_array(g.multiply(x), "row", "y", "f64", f"{base}.y")
    assert [r["value"] for r in binary.read_array(spark, f"{base}.y", "f64").orderBy("idx").collect()] == [y for _, y in got]


def test_arrays_in_pieces_and_folders(spark, tmp_path, monkeypatch):
    """Any piece size gives the same records; a folder's files follow each other; odd bytes and existing folders are errors."""
    import os

    values = np.arange(1000, dtype="<i4") * 3 - 7
    monkeypatch.setattr(binary, "CHUNK", 64)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    values.tofile(one)
    binary.write_array(spark.createDataFrame(list(enumerate(values.tolist())), "i long, v long").repartition(7), "i", "v", "i32", many)
    for path in (one, many):
        assert [tuple(r) for r in binary.read_array(spark, path, "i32").orderBy("idx").collect()] == list(enumerate(values.tolist()))
    with pytest.raises(FileExistsError):
        binary.write_array(spark.range(3), "id", "id", "i32", many)
    (tmp_path / "odd").write_bytes(b"12345")
    with pytest.raises(ValueError):
        binary.read_array(spark, str(tmp_path / "odd"), "i32")
    with pytest.raises(FileNotFoundError):
        binary.read_array(spark, str(tmp_path / "none"), "i32")
    (tmp_path / "empty").write_bytes(b"")
    assert binary.read_array(spark, str(tmp_path / "empty"), "f64").count() == 0
    assert binary.stale(str(tmp_path / "none"), one) and not binary.stale(many, str(tmp_path / "none"))
    os.utime(one, (2**31, 2**31))
    assert binary.stale(many, one) and not binary.stale(one, many)


def test_random_vectors_are_the_same_in_any_run(spark):
    from semirix.plans.matrix import random_vector

    for name, fits in (("plustimes", lambda v: 0 <= v < 1), ("boolean", lambda v: v in (0, 1)), ("tropical", lambda v: v == 1e9 or 0 <= v < 100)):
        got = [r["x"] for r in random_vector(spark, 500, name).orderBy("col").collect()]
        assert len(got) == 500 and all(map(fits, got)) and got == [r["x"] for r in random_vector(spark, 500, name).repartition(3).orderBy("col").collect()]
        assert got != [r["x"] for r in random_vector(spark, 500, name, 5).orderBy("col").collect()]
    assert 0.02 < np.mean([r["x"] == 1e9 for r in random_vector(spark, 2000, "tropical").collect()]) < 0.2


def test_published_sizes(spark):
    one = spark.range(1)
    assert one.select(engine_bytes(*[__import__("pyspark").sql.functions.lit(v) for v in (119608, 1105720, 2, 100000, 2504, 146023, 881378, 227920)])).first()[0] == 25156520
    lit = __import__("pyspark").sql.functions.lit
    assert one.select(stream_bytes(lit(12582213), lit(2504))).first()[0] == 50338876
    assert one.select(csr_bytes(lit(2), lit(3), lit(4))).first()[0] == 4 * 3 + 24 + 16 + 8


def test_codes_beyond_32_bits():
    """Keys of pairs of such codes would wrap in 64 bits."""
    big = 1 << 33
    rows = [[5, 7], [5 + (1 << 31), 7], [big - 1, big - 2]] * 3
    stream = np.array([c for r in rows for c in [*r, 0]], np.int64)
    s, rules = repair.compress(stream, big)
    sym = big + np.arange(len(rules))
    assert sweep.expand(big, sym, rules[:, 0], rules[:, 1], np.ones(len(rules), np.int64), s)[0].tolist() == stream.tolist()
    assert len(rules) == 3 and sorted(map(tuple, rules.tolist())) == [(5, 7), (5 + (1 << 31), 7), (big - 1, big - 2)]


def test_wide_matrix_round_trip(spark):
    cols = 50_000_000
    cells = [(i, (i * 7919) % 3 * 17_000_000 + j, float(i % 97 + 1)) for i in range(300) for j in (1, 5, 45_000_000 % 9_000_000)]
    m = Matrix.from_entries(spark.createDataFrame(cells, "row long, col long, val double"), 300, cols)
    g = GrammarMatrix.compress(m, 100)
    assert g.alpha > 1 << 32 and sorted(tuple(r) for r in g.entries().collect()) == sorted(cells)


def test_plans_agree_on_infinity_and_nan(spark):
    inf, nan = float("inf"), float("nan")
    m = Matrix.from_entries(spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (2, 1, 1.0), (3, 2, 5.0)], "row long, col long, val double"), 5, 4)
    g = GrammarMatrix.compress(m, 2)
    x = spark.createDataFrame([(0, inf), (1, nan), (2, None)], "col long, x double")
    show = lambda df: sorted((r["row"], str(r["y"])) for r in df.collect())
    expected = [(0, "nan"), (1, "inf"), (2, "nan"), (3, "0.0"), (4, "0.0")]
    assert [show(g.multiply(x, plan=p)) for p in ("sweep", "levels", "entries")] == [expected] * 3


@pytest.mark.parametrize("semiring", ["plustimes", "boolean", "tropical"])
def test_left_product(spark, fixture, semiring):
    rng = np.random.default_rng(3)
    cells = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 40, 300), rng.integers(0, 12, 300), rng.integers(1, 4, 300), strict=True)]
    m = Matrix.from_entries(spark.createDataFrame(cells, "row long, col long, val double"), 41, 13)
    x = spark.createDataFrame([(i, float(i % 5)) for i in range(0, 41, 2)], "row long, x double")
    pick = lambda df: sorted((r["col"], r["y"]) for r in df.collect())
    for g in (GrammarMatrix.compress(m, 7), GrammarMatrix.compress(m, 1000)):
        assert pick(g.left_multiply(x, semiring)) == pick(m.left_multiply(x, semiring))
    two = spark.createDataFrame([(0, 3.0), (1, 100.0)], "row long, x double")
    assert pick(fixture.left_multiply(two, semiring)) == pick(fixture.matrix().left_multiply(two, semiring))


def test_blocks_by_entries(spark):
    """One row holds more than a block, others little: no block has more than its bound, save for its last row's entries."""
    cells = [(3, j, 1.0) for j in range(500)] + [(i, i % 7, 2.0) for i in range(200)] + [(i, 8, 1.0) for i in range(0, 200, 2)]
    m = Matrix.from_entries(spark.createDataFrame(cells, "row long, col long, val double"), 201, 500)
    g = GrammarMatrix.compress(m, 100, block_entries=60)
    sizes = {r["block"]: r["n"] for r in g.csrv().join(g.top.select("block", "row").distinct(), "row").groupBy("block").agg({"code": "count"}).toDF("block", "n").collect()}
    assert len(sizes) > 3 and max(sizes.values()) <= 60 + 502
    assert sorted(tuple(r) for r in g.entries().collect()) == sorted(cells)
    x = spark.range(500).selectExpr("id as col", "cast(id % 3 as double) as x")
    assert sorted(g.multiply(x).collect()) == sorted(m.multiply(x).collect())


def test_levels_by_joins_of_a_deep_grammar(spark):
    rules = [(3 + i, "BINARY", 1 if i == 0 else 2 + i, 2 if i % 3 else max(1, 2 + i // 2 if i > 1 else 1), 1) for i in range(30)]
    g = GrammarMatrix.of(spark, rules, [(0, 0, 32)], [1.0], 3, 1, 2).check()
    by = lambda plan: sorted(tuple(r) for r in g.levels(plan).collect())
    assert by("levels") == by("sweep") and max(r[2] for r in by("levels")) == 30


def two_blocks(spark):
    """Two blocks of tables, with a run, codes in the top, a code that nothing reads below, and a mark in the top's plan."""
    rules = [(0, 5, "BINARY", 1, 2, 1), (0, 6, "BINARY", 3, 5, 1), (0, 7, "RUNLEN", 6, None, 3), (0, 8, "BINARY", 7, 5, 1), (1, 9, "BINARY", 2, 4, 1), (1, 10, "RUNLEN", 9, None, 2), (1, 11, "BINARY", 10, 9, 1)]
    top = [(0, 0, 0, 8), (0, 0, 1, 1), (0, 1, 0, 6), (0, 1, 1, 6), (0, 2, 0, 4), (1, 4, 0, 11), (1, 5, 0, 9), (1, 5, 1, 3)]
    marked = spark.createDataFrame(top, grammar.TOP).filter("row > -987654")
    return GrammarMatrix(spark.createDataFrame(rules, grammar.RULES), marked, spark.createDataFrame([(0, 1.5), (1, 2.5)], "val_idx long, val double"), 5, 7, 2).check()


def in_groups(df):
    """Whether the plan hands the top's rows to Python by group, a block of any length to one task; its different codes, aggregated, may go."""
    above = []
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < at] + [(at, line)]
        nodes = [x for _, x in above if "GroupsInArrow" in x or "Aggregate" in x]
        if "987654" in line and nodes and "GroupsInArrow" in nodes[-1]:
            return True
    return False


def right_product_of_tables(spark, monkeypatch, semiring):
    g, x = two_blocks(spark), spark.createDataFrame([(0, 3.0), (1, 5.0)], "col long, x double")
    pick = lambda df: sorted((r["row"], r["y"]) for r in df.collect())
    expected = pick(g.matrix().multiply(x, semiring))
    assert not in_groups(g.multiply(x, semiring)) and pick(g.multiply(x, semiring)) == expected
    monkeypatch.setattr(grammar, "RULES_IN_TASK", 3)  # level by level
    assert pick(g.multiply(x, semiring)) == expected


def test_long_top_is_joined(spark, monkeypatch):
    right_product_of_tables(spark, monkeypatch, "plustimes")


@pytest.mark.parametrize("semiring", ["tropical", "boolean"])
def test_long_top_is_joined_in_other_semirings(spark, monkeypatch, semiring):
    right_product_of_tables(spark, monkeypatch, semiring)


def test_long_top_of_a_file_is_joined(spark, tmp_path):
    """A grammar with a run, written as pairs and read again."""
    g, x = two_blocks(spark), spark.createDataFrame([(0, 3.0), (1, 5.0)], "col long, x double")
    binary.write_grammar(g.paired(), f"{tmp_path}/m")
    read = binary.read_grammar(spark, f"{tmp_path}/m", g.rows, g.cols)
    marked = GrammarMatrix(read.rules, read.top.filter("row > -987654"), read.values, read.alpha, read.rows, read.cols)
    assert not in_groups(marked.multiply(x)) and sorted(read.multiply(x).collect()) == sorted(g.matrix().multiply(x).collect())


@pytest.mark.parametrize("semiring", ["plustimes", "tropical", "boolean"])
def test_long_top_is_summed_for_the_left_product(spark, monkeypatch, semiring):
    g, x = two_blocks(spark), spark.createDataFrame([(0, 3.0), (1, 0.0), (4, 100.0), (5, 7.0)], "row long, x double")
    pick = lambda df: sorted((r["col"], r["y"]) for r in df.collect())
    expected = pick(g.matrix().left_multiply(x, semiring))
    assert not in_groups(g.left_multiply(x, semiring)) and pick(g.left_multiply(x, semiring)) == expected
    monkeypatch.setattr(grammar, "RULES_IN_TASK", 3)
    assert pick(g.left_multiply(x, semiring)) == expected


def by_batches(spark, g, x, semiring):
    """The product of a grammar of tables, whose rules no task takes as one group, with batches of two symbols and of all."""
    plan = g.multiply(x, semiring)._jdf.queryExecution().optimizedPlan().toString()
    assert "GroupsInArrow" not in plan and "MapInArrow" in plan
    found, before = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("2", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found.append(sorted((r["row"], r["y"]) for r in g.multiply(x, semiring).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1]
    return found[0]


@pytest.mark.parametrize("semiring", ["tropical", "plustimes"])
def test_rules_of_tables_pass_in_batches(spark, semiring):
    """Two blocks; column 1 has no value in x, so its codes have no leaf."""
    g = two_blocks(spark)
    for cells in ([(0, 3.0), (1, 5.0)], [(0, None)]):
        x = spark.createDataFrame(cells, "col long, x double")
        assert by_batches(spark, g, x, semiring) == sorted((r["row"], r["y"]) for r in g.matrix().multiply(x, semiring).collect())


def test_rising_values_are_those_of_the_sweep():
    """Rules over many batches and a deep chain within one; kept are a name and a value for each symbol, in room for twice as many."""
    from semirix.functions.semiring import PLUS_TIMES, TROPICAL

    rng, n, alpha = np.random.default_rng(4), 20_000, 40
    sym = alpha + 3 * np.arange(n)
    names = np.concatenate([np.arange(1, alpha), sym])
    below = lambda: names[(rng.random(n) ** 0.3 * (alpha - 1 + np.arange(n))).astype(int)]
    left, right, rep = below(), below(), np.ones(n, np.int64)
    left[5000:5200] = sym[4999:5199]
    right[::11], rep[::11] = -1, 2
    for s in (TROPICAL, PLUS_TIMES):
        codes = np.arange(1, alpha, 2)
        leaves = rng.integers(0, 9, (len(codes), 2)).astype(s.dtype)
        symbols, value = sweep.evaluate(s, alpha, sym, left, right, rep, codes, leaves)
        for size in (700, n):
            known, got = sweep.Rising(s, 2), []
            none, one = np.full(len(codes), -1), np.ones(len(codes), np.int64)
            assert (known.add(codes, none, none, one, leaves) == leaves).all()
            for i in range(0, n, size):
                at = slice(i, i + size)
                got.append(known.add(sym[at], left[at], right[at], rep[at], np.zeros((len(sym[at]), 2), s.dtype)).copy())
            assert np.array_equal(np.concatenate(got), value[symbols >= alpha])
            assert known.names.nbytes + known.value.nbytes <= 2 * 24 * (n + alpha)


def test_rules_of_a_file_pass_in_batches(spark, tmp_path):
    """Pairs of runs of three, which have names between others', written and read again."""
    g, x = two_blocks(spark), spark.createDataFrame([(0, 3.0), (1, 5.0)], "col long, x double")
    binary.write_grammar(g.paired(), f"{tmp_path}/m")
    read = binary.read_grammar(spark, f"{tmp_path}/m", g.rows, g.cols)
    assert read.rules.count() == 8
    assert by_batches(spark, read, x, "plustimes") == sorted((r["row"], r["y"]) for r in g.matrix().multiply(x).collect())


def test_a_top_is_numbered_as_its_pieces_are_read(spark, tmp_path, monkeypatch):
    """Rows that cross files and pieces, empty rows, a file without an end, symbols behind the last; no row is sorted or shuffled for it."""
    monkeypatch.setattr(binary, "CHUNK", 64)
    monkeypatch.setattr(binary, "STEP", 5)
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 3, n).astype("<i4") for n in (1, 7, 0, 900, 3)] + [np.ones(5, "<i4"), np.zeros(4, "<i4"), np.full(6, 8, "<i4")]
    (tmp_path / "C").mkdir()
    for i, p in enumerate(parts):
        p.tofile(tmp_path / "C" / f"{i}.bin")
    top = binary.read_top(spark, str(tmp_path / "C"))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Exchange", "Sort", "Window", "Broadcast") if w in plan]
    sym = np.concatenate(parts)
    ends = sym == 0
    begins = np.maximum.accumulate(np.concatenate([[0], np.where(ends, np.arange(len(sym)) + 1, 0)]))[:-1]
    want = np.stack([np.cumsum(ends) - ends, np.arange(len(sym)) - begins, sym])[:, ~ends]
    got = top.orderBy("row", "pos").toPandas()
    assert np.array_equal(got[["row", "pos", "sym"]].to_numpy().T, want) and (got["block"] == 0).all()
    old = binary.rows_of(binary.read_array(spark, str(tmp_path / "C"), "i32").withColumnRenamed("value", "sym"))
    assert top.dtypes == old.dtypes and top.exceptAll(old).count() == old.exceptAll(top).count() == 0
    (tmp_path / "empty").write_bytes(b"")
    assert binary.read_top(spark, str(tmp_path / "empty")).count() == 0


def test_an_array_of_known_length_is_sorted_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """However few partitions the session has."""
    monkeypatch.setattr(binary, "SORTED", 500)
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        binary.write_array(spark.range(10_000).selectExpr("id * 7919 % 10000 as v"), "v", "v", "i32", f"{tmp_path}/v", 10_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)
    files = sorted((tmp_path / "v").iterdir())
    assert len(files) > 10 and max(f.stat().st_size for f in files) <= 4 * 1000
    assert np.array_equal(np.concatenate([np.fromfile(f, "<i4") for f in files]), np.arange(10_000))


def test_a_top_is_joined_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """However few partitions the session has, unless one symbol has more rows than a task; the product and pairs stay the same."""
    g, x = two_blocks(spark), spark.createDataFrame([(0, 3.0), (1, 5.0)], "col long, x double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want = sorted((r["row"], r["y"]) for r in g.matrix().multiply(x).collect())
    most = g.top.groupBy("block", "sym").count().agg({"count": "max"}).first()[0]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    binary.write_grammar(g.paired(), f"{tmp_path}/m")
    try:
        for size, dealt in ((most, True), (most - 1, False), (1_000_000, False)):
            monkeypatch.setattr(grammar, "ROWS_IN_TASK", size)
            tasks = -(-g.top.count() // size)
            read = binary.read_grammar(spark, f"{tmp_path}/m", g.rows, g.cols)
            for h in (g, read):  # the join's sides meet as they are dealt out, with no second shuffle
                ways = re.findall(rf"hashpartitioning\(block#\d+L?, sym#\d+L?, {tasks}\), (\w+)", plan(h.multiply(x)))
                assert sorted(ways) == ["ENSURE_REQUIREMENTS", "REPARTITION_BY_NUM"] if dealt else "REPARTITION_BY_NUM" not in ways
            assert sorted((r["row"], r["y"]) for r in read.multiply(x).collect()) == want
            assert sorted((r["row"], r["y"]) for r in g.multiply(x).collect()) == want
            assert sorted((r["row"], r["y"]) for r in g.paired().multiply(x).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
