"""Builders, graph loops, reports, streaming, and every query against its SQL."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from semirix import queries as catalogue
from semirix.operators import genotype, graph, measure, report, triples
from semirix.plans.matrix import Matrix
from semirix.plans.prefix import ranked, running
from semirix.sources import text
from semirix.streaming.incremental import running_product

SMALL = "/root/testdata/sf0.001"


def test_triples(spark, tmp_path):
    (tmp_path / "t.dat").write_text("10 1 007\n10 1 7\n11 1 9\nbroken line\n1 2 3 4\n9 2 10\n")
    (tmp_path / "t.P").write_text("1 has part\nx\n")
    t = text.read_triples(spark, str(tmp_path / "t.dat"))
    assert sorted(tuple(r) for r in t.collect()) == [(9, 2, 10), (10, 1, 7), (10, 1, 7), (11, 1, 9)]
    got = {r["p"]: r.asDict() for r in triples.analyze(t, text.read_predicates(spark, str(tmp_path / "t.P"))).collect()}
    assert (got[1]["name"], got[1]["n"], got[1]["subjects"], got[1]["objects"], got[1]["dense_bytes"]) == ("has part", 3, 2, 2, 16)
    assert got[2]["name"] == "Unknown_2"
    assert sorted(tuple(r) for r in triples.sparse(t, [1, 2]).collect()) == [(1, 0, 0), (1, 0, 0), (1, 1, 1), (2, 0, 0)]
    assert sorted(tuple(r) for r in triples.build(t, 1).collect()) == [(0, 0, 1.0), (1, 1, 1.0)]
    nodes, edges = triples.square(t, 1)
    assert sorted(tuple(r) for r in nodes.collect()) == [(0, 7), (1, 9), (2, 10), (3, 11)]
    assert sorted(tuple(r) for r in edges.collect()) == [(2, 0), (2, 0), (3, 1)]
    text.write_edges(triples.sparse(t, [1]), str(tmp_path / "e"))
    assert sorted(tuple(r) for r in text.read_edges(spark, str(tmp_path / "e")).collect()) == [(0, 0), (0, 0), (1, 1)]


def test_variants(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI\tFORMAT\ta\tb\tc\n"
    rows = ["1\t1\t.\tA\tC\t.\t.\t.\tGT\t0|1\t1|1\t.|.", "1\t2\t.\tAT\tC\t.\t.\t.\tGT\t1|1\t1|1\t1|1", "1\t3\t.\tG\tT\t.\t.\t.\tGT\t0/0\t1/2\t1"]
    (tmp_path / "v.vcf").write_text(head + "\n".join(rows) + "\n")
    v = text.read_variants(spark, str(tmp_path / "v.vcf"))
    assert sorted(tuple(r) for r in genotype.dosage(v).collect()) == [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 1.0), (2, 1, 1.0)]
    assert sorted(tuple(r) for r in genotype.dosage(v, 1).collect()) == [(0, 0, 1.0), (1, 0, 2.0)]


def test_haplotypes(spark):
    h = spark.createDataFrame([(s, p, a) for s, row in enumerate(["0110", "0000", "1111", "0020"]) for p, a in enumerate(map(int, row))], "site int, hap int, allele int")
    kept = genotype.segregating(genotype.binarized(h))
    assert sorted({r["site"] for r in kept.collect()}) == [0, 3]
    assert sorted(tuple(r) for r in genotype.paired(kept).collect()) == [(0, 0, 1.0), (1, 0, 1.0), (1, 3, 1.0)]
    g = genotype.genotypes(spark, 10, 40)
    assert g.agg(F.max("col"), F.max("row")).first() == (39, 9) and {r["val"] for r in g.select("val").distinct().collect()} <= {1.0, 2.0}


def test_graphs(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (1, 2, 1.0), (0, 2, 9.0), (2, 0, 1.0), (3, 4, 1.0)], "src long, dst long, w double")
    assert sorted(tuple(r) for r in graph.bfs(e, 0).collect()) == [(0, 0), (1, 1), (2, 1)]
    assert sorted(tuple(r) for r in graph.sssp(e, 0, "w").collect()) == [(0, 0.0), (1, 5.0), (2, 6.0)]
    m = Matrix.from_entries(e.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("w").alias("val")), 5, 5)
    y = {(r["row"], r["b"]): r["y"] for r in graph.apsp(m, [2, 4]).collect()}
    assert y[0, 0] == 6 and y[1, 0] == 1 and y[3, 1] == 1 and y[0, 1] == 1_000_000_000 and y[2, 0] == 0
    x = spark.range(5).select(F.col("id").alias("col"), (F.col("id") == 4).cast("int").alias("x"))
    assert sorted(r["row"] for r in graph.fixpoint(m, x).collect() if r["y"]) == [3, 4]
    with pytest.raises(ValueError):
        graph.fixpoint(m, x, "plustimes")


def test_prefix(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), (F.col("id") % 7).alias("v")).repartition(9)
    assert all(r["k"] == r["i"] for r in ranked(df, ["k"], "i").collect())
    rows = sorted((r["k"], r["v"], r["s"]) for r in running(df, ["k"], "v", "s").collect())
    total = 0
    for _, v, s in rows:
        assert s == total
        total += v


def test_dense_text(spark):
    lines = spark.createDataFrame([(0, "0, 1.5,2"), (1, "0,0,0")], "row long, value string")
    assert sorted(tuple(r) for r in text.csv_cells(lines).collect()) == [(0, 1, 1.5), (0, 2, 2.0)]


def test_report_nulls(spark):
    v = spark.createDataFrame([(None, "x")], "v double, line string")
    assert v.select(report.abbreviated("v"), report.grouped("v"), report.fixed("v", 1), report.grab("line", r"(\d+)")).first() == ("--", "--", "--", None)


def test_measure(spark):
    rows = measure.timed(spark, "m/4", lambda: spark.range(3), 2, 4).unionByName(spark.createDataFrame([("m/8", 8, 1.0, 1.0, 1e-9, None)], measure.METRICS))
    first = rows.filter("label = 'm/4'").first()
    assert first["vectors"] == 8 and abs(first["ms_per_batch"] - 4 * first["ms_per_vector"]) < 1e-9
    assert tuple(measure.best_batch(rows).first()) == ("m", 8, 1e-9) and first["peak_mb"] > 50
    log = measure.lines(rows).filter("key = 'm/8'").orderBy("n").collect()
    assert [r["line"] for r in log] == ["## m/8", "GPU kernel: 1.000 ms total over 8 vectors = 0.000000 ms/vector."]
    back = text.log_blocks(measure.lines(rows).select(F.lit("f").alias("file"), (F.col("n") + F.when(F.col("key") == "m/8", 10).otherwise(0)).alias("n"), "line"))
    assert {r["key"] for r in back.collect()} == {"m/4", "m/8"}
    blocks = measure.by_blocks(spark, lambda i: spark.range(i + 1), 3, "m")
    assert sorted(r["label"] for r in blocks.collect()) == ["m/0", "m/1", "m/2"]


def test_guards():
    assert measure.guarded(10, 1.0) == {"check": True, "batch": True} and measure.guarded(40_000_000, 100.0) == {"check": False, "batch": False}
    assert measure.guarded(40_000_000, 1.0, force=True)["check"] and measure.batch_gb(1000, 500, 1000, 1000, 10**6) == 16.0


def test_command_line(spark, tmp_path):
    from semirix.__main__ import main

    (tmp_path / "t.dat").write_text("10 1 7\n11 1 9\n")
    assert main(["build", str(tmp_path / "t.dat"), str(tmp_path / "out"), "1"]) == 0
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 0, 1.0), (1, 1, 1.0)]
    assert main([]) == 2


def test_products_from_the_command_line(spark, tmp_path, capsys):
    """Describe, multiply with a check, and the expanded matrix with a batch, on one grammar in files."""
    import numpy as np

    from semirix.__main__ import main
    from semirix.sources import binary

    base = str(tmp_path / "m")
    np.array([1.5, 2.5]).tofile(f"{base}.val")
    np.array([5, 1, 2, 3, 5], "<i4").tofile(f"{base}.vc.R")
    np.array([6, 0, 0, 1, 6, 0, 4], "<i4").tofile(f"{base}.vc.C")
    np.array([1.0, 10.0], "<f4").tofile(f"{base}.x")
    assert main(["describe", base, "5", "2"]) == 0 and "alpha_used" in capsys.readouterr().out
    assert main(["multiply", base, "5", "2", f"{base}.x", f"{base}.out", "--check", f"--dump={base}.dump"]) == 0
    assert [r["y"] for r in spark.read.parquet(f"{base}.out").orderBy("row").collect()] == [19.0, 0.0, 20.5, 25.0, 0.0]
    assert [r["value"] for r in binary.read_array(spark, f"{base}.dump/y", "f64").orderBy("idx").collect()] == [19.0, 0.0, 20.5, 25.0, 0.0]
    assert main(["multiply", base, "5", "2", "random", f"{base}.tropical", "--semiring=tropical", "--check"]) == 0
    assert main(["csr", base, "5", "2", "2", "3"]) == 0 and "SUCCESS" in capsys.readouterr().out
    assert main(["csr", base, "5", "2", "--mode=recompress"]) == 2


def test_all_products_of_a_suite(spark, capsys):
    from semirix.__main__ import main

    assert main(["suite", SMALL, "cross_check", "grammar_stats"]) == 0
    assert capsys.readouterr().out.count("SUCCESS") == 2


def test_stream_follows_batch(spark, tmp_path):
    x = spark.createDataFrame([(0, 2.0), (1, 3.0)], "col long, x double")
    source, schema = str(tmp_path / "in"), "row long, col long, val double"
    parts = [[(0, 0, 1.0), (1, 1, 4.0)], [(0, 1, 5.0), (1, 0, -1.0)]]
    for name in ("plustimes", "tropical"):
        for i, p in enumerate(parts):
            spark.createDataFrame(p, schema).coalesce(1).write.mode("overwrite").parquet(f"{source}/{name}{i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/{name}*")
        q = running_product(stream, x, name).writeStream.outputMode("complete").format("memory").queryName(f"y_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {r["row"]: r["y"] for r in spark.table(f"y_{name}").collect()}
        m = Matrix.from_entries(spark.createDataFrame([c for p in parts for c in p], schema), 2, 2)
        assert got == {r["row"]: r["y"] for r in m.multiply(x, name).collect()}


def _same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    norm = lambda df: sorted((tuple(None if v != v or v is None else v for v in r) for r in df[cols].itertuples(index=False)), key=str)
    return norm(a) == norm(b)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    if not Path(SMALL).is_dir():
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    assert _same(catalogue.QUERIES[name](spark, SMALL).toPandas(), c.sql(catalogue.ORACLE[name]).df())


def test_entry_points(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if Path(SMALL).is_dir():
        assert e.entry(spark).count() > 0


def test_library_does_not_import_the_subpackage():
    top = Path(__file__).resolve().parents[1] / "semirix"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "semirix.llm" in p.read_text()]


def test_loops_write_what_changes_and_leave_their_result(spark):
    """On a chain of 24 nodes: what a loop writes grows with its rounds and not their square, and only its result stays."""
    from pathlib import Path

    from semirix.operators import graph
    from semirix.plans.matrix import Matrix

    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "semirix" / spark.sparkContext.applicationId
    kept = lambda: {p.name for p in shared.glob("*")} if shared.is_dir() else set()
    edges = spark.createDataFrame([(i, i + 1) for i in range(23)], "src long, dst long")
    m = Matrix.from_entries(edges.selectExpr("src as row", "dst as col", "1.0D as val"), 24, 24)
    for run in (
        lambda: graph.bfs(edges, 0), lambda: graph.sssp(edges, 0), lambda: graph.apsp(m, [23]).select("row", "y"),
        lambda: graph.fixpoint(m, spark.createDataFrame([(23, 0.0)], "col long, x double"), "tropical").selectExpr("23 - row", "y"),
    ):
        before = kept()
        out = run()
        got = sorted(tuple(r) for r in out.collect())
        assert [int(v) for _, v in got] in (list(range(24)), list(range(23, -1, -1)))
        assert len(kept() - before) == 1
        parts = list((shared / next(iter(kept() - before))).rglob("*.parquet"))
        assert sum(p.stat().st_size for p in parts) < 400_000


def test_too_few_sites_are_an_error(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(genotype, "coalescent", lambda spark, haps, length, *a: asked.append(length) or spark.createDataFrame([(0.5, [0])], "pos double, carriers array<long>"))
    with pytest.raises(RuntimeError):
        genotype.genotypes(spark, 2, 50, tries=3)
    assert asked == [asked[0], 2 * asked[0], 4 * asked[0]]


def test_coalescent_has_the_expected_sites(spark):
    """Watterson's number of sites, the share of singletons, and pairwise differences; no mutation is lost or common to all."""
    n, length, ne, mu = 12, 6e6, 1000.0, 1e-7
    sites = genotype.coalescent(spark, n, length, 1e-7, ne, mu, 5, 50_000).collect()
    theta, h = 4 * ne * mu * length, sum(1 / i for i in range(1, n))
    assert abs(len(sites) / (theta * h) - 1) < 0.1
    sizes = [len(r["carriers"]) for r in sites]
    assert abs(sum(s == 1 for s in sizes) / len(sizes) * h - 1) < 0.15 and 0 < min(sizes) and max(sizes) < n
    assert abs(sum(2 * s * (n - s) / (n * (n - 1)) for s in sizes) / theta - 1) < 0.1
    again = genotype.coalescent(spark, n, length, 1e-7, ne, mu, 5, 50_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, sites))


def test_recombination_breaks_linkage(spark):
    """Without recombination all sites of a chunk fit one tree (no pair has all four gametes); with it, distant pairs do not."""

    def four(rate):
        sites = sorted((r["pos"], set(r["carriers"])) for r in genotype.coalescent(spark, 10, 1e5, rate, 1000.0, 1e-7, 3, 1e5).collect())
        pairs = [(a, b) for i, (_, a) in enumerate(sites) for _, b in sites[i + 1 :]]
        return sum(bool(a & b) and bool(a - b) and bool(b - a) and len(a | b) < 10 for a, b in pairs), len(pairs)

    assert four(0.0)[0] == 0 < four(0.0)[1] and four(1e-6)[0] > 0


def test_genotypes_have_their_shape(spark):
    got = genotype.genotypes(spark, 6, 40, seed=2).collect()
    assert {r["col"] for r in got} == set(range(40)) and {r["row"] for r in got} <= set(range(6)) and {r["val"] for r in got} <= {1.0, 2.0}


def test_dense_ids_of_skewed_predicates(spark):
    """Ranks within predicates by one range sort: no window by predicate, no single partition."""
    from semirix.operators import triples

    t = spark.createDataFrame([(i * 3 % 50, 1, i) for i in range(60)] + [(7, 2, 9), (5, 2, 9)], "s long, p long, o long")
    got = sorted(tuple(r) for r in triples.sparse(t, [1, 2]).collect())
    subjects = sorted({i * 3 % 50 for i in range(60)})
    assert got == sorted([(1, subjects.index(i * 3 % 50), i) for i in range(60)] + [(2, 1, 0), (2, 0, 0)])
    plan = triples.sparse(t, [1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(p" not in plan
