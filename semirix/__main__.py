"""``python -m semirix``: builders, products and reports from the command line.

    describe BASE ROWS COLS               structure of base.val, base.vc.R and base.vc.C
    multiply BASE ROWS COLS X OUT         y as Parquet, for a float32 vector file or a ``random`` one; --semiring=NAME,
                                          --check compares with the expanded matrix, beyond 30M rows only with --force,
                                          --dump=FOLDER writes x and y as arrays for other programs
    csr BASE ROWS COLS [TIMES] [BATCH]    the expanded matrix: row pointers, product times, and a batch whose columns must be equal
    analyze TRIPLES NAMES                 statistics of all predicates
    sparse TRIPLES OUT P...               edges of predicates, a folder for each
    build TRIPLES OUT P                   cells of one predicate
    square TRIPLES OUT P                  edges of one predicate in one id space
    variants VCF OUT [MOST]               dosage cells of single-letter variants
    simulate OUT ROWS COLS [SEED]         genotypes of simulated individuals
    suite TABLES [QUERY...]               runs queries of the catalogue over a folder of tables, one after the other, and times them
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from semirix.operators import genotype, measure, triples, verify
from semirix.plans.matrix import random_vector, replicate
from semirix.runtime import ship
from semirix.sources import binary, text


def _multiply(spark: SparkSession, base: str, rows: int, cols: int, x_path: str, out: str, options: dict[str, str]) -> int:
    semiring = options.get("semiring", "plustimes")
    g = binary.read_grammar(spark, base, rows, cols)
    x = random_vector(spark, cols, semiring) if x_path == "random" else binary.read_vector(spark, x_path, cols)
    g.multiply(x, semiring).write.parquet(out)
    y = spark.read.parquet(out)
    if "dump" in options:
        binary.write_array(x, "col", "x", "f32", f"{options['dump']}/x")
        binary.write_array(y, "row", "y", "f64", f"{options['dump']}/y")
    if "check" in options:
        if not measure.guarded(rows, 0.0, "force" in options)["check"]:
            print(f"SKIPPED: {rows} rows are compared only with --force")
            return 0
        found = verify.compare(y, g.multiply(x, semiring, "entries")).first()
        print(f"{'SUCCESS' if found['passed'] else 'FAILURE'}: greatest difference {found['max_abs']}")
        return 0 if found["passed"] else 1
    return 0


def _csr(spark: SparkSession, base: str, rows: int, cols: int, times: int, batch: int, options: dict[str, str]) -> int:
    if options.get("mode", "repair") != "repair":
        print("the only mode is repair")
        return 2
    m = binary.read_grammar(spark, base, rows, cols).matrix()
    x = random_vector(spark, cols, options.get("semiring", "plustimes"))
    nnz = m.row_pointers().agg({"nnz": "sum"}).first()[0]
    took = measure.timed(spark, "csr", lambda: m.multiply(x, options.get("semiring", "plustimes")), times).first()
    print(f"NNZ: {nnz}\nAverage time: {took['ms_per_vector']:.3f} ms/vector")
    if batch > 1:
        gb = measure.batch_gb(nnz, 0, rows, cols, batch)
        if not measure.guarded(rows, gb)["batch"]:
            print(f"SKIPPED: a batch of {batch} needs {gb:.1f} GB")
            return 0
        found = verify.columns_equal(m.multiply_batch(replicate(x, batch), batch), m.multiply(x)).first()
        print(f"{'SUCCESS' if not found['different'] else 'FAILURE'}: {found['different']} of {found['cells']} cells differ")
        return 0 if not found["different"] else 1
    return 0


def _suite(spark: SparkSession, tables: str, names: list[str]) -> int:
    from semirix.queries import QUERIES

    failed = 0
    for name in names or QUERIES:
        began = time.time()
        try:
            rows = QUERIES[name](spark, tables).count()
            print(f"SUCCESS {name}: {rows} rows in {time.time() - began:.1f} s")
        except Exception as e:  # the others run on
            failed += 1
            print(f"FAILURE {name}: {str(e).splitlines()[0]}")
    return 1 if failed else 0


def main(args: list[str]) -> int:
    options = {k: v for k, _, v in (a[2:].partition("=") for a in args if a.startswith("--"))}
    args = [a for a in args if not a.startswith("--")]
    least = {"describe": 3, "multiply": 5, "csr": 3, "analyze": 2, "sparse": 3, "build": 3, "square": 3, "variants": 2, "simulate": 3, "suite": 1}
    if not args or len(args) - 1 < least.get(args[0], 1 << 30):
        print(__doc__)
        return 2
    spark, (task, *rest) = ship(SparkSession.builder.appName("semirix").getOrCreate()), args
    if task == "describe":
        binary.read_grammar(spark, rest[0], int(rest[1]), int(rest[2])).stats().show(truncate=False)
    elif task == "multiply":
        return _multiply(spark, rest[0], int(rest[1]), int(rest[2]), rest[3], rest[4], options)
    elif task == "csr":
        return _csr(spark, rest[0], int(rest[1]), int(rest[2]), int(rest[3]) if len(rest) > 3 else 100, int(rest[4]) if len(rest) > 4 else 1, options)
    elif task == "analyze":
        triples.analyze(text.read_triples(spark, rest[0]), text.read_predicates(spark, rest[1])).orderBy("p").show(1 << 30, truncate=False)
    elif task == "sparse":
        edges = triples.sparse(text.read_triples(spark, rest[0]), [int(p) for p in rest[2:]])
        for p in rest[2:]:
            text.write_edges(edges.filter(edges["p"] == int(p)), f"{rest[1]}/{p}.sparse")
    elif task == "build":
        triples.build(text.read_triples(spark, rest[0]), int(rest[2])).write.parquet(rest[1])
    elif task == "square":
        text.write_edges(triples.square(text.read_triples(spark, rest[0]), int(rest[2]))[1].toDF("row", "col"), rest[1])
    elif task == "variants":
        genotype.dosage(text.read_variants(spark, rest[0]), int(rest[2]) if len(rest) > 2 else None).write.parquet(rest[1])
    elif task == "simulate":
        genotype.genotypes(spark, int(rest[1]), int(rest[2]), int(rest[3]) if len(rest) > 3 else 1).write.parquet(rest[0])
    else:
        return _suite(spark, rest[0], rest[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
