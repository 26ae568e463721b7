"""Report queries over block logs (key, n, line) and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The shapes of the log lines.
STRUCTURE = r"Max depth \(L\): (\d+), Max width \(w\*\): (\d+), Total layered rules: (\d+) \(raw NTs: (\d+), \+pt: (\d+)\), emissions: (\d+)\+(\d+) term"
ENGINE_MS = r"= ([0-9.eE+-]+) ms/vector"
LIBRARY_MS = r"Average time: ([0-9.eE+-]+) ms/vector"
BYTES = r"MEM analytic bytes: (\d+)"
ENERGY = r"ENERGY mJ/vector: ([0-9.eE+-]+)"
COUNTED = r"NNZ:\s*(\d+)"
PACKED = r">>\s*REANS size:\s*(\d+)\s*bytes"
BATCH = r"B=(\d+): ([0-9.eE+-]+) ms/batch, ([0-9.eE+-]+) ms/vector"


def grab(line: str, pattern: str, group: int = 1, kind: str = "double") -> Column:
    """A group of the first match as a number, null where there is none."""
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit("")).cast(kind)


def first_of(*columns: Column) -> Column:
    """The first that isn't null."""
    return F.coalesce(*columns)


def abbreviated(v: str) -> Column:
    """M with two decimals from a million on, K with one from a thousand on, else whole; null is two dashes."""
    c = F.col(v).cast("double")
    return F.when(c.isNull(), F.lit("--")).when(c >= 1e6, F.format_string("%.2fM", c / 1e6)).when(c >= 1e3, F.format_string("%.1fK", c / 1e3)).otherwise(F.format_string("%.0f", c))


def grouped(v: str) -> Column:
    return F.when(F.col(v).isNull(), F.lit("--")).otherwise(F.format_number(F.col(v).cast("double"), 0))


def fixed(v: str | Column, digits: int) -> Column:
    c = (F.col(v) if isinstance(v, str) else v).cast("double")
    return F.when(c.isNull(), F.lit("--")).otherwise(F.format_string(f"%.{digits}f", c))


def megabytes(v: str | Column) -> Column:
    """Bytes as MB with one decimal."""
    c = (F.col(v) if isinstance(v, str) else v).cast("double")
    return fixed(c / 1e6, 1)


def listed(groups: dict[str, DataFrame]) -> DataFrame:
    """Lists of datasets (key, label, nnz, each in the order of ``ord``) one after the other: with their group, numbered from 1."""
    out = None
    for i, (name, rows) in enumerate(groups.items()):
        own = rows.select("key", "label", "nnz", F.lit(name).alias("grp"), F.lit(i).alias("_list"), F.col("ord").alias("_ord"))
        out = own if out is None else out.unionByName(own)
    at = F.row_number().over(Window.orderBy("_list", "_ord", "key"))  # a table's rows: few
    return out.select(at.alias("ord"), "grp", "key", "label", "nnz")


def structure(blocks: DataFrame) -> DataFrame:
    """Each key's first structure line: depth, width, total, raw, passed, emissions, terminal emissions."""
    names = ("depth", "width", "total", "raw", "passed", "emissions", "terminal_emissions")
    hits = blocks.filter(F.col("line").rlike(STRUCTURE)).groupBy("key").agg(F.min_by("line", "n").alias("line"))
    return hits.select("key", *[grab("line", STRUCTURE, i + 1, "bigint").alias(n) for i, n in enumerate(names)])


def structure_table(config: DataFrame, blocks: DataFrame) -> DataFrame:
    """config (ord, key, label) with the abbreviated figures of each; keys without a block are left out."""
    s = config.join(structure(blocks), "key")
    return s.select("ord", "label", F.col("depth"), *[abbreviated(n).alias(n) for n in ("width", "total", "raw", "passed")])


def times_table(config: DataFrame, results: DataFrame) -> DataFrame:
    """config (ord, key, label) and results (key, gpu, omp, seq, mm_seq, mm_16): fixed figures and mm_seq / gpu."""
    r = config.join(results, "key")
    return r.select("ord", "label", *[fixed(n, 3).alias(n) for n in ("gpu", "omp", "seq", "mm_seq", "mm_16")], fixed(F.try_divide("mm_seq", "gpu"), 1).alias("speedup"))


def space_energy(parted: DataFrame) -> DataFrame:
    """Lines with key and part (0 engine, 1 library): time, bytes and energy of either half, and whether the library ran out of memory."""
    half = parted.groupBy("key", "part").agg(
        F.max(first_of(grab("line", ENGINE_MS), grab("line", LIBRARY_MS))).alias("ms"), F.max(grab("line", BYTES, 1, "bigint")).alias("bytes"), F.max(grab("line", ENERGY)).alias("mj"),
        F.max(F.col("line").rlike("(?i)out of memory")).alias("oom"),
    )
    pick = lambda p, c: F.max(F.when(F.col("part") == p, F.col(c)))
    return half.groupBy("key").agg(
        pick(0, "ms").alias("ms"), pick(1, "ms").alias("library_ms"), pick(0, "bytes").alias("bytes"), pick(1, "bytes").alias("library_bytes"), pick(0, "mj").alias("mj"), pick(1, "mj").alias("library_mj"),
        F.coalesce(pick(1, "oom"), F.lit(False)).alias("oom"),
    )


def space_energy_table(config: DataFrame, parted: DataFrame) -> DataFrame:
    """config (ord, grp, key, label, nnz, crossover) and parted lines: the rows of the space, time and energy table.

    A group's header row comes before its first row, the crossover row without one at the end; where the library ran out of memory the crossover
    row says OOM, the others two dashes. The log's count of entries goes before the configured one. Energy is in whole mJ.
    """
    counted = parted.groupBy("key").agg(F.max(F.when(F.col("part") == 1, grab("line", COUNTED, 1, "bigint"))).alias("counted"))
    d = config.join(space_energy(parted), "key").join(counted, "key").withColumn("nnz", F.coalesce("counted", "nnz"))
    lost = lambda c: F.when(F.col("oom"), F.when(F.col("crossover"), F.lit("OOM")).otherwise(F.lit("--"))).otherwise(c)
    rows = d.select(
        F.col("ord").cast("int").alias("ord"), F.lit(1).alias("line"), "label", abbreviated("nnz").alias("nnz"), megabytes("bytes").alias("engine_mb"), lost(megabytes("library_bytes")).alias("library_mb"),
        fixed("ms", 2).alias("engine_ms"), lost(fixed("library_ms", 2)).alias("library_ms"), fixed("mj", 0).alias("engine_mj"), lost(fixed("library_mj", 0)).alias("library_mj"),
    )
    none = F.lit(None).cast("string")
    heads = config.filter(~F.col("crossover")).groupBy("grp").agg(F.min("ord").cast("int").alias("ord")).select("ord", F.lit(0).alias("line"), F.col("grp").alias("label"), *[none.alias(c) for c in rows.columns[3:]])
    return heads.unionAll(rows)


def scale_table(config: DataFrame, parted: DataFrame) -> DataFrame:
    """config (ord, key, label, nnz) and lines in three parts (0 engine, 1 library, 2 grammar): rules and depth, MB of the packed grammar, of the
    library's matrix and of the engine, and the Boolean times of both. Keys without a structure line are left out."""
    pick = lambda p, c: F.max(F.when(F.col("part") == p, c))
    d = parted.groupBy("key").agg(
        pick(0, grab("line", BYTES, 1, "bigint")).alias("engine"), pick(1, grab("line", BYTES, 1, "bigint")).alias("library"), pick(2, grab("line", PACKED, 1, "bigint")).alias("packed"), pick(0, grab("line", ENGINE_MS)).alias("ms"),
        pick(1, grab("line", LIBRARY_MS)).alias("library_ms"),
    )
    j = config.join(structure(parted.filter("part = 0")), "key").join(d, "key")
    return j.select(
        "ord", "label", grouped("nnz").alias("nnz"), grouped("raw").alias("rules"), "depth", megabytes("packed").alias("packed_mb"), megabytes("library").alias("library_mb"), megabytes("engine").alias("engine_mb"),
        F.concat(fixed("ms", 2), F.lit(" / "), fixed("library_ms", 2)).alias("ms"),
    )


def relation_structure(config: DataFrame, blocks: DataFrame) -> DataFrame:
    """config (ord, key, label, nnz): abbreviated entries, rules, layered rules, depth, width and pass-throughs; keys without a block are left out."""
    s = config.join(structure(blocks), "key")
    return s.select("ord", "label", *[abbreviated(n).alias(n) for n in ("nnz", "raw", "total")], "depth", *[abbreviated(n).alias(n) for n in ("width", "passed")])


def construction(blocks: DataFrame, schedule: DataFrame, times: DataFrame) -> DataFrame:
    """Build seconds, repair seconds, schedule ms, size ratio, and how many products cost as much as the build."""
    b = blocks.groupBy("key").agg(
        F.max(grab("line", r"total time: ([0-9.]+)")).alias("build_s"), F.max(grab("line", r"repair time: ([0-9.]+)")).alias("repair_s"),
        F.max(grab("line", r"dense size: (\d+)", 1, "bigint")).alias("dense_bytes"), F.max(grab("line", r"RE32\s+size: (\d+)", 1, "bigint")).alias("re32_bytes"),
    )
    j = b.join(schedule, "key", "left").join(times, "key", "left")
    return j.select("key", "build_s", "repair_s", "schedule_ms", F.round(F.try_divide("dense_bytes", "re32_bytes"), 2).alias("ratio"), F.round(F.try_divide(1000 * F.col("build_s"), F.col("ms")), 0).cast("bigint").alias("amortized_after"))


def batches(blocks: DataFrame) -> DataFrame:
    """(key, b, ms) of all batch lines."""
    return blocks.filter(F.col("line").rlike(BATCH)).select("key", grab("line", BATCH, 1, "int").alias("b"), grab("line", BATCH, 3).alias("ms"))


def best(runs: DataFrame) -> DataFrame:
    """runs (key, side, alg, b, ms): each side's fastest (ties: first alg, least b) and the ratio engine / library."""
    top = runs.groupBy("key", "side").agg(F.min(F.struct("ms", "alg", "b")).alias("t"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(f"t.{c}")))
    out = top.groupBy("key").agg(pick("engine", "ms").alias("engine_ms"), pick("engine", "b").alias("engine_b"), pick("library", "ms").alias("library_ms"), pick("library", "alg").alias("library_alg"), pick("library", "b").alias("library_b"))
    return out.withColumn("ratio", F.round(F.try_divide("engine_ms", "library_ms"), 1))


def sweep_table(runs: DataFrame, merged: tuple[str, str] = ("default", "alg2")) -> DataFrame:
    """(key, b): the engine's time, the better of the ``merged`` algorithms, and alg3's."""
    t = runs.groupBy("key", "b").agg(*[F.min(F.when(c, F.col("ms"))).alias(n) for n, c in (("engine_ms", F.col("side") == "engine"), ("m0", F.col("alg") == merged[0]), ("m1", F.col("alg") == merged[1]), ("alg3_ms", F.col("alg") == "alg3"))])
    return t.select("key", "b", "engine_ms", F.least("m0", "m1").alias("merged_ms"), "alg3_ms")


def footprint(sizes: DataFrame, config: DataFrame) -> DataFrame:
    """config (key, nnz) with sizes (key, nnz, bytes): bytes in each entry, the log's count before the configured one."""
    j = config.withColumnRenamed("nnz", "configured").join(sizes, "key")
    n = F.coalesce("nnz", "configured")
    return j.select("key", n.alias("nnz"), F.round(F.try_divide(F.col("bytes").cast("double"), n), 3).alias("bytes_per_entry"))


def relation_table(blocks: DataFrame) -> DataFrame:
    """Keys ``relation_semiring``: the engine's single time, its best batch, and the library's threads."""
    key = F.regexp_extract("key", r"^(.*)_(boolean|tropical)$", 1)
    t = blocks.withColumns({"relation": key, "semiring": F.regexp_extract("key", r"^(.*)_(boolean|tropical)$", 2)}).filter("relation <> ''")
    lib = r"^\w+ \w+ (\d+) thread\(s\): ([0-9.eE+-]+) ms"
    return t.groupBy("relation", "semiring").agg(
        F.max(grab("line", ENGINE_MS)).alias("single_ms"), F.min(grab("line", BATCH, 3)).alias("batch_ms"), F.min(grab("line", lib, 2)).alias("library_ms"), F.max(grab("line", lib, 1, "int")).alias("threads"),
    )


def tallies(blocks: DataFrame) -> DataFrame:
    """One row: lines that begin with SUCCESS and with FAILURE."""
    return blocks.agg(F.count_if(F.col("line").rlike("^SUCCESS")).alias("successes"), F.count_if(F.col("line").rlike("^FAILURE")).alias("failures"))
