"""Headerless little-endian arrays: values, rules, top sequences, vectors, dense matrices, and their writers.

An array is a file, or a folder whose files follow each other by name. It is read in pieces of CHUNK bytes, each by numpy in
the task that has it, so a file of any size is split; only names and sizes are looked up first. It is written in as many files as the
range sort has partitions. Paths are local (of a folder that all executors share) or URIs that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semirix.plans.grammar import TOP, GrammarMatrix
from semirix.plans.prefix import running
from semirix.runtime import discard, table

KINDS = {"bool": ("u1", "long"), "i32": ("<i4", "long"), "f32": ("<f4", "double"), "f64": ("<f8", "double")}
CHUNK = 4 << 20
#: Records of a piece that leave a task at once.
STEP = 1 << 16
#: Rows that a task sorts for an array whose length is known, where the session's partitions would have more.
SORTED = 1_000_000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files in the order of their names; hidden ones don't count."""
    system, name = _at(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = [f for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def stale(path: str, *sources: str) -> bool:
    """Whether what was built from ``sources`` has to be built again: it isn't there, or a source is newer than its oldest file."""

    def times(p: str) -> list:
        system, name = _at(p)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            return []
        return [info.mtime] if info.type == fs.FileType.File else [f.mtime for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.is_file]

    built = times(path)
    return not built or any(t > min(built) for s in sources for t in times(s))


def _pieces(spark: SparkSession, path: str, size: int) -> DataFrame | None:
    """(file, total, begin, offset): the pieces of an array of records of ``size`` bytes, dealt out to tasks; None where it is empty. Bytes at
    a file's end that are no whole record are an error."""
    rows, first = [], 0
    for file, total in _files(path):
        if total % size:
            raise ValueError(f"{file} has {total} bytes, which are no whole number of records of {size}")
        if total:
            rows.append((file, total, first))
        first += total // size
    if not rows:
        return None
    pieces = spark.createDataFrame(rows, "file string, total long, begin long").withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(CHUNK).cast("long"))))
    return _dealt(pieces, sum(-(-r[1] // CHUNK) for r in rows))


def _dealt(pieces: DataFrame, count: int) -> DataFrame:
    return pieces.repartition(min(count, 8 * pieces.sparkSession.sparkContext.defaultParallelism), "file", "offset")


def _read(b: pa.RecordBatch, dtype: str, chunk: int) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each piece's first record, and its records."""
    size = np.dtype(dtype).itemsize
    for file, total, begin, offset in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
        system, where = _at(file)
        with system.open_input_file(where) as f:
            yield begin + offset // size, np.frombuffer(f.read_at(min(chunk, total - offset), offset), dtype)


def read_array(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(idx, value) of an array of ``kind``. Bytes at a file's end that are no whole record are an error."""
    dtype, name = KINDS[kind]
    pieces = _pieces(spark, path, np.dtype(dtype).itemsize)
    if pieces is None:
        return spark.createDataFrame([], f"idx long, value {name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, values in _read(b, dtype, CHUNK):
                for i in range(0, len(values), STEP):
                    part = values[i : i + STEP].astype(np.int64 if name == "long" else np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at + i, at + i + len(part))), pa.array(part)], ["idx", "value"])

    return pieces.mapInArrow(run, f"idx long, value {name}")


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(val_idx, val) of a .val file."""
    return read_array(spark, path, "f64").select(F.col("idx").alias("val_idx"), F.col("value").alias("val"))


def read_vector(spark: SparkSession, path: str, cols: int, kind: str = "f32") -> DataFrame:
    """(col, x); a file of another length than ``cols`` is an error."""
    x = read_array(spark, path, kind)
    n = x.count()
    if n != cols:
        raise ValueError(f"the vector has {n} values for {cols} columns")
    return x.select(F.col("idx").alias("col"), F.col("value").alias("x"))


def read_rules(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """alpha, the file's first word, and the rules: words 2i + 1 and 2i + 2 are the children of symbol alpha + i."""
    words = read_array(spark, path, "i32")
    alpha = words.filter("idx = 0").first()["value"]
    pairs = words.filter("idx > 0").withColumn("i", F.expr("(idx - 1) div 2"))
    rules = pairs.groupBy("i").agg(F.max(F.when(F.col("idx") % 2 == 1, F.col("value"))).alias("left"), F.max(F.when(F.col("idx") % 2 == 0, F.col("value"))).alias("right"))
    return alpha, rules.select(F.lit(0).cast("long").alias("block"), (F.col("i") + alpha).alias("sym"), F.lit("BINARY").alias("kind"), "left", "right", F.lit(1).alias("rep"))


def read_top(spark: SparkSession, path: str) -> DataFrame:
    """(block, row, pos, sym) of a .C file, whose rows end with 0. Symbols behind the last 0 are in the next row.

    The pieces are read twice, and no row is sorted or shuffled: first for how many rows end in each and where the last does, a row for
    each piece, then for the symbols, which are numbered on from there."""
    dtype, _ = KINDS["i32"]
    pieces = _pieces(spark, path, np.dtype(dtype).itemsize)
    if pieces is None:
        return spark.createDataFrame([], TOP)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, after = [], []
            for at, sym in _read(b, dtype, CHUNK):
                zero = np.flatnonzero(sym == 0)
                count.append(len(zero))
                after.append(at + int(zero[-1]) + 1 if len(zero) else 0)  # where a row begins
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count, pa.int64()), pa.array(after, pa.int64())], [*b.schema.names, "ends", "after"])

    found = table(pieces.mapInArrow(ends, "file string, total long, begin long, offset long, ends long, after long"), "ends")
    before = Window.orderBy("begin", "offset").rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece
    zero = F.lit(0).cast("long")
    known = found.select("file", "total", "begin", "offset", F.coalesce(F.sum("ends").over(before), zero).alias("row"), F.coalesce(F.max("after").over(before), zero).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (at, symbols), row, start in zip(_read(b, dtype, CHUNK), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                for i in range(0, len(symbols), STEP):
                    sym = symbols[i : i + STEP].astype(np.int64)
                    idx, end = np.arange(at + i, at + i + len(sym)), sym == 0
                    rows, begun = row + np.cumsum(end), np.maximum.accumulate(np.where(end, idx + 1, start))
                    row, start, own = int(rows[-1]), int(begun[-1]), ~end
                    yield pa.RecordBatch.from_arrays([pa.array(rows[own]), pa.array((idx - begun)[own]), pa.array(sym[own])], ["row", "pos", "sym"])

    top = _dealt(known, found.count()).mapInArrow(run, "row long, pos long, sym long").select(zero.alias("block"), "row", "pos", "sym")
    top = table(top, "top")  # else Spark takes it for as small as the pieces' list
    discard(found)
    return top


def rows_of(stream: DataFrame) -> DataFrame:
    """(idx, sym) with 0 after each row -> (block, row, pos, sym)."""
    marked = running(stream.withColumn("ends", (F.col("sym") == 0).cast("int")), ["idx"], "ends", "row").filter("sym <> 0")
    pos = F.row_number().over(Window.partitionBy("row").orderBy("idx")) - 1
    return marked.select(F.lit(0).cast("long").alias("block"), "row", pos.cast("long").alias("pos"), "sym")


def read_grammar(spark: SparkSession, base: str, rows: int, cols: int) -> GrammarMatrix:
    """base.val, base.vc.R and base.vc.C; dimensions aren't in the files."""
    alpha, rules = read_rules(spark, f"{base}.vc.R")
    return GrammarMatrix(rules, read_top(spark, f"{base}.vc.C"), read_values(spark, f"{base}.val"), alpha, rows, cols).check()


def read_dense(spark: SparkSession, path: str, cols: int, kind: str = "i32") -> DataFrame:
    """(row, col, val) of the non-zero cells of a row-major matrix."""
    cells = read_array(spark, path, kind).filter("value <> 0")
    return cells.select(F.expr(f"idx div {cols}").alias("row"), (F.col("idx") % cols).alias("col"), F.col("value").cast("double").alias("val"))


def write_array(df: DataFrame, order: str | list[str], value: str, kind: str, path: str, rows: int = 0) -> None:
    """A column in ``order`` as a folder of arrays that follow each other. A task writes its file under another name first, so one that
    is lost or runs twice leaves no half. Of as many ``rows``, where they are known, a task sorts about SORTED at most."""
    dtype, _ = KINDS[kind]
    system, name = _at(path)
    system.create_dir(name, recursive=True)
    if system.get_file_info(fs.FileSelector(name)):
        raise FileExistsError(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get(), 0
        system, name = _at(path)
        own = f"{name}/.{task.partitionId()}-{task.taskAttemptId()}"
        with system.open_output_stream(own) as out:
            for b in batches:
                data = b.column(0).to_numpy(zero_copy_only=False).astype(dtype)
                out.write(data.tobytes())
                count += len(data)
        if count:
            system.move(own, f"{name}/{task.partitionId():06}.bin")
        else:
            system.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    order, tasks = [order] if isinstance(order, str) else order, -(-rows // SORTED)
    few = tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.orderBy(*order) if few else df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    ordered.select(value).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def write_values(values: DataFrame, path: str) -> None:
    """(val_idx, val) as a .val array."""
    write_array(values, "val_idx", "val", "f64", path)


def write_dense(entries: DataFrame, rows: int, cols: int, path: str, kind: str = "i32") -> None:
    """(row, col, val) as a row-major matrix with its zeros; cells given twice are summed. For matrices that are dense enough."""
    cells = entries.groupBy("row", "col").agg(F.sum("val").alias("val"))
    every = entries.sparkSession.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("col"))
    write_array(every.join(cells, ["row", "col"], "left").withColumn("val", F.coalesce("val", F.lit(0.0))), ["row", "col"], "val", kind, path)


def write_grammar(g: GrammarMatrix, base: str) -> None:
    """base.val, base.vc.R and base.vc.C of a grammar of one block of pairs, whose symbols are numbered from alpha without a gap."""
    rules = g.rules.agg(F.count(F.lit(1)).alias("n"), F.min("sym").alias("a"), F.max("sym").alias("b"), F.count_if(F.col("right").isNull()).alias("runs"), F.count_distinct("block").alias("blocks")).first()
    if rules["runs"] or rules["blocks"] > 1 or rules["n"] and (rules["a"], rules["b"]) != (g.alpha, g.alpha + rules["n"] - 1):
        raise ValueError("files hold one block of pairs with symbols from alpha on")
    write_values(g.values, f"{base}.val")
    head = g.spark.createDataFrame([(-1, 0, g.alpha)], "sym long, side int, word long")
    words = g.rules.select("sym", F.posexplode(F.array("left", "right")).alias("side", "word"))
    write_array(head.unionAll(words), ["sym", "side"], "word", "i32", f"{base}.vc.R", 2 * rules["n"] + 1)
    ends = g.spark.range(g.rows).select(F.col("id").alias("row"), F.lit((1 << 62)).alias("pos"), F.lit(0).cast("long").alias("sym"))
    top = table(g.top.select("row", "pos", "sym"), "top")
    write_array(top.unionAll(ends), ["row", "pos"], "sym", "i32", f"{base}.vc.C", top.count() + g.rows)
    discard(top)
