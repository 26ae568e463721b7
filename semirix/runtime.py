"""Runs on a cluster: sends this package to the executors, and keeps intermediate tables in the folder that all share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()
#: Greatest size of an Arrow batch; a smaller setting of the session stays.
BATCH_BYTES = 8 << 20


def _bytes(text: str) -> int:
    """Of a setting like 64m; what can't be read, or is negative, is unbounded."""
    digits = "".join(c for c in text if c.isdigit() or c == "-")
    unit = text.lower().lstrip("-0123456789")[:1]
    size = int(digits or -1) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(unit, 1)
    return size if size >= 0 else 1 << 62


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files once for each application, and bounds the bytes of a batch for Python."""
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        top = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="semirix-")) / "semirix_package.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent).as_posix())
        spark.sparkContext.addPyFile(str(archive))
        _SENT.add(app)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="semirix-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path that nothing has, in this application's part of the shared folder."""
    return f"{work_dir(spark)}/semirix/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{tag}"


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application: results that weren't written elsewhere can't be read any more."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/semirix/{spark.sparkContext.applicationId}")
    at.getFileSystem(conf).delete(at, True)


def table(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    What a lazy result still reads can't be deleted by who made it; ``clear`` does, once results are written."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._semirix_path = path
    return out


class Increments:
    """A table that only grows, for loops: each part is written once beside those before it, and read together with them."""

    def __init__(self, spark: SparkSession, schema: str, tag: str):
        self.spark, self.schema, self.parts = spark, schema, 0
        self.path = new_path(spark, tag)

    def add(self, df: DataFrame) -> DataFrame:
        """The rows just written, alone."""
        at = f"{self.path}/part={self.parts}"
        df.write.parquet(at)
        self.parts += 1
        return self.spark.read.schema(df.schema).parquet(at)

    def all(self) -> DataFrame:
        out = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/part={i}" for i in range(self.parts)]) if self.parts else self.spark.createDataFrame([], self.schema)
        out._semirix_path = self.path
        return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes what ``table`` wrote, once nothing reads it any more. Other DataFrames, and None, are left alone."""
    for df in tables:
        path = getattr(df, "_semirix_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            df._semirix_path = None


def collected(spark: SparkSession) -> None:
    """Has the driver collect its garbage, after which Spark deletes the shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()
