"""A corpus pipeline of five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Rows with a null id go through the filters like any other: a null id
can't be marked by a join, so such rows are kept, and what the stage does to texts is done to theirs too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirix.llm import decontamination, lexical_packing, minhash_dedup, secret_scan, toxicity
from semirix.llm._store import table
from semirix.runtime import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on all labels, rejects go."""
    ship(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the least id stays, of its repeated rows one."""
    ship(spark)
    marked = minhash_dedup.groups(docs, k=5, percent=80)
    names = docs.columns
    i, t = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    rest = docs.toDF(*[f"c{n}" for n in range(len(names))])  # positional names, so that no column of the table can clash
    rest = rest.join(marked.filter(~F.col("kept")).select(F.col("doc_id").alias(i)).distinct(), i, "left_anti")
    if docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").limit(1).count():  # repeated rows
        copy = F.when(F.col(i).isNotNull(), F.xxhash64(t)).otherwise(F.monotonically_increasing_id())
        rest = rest.withColumn("copy", copy).dropDuplicates([i, "copy"])
    return rest.select(*[f"c{n}" for n in range(len(names))]).toDF(*names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    found = decontamination.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; all documents stay."""
    ship(spark)
    scanner = secret_scan.train(own=secret_scan.corpus(docs))
    return secret_scan.redact(docs, scanner).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 ids, filled with each seed's neighbours."""
    ship(spark)
    return lexical_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_windows),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
