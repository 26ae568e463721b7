"""One query for each operator of this subpackage, over whole tables, and SQL where DuckDB can give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semirix.llm import (
    decontamination,
    language_id,
    lexical_packing,
    license_scan,
    minhash_dedup,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_output,
    toxicity,
)
from semirix.llm._store import bucket


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents outside fold 0 of 5."""
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(bucket("doc_id", 5) != 0))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether it stays within the fences of its language and source."""
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels outside fold 2 of 4."""
    docs = _read(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, _read(spark, sf_dir, "labels").filter(bucket("doc_id", 4) != 2))
    return quality_classifier.classify(docs, model).select("doc_id", (bucket("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrix of all documents: byte-level BPE, id 50256 after each document."""
    return token_output.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents leak: windows of the item's length, five-word shingles, similarity 0.8."""
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0 of 5."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels").filter(bucket("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies: four-word shingles, similarity 0.8."""
    return minhash_dedup.groups(_read(spark, sf_dir, "documents"), k=4, percent=80)


def op8_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 4096 ids of all documents, each filled with the seed's neighbours; id 2 after each document."""
    return lexical_packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document and page (doc_id or page_id is set), the pages' by their markup's text.

    Documents have no path and inherit nothing; a page is the file host/path of its url, and inherits from the nearest directory of the
    same host that has a licence file.
    """
    docs, pages = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    shown = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", "\n")
    path = F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")
    none = F.lit(None).cast("long")
    files = docs.select(F.struct("doc_id", none.alias("page_id")).alias("id"), "text", F.lit(None).cast("string").alias("path"))
    files = files.unionAll(pages.select(F.struct(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id")).alias("id"), shown.alias("text"), path.alias("path")))
    return license_scan.scan(files, id_col="id").select("id.doc_id", "id.page_id", "path", "license", "score", "line", "via", "from_directory")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate strings of all documents, and which of them are secrets, by the words and transitions of the documents."""
    docs = _read(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(own=secret_scan.corpus(docs)))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_rules, op3_quality_classifier, op4_token_output, op5_decontamination, op6_toxicity, op7_minhash_dedup, op8_lexical_packing, op9_license_scan, op10_secret_scan)}
ORACLE = {"op2_quality_rules": quality_rules.SQL, "op7_minhash_dedup": minhash_dedup.SQL}
