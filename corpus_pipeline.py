"""A corpus pipeline over the table ``documents``: five stages, each written as Parquet and read again.

1. quality rules: documents that fail the base rules or are outliers of their language and source go;
2. line dedup: later occurrences of three-line windows go; a document without a word left goes with them;
3. n-gram Jaccard join: of each group of near copies the smallest document id stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. byte-level BPE: what is left is encoded, and decoded for a check.

The first four return the columns of their input.  Every stage works on all
rows that its predecessor kept; null ids, texts, languages and sources are
treated as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_rules
from sluice.llm.common import fresh, table
from sluice.session import checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows.  ``n_chars`` follows the text where there is such a column."""
    n_lines, n_removed = fresh(docs, "_n_lines"), fresh(docs, "_n_removed")
    left = line_dedup.dedup_lines(docs, lines_col=n_lines, removed_col=n_removed)
    left = left.filter((F.col(n_removed) == 0) | F.col("text").rlike(line_dedup.NOT_BLANK))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col(n_removed) == 0, F.col("n_chars")).otherwise(
            F.length("text").cast(kind)))
    return left.select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: SQL can express neither the iterated covariance estimates nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Each stage is written to the shared checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
