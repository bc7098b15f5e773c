"""A training corpus from raw documents: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Stages are run one after another, each over all that the stage before it kept, written as Parquet and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import bpe, decontaminate, quality, secret_scan, similar
from terrasift.llm.common import write_table
from terrasift.shared import remove, tables_of_run

#: No SQL expresses a trained machine, SimHash or BPE; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; it is fitted on labelled training rows among docs.

    Without labelled rows nothing is rejected.
    """
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of SimHash near-duplicates: texts whose five-word shingles
    have a Jaccard similarity of 0.8 or more, or whose fingerprints differ in two bits at most."""
    return similar.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the name of the kind; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's tokens and of what they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder.

    What a stage wrote for itself is removed once its result is written, and so is the result of the stage before it. The
    last stage's result reads the one table that is left.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with tables_of_run(spark) as kept:
            docs, path = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
