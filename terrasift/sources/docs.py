"""Lists of function documents as JSON, and whether a step's output is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_text

DOCUMENT = "STRUCT<function_id: STRING, chapter_info: STRING, description: STRING, function_definitions: ARRAY<STRUCT<function_name: STRING, signature_str: STRING>>, examples: ARRAY<STRUCT<name: STRING, steps: ARRAY<STRUCT<question: STRING, sql: STRING>>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON file that must hold a list (else ValueError), with their position, key and text."""
    raw = spark.read.text(path, wholetext=True)
    bad = raw.filter(~F.startswith(F.ltrim("value"), F.lit("[")) | F.from_json("value", "ARRAY<STRING>").isNull()).limit(1)
    if bad.count():
        raise ValueError(f"{path} is not a JSON list")
    doc = raw.select(F.posexplode(F.from_json("value", f"ARRAY<{DOCUMENT}>"))).select(F.col("pos").cast("long").alias("doc_id"), F.col("col").alias("doc"))
    return doc.select("doc_id", "doc.*", F.concat_ws("_", F.col("doc.function_id"), "doc_id").alias("vector_id"), document_text(F.col("doc")).alias("document"))


def has_content(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, in any store that Spark reaches: a finished step is skipped."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop)) and fs.getContentSummary(hadoop).getLength() > 0
