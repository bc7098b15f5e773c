"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's tokens and of what they decode to."""
    import public_tokenizers

    from . import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES["op1_byte_bpe"] = op1_byte_bpe


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the fixed kinds, and what the Markov models add."""
    from . import secret_scan

    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures of every document and the verdict on it."""
    from . import repetition

    return repetition.rules(table(spark, sf_dir, "documents"))


QUERIES["op2_secret_scan"] = op2_secret_scan
QUERIES["op8_repetition_rules"] = op8_repetition_rules


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    from pyspark.sql import functions as F

    from . import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES["op10_simhash_near_dedup"] = op10_simhash_near_dedup


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's copies of benchmark items."""
    from . import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, by a machine fitted on the training rows."""
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))


QUERIES["op5_benchmark_decontamination"] = op5_benchmark_decontamination
QUERIES["op9_quality_machine"] = op9_quality_machine


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    from . import html_text

    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES["op3_html_extraction"] = op3_html_extraction


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by the grammar learned from the training rows."""
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


QUERIES["op4_toxicity_grammar"] = op4_toxicity_grammar


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, of near equal bytes."""
    from pyspark.sql import functions as F

    from . import sharding

    rows = sharding.shard(table(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op6_sampled_splitters"] = op6_sampled_splitters


def op7_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder, read back and assembled to captures."""
    from . import warc
    from .common import shared_folder, written

    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    warc.write(pages, folder)
    found = written(warc.read(spark, folder, payload=False), "warc-records")
    return warc.captures(written(warc.assemble(found), "warc-captures"), pages.schema["page_id"].dataType)


QUERIES["op7_warc_transactions"] = op7_warc_transactions
ORACLES["op7_warc_transactions"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31)::INTEGER, 1)), '') AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
