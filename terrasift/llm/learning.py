"""Labelled samples for the models of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import train_row, written


def sample(df: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id", text_col: str = "text", more: dict[str, Column] | None = None) -> DataFrame:
    """(text, label) of at most rows labelled training rows, and columns of more: those whose hashed ids come first.

    The sample is drawn from the labels alone, so its size is bounded before it meets the documents, and lies in the
    shared folder. Of several labels of an id the largest counts; null labels and ids are not used.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & train_row(F.col(id_col)))
    few = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    own = [c.alias(n) for n, c in (more or {}).items()]
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"), *own)
    # few has at most rows rows of two numbers
    return written(docs.join(F.broadcast(few), "_id").select("text", "label", *(more or {})), f"sample-{label}")
