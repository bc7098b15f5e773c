"""Chat history: latest values, last turns, and which request a row belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key the value of the last row that has one (null if none has); only maxima are shuffled."""
    return df.groupBy(key).agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def last_turns(df: DataFrame, key: str, order: str, n: int, where: Column | None = None) -> DataFrame:
    """Per key the last n rows (of those where holds), in ascending order."""
    rows = df.filter(where) if where is not None else df
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    return ranked.filter(F.col("_r") <= n).drop("_r").orderBy(key, order)


#: Order values that a stretch of a long history spans.
STRETCH = 4096


def request_ids(df: DataFrame, key: str, order: str, is_request: Column, name: str = "request_id") -> DataFrame:
    """A request's rows have its order value (a number): the last one at or before them within the key.

    A history is cut into stretches of its order values. Each stretch's last request is found by a grouped maximum, what a
    stretch takes over from those before it by a window over one row a stretch, and the rest within the stretch; so a key
    with very many rows is spread over tasks.
    """
    asked = F.when(is_request, F.col(order))
    rows = df.withColumn("_s", F.floor(F.col(order) / STRETCH))
    last = rows.groupBy(F.col(key).alias("_k"), F.col("_s").alias("_t")).agg(F.max(asked).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    taken = last.withColumn("_before", F.max("_last").over(before)).drop("_last")
    within = Window.partitionBy(key, "_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(name, F.max(asked).over(within)).join(taken, F.col(key).eqNullSafe(F.col("_k")) & F.col("_s").eqNullSafe(F.col("_t")), "left")
    return found.withColumn(name, F.coalesce(name, "_before")).drop("_s", "_k", "_t", "_before")


def deltas(df: DataFrame, key: str, order: str, text: str, name: str = "delta") -> DataFrame:
    """What each cumulative snapshot adds to the one before it; all of it if it does not continue that."""
    before = F.lag(text).over(Window.partitionBy(key).orderBy(order))
    grown = F.when(before.isNull(), F.col(text)).when(F.startswith(F.col(text), before), F.substr(F.col(text), F.length(before) + 1)).otherwise(F.col(text))
    return df.withColumn(name, grown)


def joined(df: DataFrame, key: list[str], order: str, text: str, name: str = "text") -> DataFrame:
    """Pieces of each key in their order, as one text."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias(name))
