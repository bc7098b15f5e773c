"""Execution logs and overview figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(log: DataFrame, user_id: int | None = None, since: object = None, until: object = None, like: str | None = None, least_ms: float | None = None, status: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """Rows of a log that meet every filter given, newest first.

    Bounds are inclusive, like is a pattern used as it is (case aside), blank texts and a least latency of 0 filter nothing.
    columns maps user_id, insert_time, sql_text, execution_time_ms, execute_status and id to the log's names.
    """
    name = lambda c: F.col((columns or {}).get(c, c))
    tests: list[Column] = []
    if user_id is not None:
        tests.append(name("user_id") == user_id)
    if since is not None:
        tests.append(name("insert_time") >= F.lit(since))
    if until is not None:
        tests.append(name("insert_time") <= F.lit(until))
    if like and like.strip():
        tests.append(name("sql_text").ilike(like))
    if least_ms and least_ms > 0:
        tests.append(name("execution_time_ms") >= least_ms)
    if status and status.strip():
        tests.append(name("execute_status") == status.strip().lower())
    for t in tests:
        log = log.filter(t)
    return log.orderBy(name("insert_time").desc(), name("id").desc())


def summary(log: DataFrame, success: Column, latency: Column) -> DataFrame:
    """One row: executions, successes, success rate and mean latency; 0 where there are none."""
    out = log.agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("succeeded"), F.coalesce(F.sum(latency.cast("double")), F.lit(0.0)).alias("_ms"))
    rate = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("total")), F.lit(0.0))
    return out.select("total", "succeeded", rate(F.col("succeeded")).alias("success_rate"), rate(F.col("_ms")).alias("avg_latency"))


def overview(counts: dict[str, DataFrame]) -> DataFrame:
    """One row of counts; each frame is one number, so the cross joins are of single rows."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
