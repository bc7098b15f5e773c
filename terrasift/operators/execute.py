"""Guarded execution: envelopes, row caps, time limits, stable pages and plans."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import is_geometry, readable
from .guard import read_only

MOST_PAGE, DEFAULT_PAGE = 500, 20


@dataclass
class Result:
    status: str
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    latency_ms: int = 0
    returns_rows: bool = False
    error: str | None = None


@dataclass
class Page:
    column_names: list[str]
    rows: list[dict]
    page: int
    page_size: int
    total: int
    total_pages: int
    page_row_count: int


def query(spark: SparkSession, sql: str, params: Mapping[str, object] | None = None, strict_text: bool = False) -> DataFrame:
    """The guarded statement as a DataFrame, with named binds."""
    return spark.sql(read_only(spark, sql, strict_text), args=dict(params or {}))


def capped(df: DataFrame, most: int) -> tuple[DataFrame, int]:
    """df cut to one row more than the cap (so that a cut can be told), and the cap, 1 at least."""
    most = max(1, int(most))
    return df.limit(most + 1), most


def execute_readonly(spark: SparkSession, sql: str, params: Mapping[str, object] | None = None, timeout_ms: int = 8000, max_rows: int = 100, strict_text: bool = False) -> Result:
    """Runs a read-only statement; errors and an exceeded time limit come back in the result.

    The limit holds for all of the statement's jobs, which are cancelled when it passes. At most max_rows + 1 rows reach
    the driver.
    """
    began = time.monotonic()
    group = f"terrasift-{uuid.uuid4().hex}"
    sc, late = spark.sparkContext, threading.Event()
    took = lambda: int((time.monotonic() - began) * 1000)

    def cancel() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(timeout_ms / 1000, cancel)
    timer.daemon = True
    try:
        df, most = capped(query(spark, sql, params, strict_text), max_rows)
        sc.setJobGroup(group, sql[:180], interruptOnCancel=True)
        timer.start()
        got = df.collect()
        rows = [dict(zip(df.columns, r, strict=True)) for r in got[:most]]
        return Result("OK", df.columns, rows, len(rows), len(got) > most, took(), bool(df.columns))
    except Exception as e:
        return Result("ERROR", latency_ms=took(), error=f"no result within {timeout_ms} ms" if late.is_set() else str(e))
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(key, None)


def clamp_page(page: int, size: int) -> tuple[int, int]:
    return max(1, int(page)), min(MOST_PAGE, max(1, int(size)))


def page_count(total: int, size: int) -> int:
    return -(-total // size)


def with_text_geometry(df: DataFrame) -> DataFrame:
    """df with geometry columns as WKT."""
    return df.select(*[readable(F.col(f"`{f.name}`")).alias(f.name) if is_geometry(f) else F.col(f"`{f.name}`") for f in df.schema.fields])


def ordered(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """df in a total order: keys, then every column that can be sorted, so that pages are stable."""
    rest = [f.name for f in df.schema.fields if f.name not in (keys or []) and f.dataType.typeName() not in ("map", "variant")]
    return df.orderBy(*[F.col(f"`{c}`") for c in [*(keys or []), *rest]])


def page_rows(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE, keys: list[str] | None = None) -> DataFrame:
    """The rows of a page, without its count."""
    page, size = clamp_page(page, page_size)
    return ordered(df, keys).offset((page - 1) * size).limit(size)


def page_of(df: DataFrame, page: int = 1, page_size: int = DEFAULT_PAGE, keys: list[str] | None = None) -> Page:
    """A page with the count of all rows."""
    page, size = clamp_page(page, page_size)
    total = df.count()
    rows = [dict(zip(df.columns, r, strict=True)) for r in page_rows(with_text_geometry(df), page, size, keys).collect()]
    return Page(df.columns, rows, page, size, total, page_count(total, size), len(rows))


def sql_page(spark: SparkSession, sql: str, page: int = 1, page_size: int = DEFAULT_PAGE, params: Mapping[str, object] | None = None, keys: list[str] | None = None, schema: str | None = None) -> Page:
    """A page of a guarded query; schema is the current one for it alone. SHOW, EXPLAIN and DESCRIBE have no pages."""
    if schema:
        spark = spark.newSession()
        spark.catalog.setCurrentDatabase(schema)
    text = read_only(spark, sql)
    if text.split(None, 1)[0].upper() not in ("SELECT", "WITH", "FROM", "VALUES", "TABLE", "("):
        raise ValueError("only queries have pages")
    return page_of(spark.sql(text, args=dict(params or {})), page, page_size, keys)


def sample(spark: SparkSession, table: str, limit: int = 5) -> DataFrame:
    return spark.table(table).limit(max(1, limit))


def explain(spark: SparkSession, sql: str, mode: str = "formatted") -> list[str]:
    """The lines of a guarded query's plan."""
    text = read_only(spark, sql)
    return spark.sql(f"EXPLAIN {mode.upper()} {text}").first()[0].splitlines()
