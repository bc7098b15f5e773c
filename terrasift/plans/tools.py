"""The tools that roles of the question pipeline call: each answers with an envelope and reports its start, end and time."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import HashingEmbedder
from ..operators import catalog
from ..operators.execute import execute_readonly, explain
from . import search
from .nl import TOOLS

#: Which role, round and stage is calling; events carry it, and so do Spark's jobs.
CALLER: ContextVar[dict] = ContextVar("caller", default={})


@contextmanager
def called_by(spark: SparkSession, role: str, round_id: int, stage: str) -> Iterator[None]:
    """Marks what happens inside as done for a role; afterwards the mark before it holds again."""
    token = CALLER.set({"agent": role, "round": round_id, "stage": stage})
    spark.sparkContext.setLocalProperty("terrasift.caller", f"{role}:{round_id}:{stage}")
    try:
        yield
    finally:
        CALLER.reset(token)
        spark.sparkContext.setLocalProperty("terrasift.caller", None)


def rows_of(df: DataFrame, most: int = 500) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


class Toolkit:
    """Tools over a session's tables, a keyword index, vectors (id, document, metadata, embedding) and pages."""

    def __init__(self, spark: SparkSession, index: search.KeywordIndex | None = None, vectors: DataFrame | None = None, pages: DataFrame | None = None, embedder: HashingEmbedder | None = None, emit: Callable[[str, dict], None] | None = None):
        self.spark, self.index, self.vectors, self.pages = spark, index, vectors, pages
        self.embedder, self.emit = embedder or HashingEmbedder(), emit or (lambda kind, payload: None)
        self.tools: dict[str, Callable[..., object]] = {
            "introspect": self._introspect,
            "estimate_rows": self._estimate,
            "top_distinct": self._top,
            "execute": self._execute,
            "explain": self._explain,
            "keyword_search": self._keywords,
            "vector_search": self._vectors,
            "search": self._hybrid,
            "pages": self._pages,
        }

    def of(self, role: str) -> dict[str, Callable[..., dict]]:
        """The tools that a role may call."""
        return {name: lambda name=name, **k: self.call(name, **k) for name in TOOLS[role]}

    def call(self, name: str, **arguments: object) -> dict:
        """{ok: True, ...} of a tool, or {ok: False, error}; arguments appear in events cut to 240 characters."""
        call, began = uuid.uuid4().hex, time.monotonic()
        about = CALLER.get() | {"call_id": call, "tool": name}
        self.emit("start", about | {"arguments": {k: str(v)[:240] for k, v in arguments.items()}})
        took = lambda: int((time.monotonic() - began) * 1000)
        try:
            out = self.tools[name](**arguments)
            self.emit("end", about | {"elapsed_ms": took()})
            return {"ok": True} | (out if isinstance(out, dict) else {"result": out})
        except Exception as e:
            self.emit("error", about | {"elapsed_ms": took(), "error": str(e)})
            return {"ok": False, "error": str(e)}

    def _introspect(self, schema: str | None = None) -> dict:
        return {"schemas": catalog.schemas(self.spark), "tables": rows_of(catalog.introspect(self.spark, schema))}

    def _estimate(self, table: str, schema: str | None = None) -> dict:
        rows, method = catalog.estimated_rows(self.spark, table, schema)
        return {"rows": rows, "method": method}

    def _top(self, table: str, column: str, k: int = catalog.DEFAULT_DISTINCT, schema: str | None = None) -> dict:
        full = catalog.qualified(table, schema)
        return {"values": rows_of(catalog.top_distinct(self.spark.table(full), column, k))}

    def _execute(self, sql: str, params: dict | None = None, timeout_ms: int = 8000, max_rows: int = 100) -> dict:
        return asdict(execute_readonly(self.spark, sql, params, timeout_ms, max_rows))

    def _explain(self, sql: str) -> dict:
        return {"plan": explain(self.spark, sql)}

    def _keywords(self, query: str, k: int = search.DEFAULT_KEYWORD) -> dict:
        hits = rows_of(self.index.search(query, k))
        return {"hits": hits, "count": len(hits)}

    def _vectors(self, query: str, k: int = search.DEFAULT_VECTOR) -> dict:
        hits = rows_of(search.neighbours(self.vectors, self.embedder.embed_query(query), k).drop("embedding"))
        return {"hits": hits, "count": len(hits)}

    def _hybrid(self, query: str, k: int = search.DEFAULT_HYBRID, merge: bool = True) -> dict:
        """Vector and keyword hits in one list; merge joins them on the function id. count is that of all hits."""
        key = search.function_key(F.col("id")) if merge else F.col("id")
        v = search.neighbours(self.vectors, self.embedder.embed_query(query), k).groupBy(key.alias("key")).agg(F.min_by("document", "distance").alias("document"), F.min("distance").alias("distance"))
        name = F.col("function_id") if "function_id" in self.index.docs.columns else F.col("doc_id").cast("string")
        w = self.index.search(query, k).groupBy(name.alias("key")).agg(F.max_by("document", "score").alias("document"), F.max("score").alias("score"))
        every = rows_of(search.merged(v, w, 2 * max(1, k)))
        return {"hits": every[: max(1, k)], "count": len(every)}

    def _pages(self, query: str, top_k: int = 10, start: int = 1) -> dict:
        return {"results": rows_of(search.page_search(self.pages, query, top_k, start))}
