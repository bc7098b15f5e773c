"""Retrieval: keyword index, vector neighbours, and both merged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import literal, squared_distance
from ..shared import checkpointed, ensure_workers
from ..sources import docs as doc_lists

DEFAULT_KEYWORD, DEFAULT_VECTOR, DEFAULT_HYBRID, MOST_WEB = 10, 5, 8, 10


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "document", least: int = 2) -> DataFrame:
    """Rows (token, doc_id): the distinct tokens of each document. No shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(tokens(F.col(text_col), least))).alias("token"))


#: Ids that a segment of a posting list spans.
SEGMENT = 65_536


def posting_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "document", least: int = 2) -> DataFrame:
    """Rows (token, segment, doc_ids): ascending documents of each token whose id lies in the segment's span of ids.

    However many documents hold a token, a row and the task that makes it hold one span of them.
    """
    p = postings(docs, id_col, text_col, least).withColumn("segment", F.floor(F.col("doc_id") / SEGMENT))
    return p.groupBy("token", "segment").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))


@dataclass
class KeywordIndex:
    """Postings and documents; held as Parquet partitioned by a hash of the token, so a search reads few files."""

    postings: DataFrame
    docs: DataFrame
    least: int = 2
    buckets: int = 64
    #: Rows (doc_id, tokens) of an index that is not saved.
    tokens: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "document", least: int = 2) -> KeywordIndex:
        named = docs.withColumnRenamed(id_col, "doc_id").withColumnRenamed(text_col, "document")
        held = named.select("doc_id", tokens(F.col("document"), least).alias("tokens"))
        return cls(postings(docs, id_col, text_col, least), named, least, tokens=held)

    def save(self, folder: str) -> None:
        bucket = F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int")
        dealt = self.postings.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(8)))
        ordered = dealt.sortWithinPartitions("bucket", "token", "doc_id")
        ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
        self.docs.write.mode("overwrite").parquet(f"{folder}/docs")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, least: int = 2, buckets: int = 64) -> KeywordIndex:
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/docs"), least, buckets)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str, least: int = 2) -> KeywordIndex:
        """An index of the JSON export. Without texts they come from the documents that doc_source names, if it is there,
        else from the documents' own field, else they are empty."""
        kind = "doc_source STRING, token_to_docs MAP<STRING, ARRAY<BIGINT>>, docs ARRAY<MAP<STRING, STRING>>, documents ARRAY<STRING>"
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
        post = raw.select(F.explode("j.token_to_docs").alias("token", "ids")).select(F.explode("ids").alias("doc_id"), "token")
        docs = raw.select(F.posexplode("j.docs").alias("doc_id", "meta"), F.col("j.documents").alias("texts"))
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_own", F.try_element_at("texts", F.col("doc_id").cast("int") + 1))
        head = raw.select(F.col("j.doc_source").alias("source"), F.coalesce(F.size("j.documents"), F.lit(-1)).alias("n")).first()
        recovered = head["n"] <= 0 and head["source"] and doc_lists.has_content(spark, head["source"])
        if recovered:
            texts = doc_lists.read(spark, head["source"]).select("doc_id", F.col("document").alias("_read"))
        else:
            texts = spark.createDataFrame([], "doc_id long, _read string")
        text = F.coalesce("_own", "_read", F.col("meta")["document"], F.lit(""))
        return cls(post, docs.join(texts, "doc_id", "left").select("doc_id", "meta", text.alias("document")), least)

    def to_json(self, folder: str, source: str = "") -> None:
        """The export: one JSON object (for indexes that fit a task)."""
        lists = self.postings.groupBy("token").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
        lists = lists.agg(F.map_from_entries(F.collect_list(F.struct("token", "ids"))).alias("token_to_docs"))
        docs = self.docs.agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id"), F.col("document")))).alias("d"))
        one = lists.crossJoin(docs).select(  # one row a side
            F.lit(source).alias("doc_source"),
            F.size("d").alias("doc_count"),
            F.size("token_to_docs").alias("token_count"),
            "token_to_docs",
            F.transform("d", lambda x: F.create_map(F.lit("doc_id"), x["doc_id"].cast("string"))).alias("docs"),
            F.transform("d", lambda x: x["document"]).alias("documents"),
        )
        one.coalesce(1).write.mode("overwrite").json(folder)

    def counts(self) -> DataFrame:
        """One row: documents and distinct tokens."""
        return self.docs.agg(F.count(F.lit(1)).alias("doc_count")).crossJoin(self.postings.agg(F.countDistinct("token").alias("token_count")))

    def search(self, query: str, k: int = DEFAULT_KEYWORD) -> DataFrame:
        """Rows (doc_id, score, ...document): a document scores each query token it holds, a repeated one each time.

        Best first, ties by doc_id, at most max(1, k). The query's few tokens are broadcast to the postings.
        """
        spark = self.postings.sparkSession
        asked = spark.range(1).select(F.explode(tokens(F.lit(query or ""), self.least)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        p = self.postings
        if "bucket" in p.columns:
            words = [r["token"] for r in asked.select("token").collect()]  # of one query
            bucket = spark.createDataFrame([(w,) for w in words], "token string").select(F.pmod(F.xxhash64("token"), F.lit(self.buckets)).cast("int").alias("b"))
            p = p.filter(F.col("bucket").isin([r["b"] for r in bucket.collect()])).drop("bucket")
        elif self.tokens is not None:  # not saved yet: only the query's tokens of a document become rows
            words = F.array(*[F.lit(r["token"]) for r in asked.select("token").collect()]).cast("array<string>")
            p = self.tokens.select("doc_id", F.explode(F.array_intersect("tokens", words)).alias("token"))
        scores = p.join(F.broadcast(asked), "token").groupBy("doc_id").agg(F.sum("n").alias("score"))
        best = scores.orderBy(F.desc("score"), "doc_id").limit(max(1, k))
        return best.join(self.docs, "doc_id").orderBy(F.desc("score"), "doc_id")


def neighbours(vectors: DataFrame, query: list[float], k: int = DEFAULT_VECTOR, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The max(1, k) vectors nearest to one query by squared distance, with column distance; ties by id. Exact: one scan
    and a top-k in each task."""
    return vectors.withColumn("distance", squared_distance(F.col(vector_col), literal(query))).filter("distance is not null").orderBy("distance", id_col).limit(max(1, k))


#: Query vectors that a task holds at a time.
BLOCK = 2_000


def neighbours_of(queries: DataFrame, vectors: DataFrame, k: int, qid: str, vid: str, qvec: str, vvec: str) -> DataFrame:
    """For each query vector its k nearest by squared distance, with distance and rank; ties by vid. Exact.

    The queries, a stated set, meet all vectors in blocks of bounded size. A task reads its vectors batch by batch and keeps
    the best k of each query so far, so it passes on k rows a query; nothing is sorted but these. Vectors of another length,
    and null ones, are no neighbours.
    """
    ensure_workers(queries.sparkSession)
    q = queries.select(F.col(qid).alias("query_id"), F.col(qvec).cast("array<double>").alias("v")).filter("v is not null")
    v = vectors.select(F.col(vid).alias("neighbour_id"), F.col(vvec).cast("array<double>").alias("v")).filter("v is not null")
    n, out = max(1, -(-q.count() // BLOCK)), None
    ids = q.schema["query_id"].dataType.simpleString(), v.schema["neighbour_id"].dataType.simpleString()
    schema = f"query_id {ids[0]}, neighbour_id {ids[1]}, distance double"
    for b in range(n):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else q
        asked = [(r["query_id"], list(r["v"])) for r in part.collect()]  # some BLOCK queries
        found = v.mapInArrow(_nearest(queries.sparkSession.sparkContext.broadcast(asked), max(1, k)), schema)
        order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
        best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, k))
        out = best if out is None else out.unionByName(best)
    return out


def _nearest(asked: Broadcast, k: int):
    """A function over batches (neighbour_id, v): the nearest k of each query among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list[tuple]] = {}
        for key, vector in asked.value:
            by_size.setdefault(len(vector), []).append((key, vector))
        kept = {n: [(np.empty(0), []) for _ in of] for n, of in by_size.items()}
        names, kind = {n: [key for key, _ in of] for n, of in by_size.items()}, None
        matrix = {n: np.array([x for _, x in of], np.float64).reshape(len(of), n) for n, of in by_size.items()}
        for batch in batches:
            kind = batch.schema.field(0).type
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).value_lengths().to_numpy()
            for n, of in matrix.items():
                rows = np.flatnonzero(sizes == n)
                if not len(rows):
                    continue
                some = batch.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
                own = [ids[i] for i in rows.tolist()]
                for j, x in enumerate(of):
                    d = np.zeros(len(rows))
                    for c in range(n):  # in the order of the columns, as a fold sums
                        d += (some[:, c] - x[c]) ** 2
                    few = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                    before, keys = kept[n][j]
                    every = [*zip(before.tolist(), keys, strict=True), *((float(d[i]), own[i]) for i in few.tolist())]
                    every = sorted((e for e in every if e[0] == e[0]), key=lambda e: (e[0], e[1] is not None, e[1]))[:k]
                    kept[n][j] = np.array([e[0] for e in every]), [e[1] for e in every]
        if kind is None:
            return
        rows = [(key, i, d) for n, of in kept.items() for key, (ds, found) in zip(names[n], of, strict=True) for d, i in zip(ds.tolist(), found, strict=True)]
        columns = [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["query_id", "neighbour_id", "distance"])

    return run


@dataclass
class VectorStore:
    """A collection of vectors in a folder that all executors share: rows (id, document, metadata, embedding).

    Inserts append a file set with a version, so a row that is inserted again replaces the one before; reads take the
    newest row of each id.
    """

    spark: SparkSession
    folder: str

    SCHEMA = "id string, document string, metadata string, embedding array<float>, version long"

    def _log(self) -> DataFrame:
        if not doc_lists.has_content(self.spark, self.folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def table(self) -> DataFrame:
        newest = F.max_by(F.struct("document", "metadata", "embedding"), "version").alias("r")
        return self._log().groupBy("id").agg(newest).select("id", "r.*")

    def count(self) -> int:
        return self._log().select("id").distinct().count()

    def insert(self, rows: DataFrame, id_col: str | None = "id", document_col: str = "document", embedding_col: str = "embedding", metadata_col: str | None = None) -> int:
        """Inserts rows, which replace those of the same id; returns how many ids. Without id_col ids are random.

        An empty or null embedding, one of another length than the rest, and a null or repeated id raise ValueError before
        anything is written. Metadata is kept as JSON.
        """
        key = F.col(id_col).cast("string") if id_col else F.expr("uuid()")
        if metadata_col is None:
            meta = F.lit("{}")
        else:
            is_text = rows.schema[metadata_col].dataType.simpleString() == "string"
            meta = F.coalesce(F.col(metadata_col) if is_text else F.to_json(metadata_col), F.lit("{}"))
        made = rows.select(key.alias("id"), F.coalesce(F.col(document_col), F.lit("")).alias("document"), meta.alias("metadata"), F.col(embedding_col).cast("array<float>").alias("embedding"))
        made = checkpointed(made)  # random ids are drawn once
        size = F.coalesce(F.size("embedding"), F.lit(-1))
        seen = made.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min(size).alias("low"), F.max(size).alias("high")).first()
        if not seen["n"]:
            return 0
        if seen["low"] < 1:
            raise ValueError("a row has no embedding")
        if seen["ids"] < seen["n"]:
            raise ValueError("an id is missing or comes twice")
        old = self._log().agg(F.max("version").alias("v"), F.max(F.size("embedding")).alias("size")).first()
        if seen["low"] != seen["high"] or old["size"] not in (None, seen["high"]):
            raise ValueError(f"embeddings have {seen['low']} to {seen['high']} numbers, the collection's {old['size'] or seen['high']}")
        made.withColumn("version", F.lit((old["v"] or 0) + 1).cast("long")).write.mode("append").parquet(self.folder)
        return seen["ids"]

    def search(self, query: list[float], k: int = DEFAULT_VECTOR) -> DataFrame:
        """Rows (id, document, metadata, distance) of the max(1, k) nearest."""
        return neighbours(self.table(), query, k).drop("embedding")


def merged(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = DEFAULT_HYBRID) -> DataFrame:
    """Hits of both kinds merged by key (columns key, document, distance and key, document, score): a hit of both is one
    row, with the vector side's document unless blank. By score (none: 0), then distance (none: last); at most max(1, k)."""
    v = vector_hits.select("key", F.col("document").alias("_vd"), "distance")
    w = keyword_hits.select("key", F.col("document").alias("_kd"), "score")
    both = v.join(w, "key", "full_outer").withColumn("document", F.coalesce(F.nullif("_vd", F.lit("")), F.col("_kd"))).drop("_vd", "_kd")
    return both.orderBy(F.coalesce(-F.col("score").cast("double"), F.lit(0.0)), F.coalesce("distance", F.lit(float("inf"))), "key").limit(max(1, k))


def function_key(vector_id: Column) -> Column:
    """The function id of a vector id (function id, underscore, number)."""
    return F.regexp_replace(vector_id, r"_\d+$", "")


def page_search(pages: DataFrame, query: str, top_k: int = 10, start: int = 1) -> DataFrame:
    """Search over stored pages, in place of a web service: title, link, snippet and host of the best from start on."""
    if not (query or "").strip():
        raise ValueError("the query is empty")
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style).*?</\1>|<[^>]+>", " "), r"\s+", " "))
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("link"), F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), text.alias("document"))
    size, first = min(MOST_WEB, max(1, top_k)), max(1, start)
    hits = KeywordIndex.build(docs).search(query, first + size - 1).offset(first - 1)
    return hits.select("doc_id", "score", "title", "link", F.substring("document", 1, 200).alias("snippet"), F.regexp_extract("link", r"^\w+://([^/?#]+)", 1).alias("display_link"))
