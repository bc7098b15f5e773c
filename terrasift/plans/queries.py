"""The registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import catalog, execute, history, joins, logs, migrate, store
from ..streaming import events
from ..tables import load, register
from . import search
from .registry import ORACLES, QUERIES, query  # noqa: F401

# The data has no geometry: keys give points.
def lon(key: str) -> Column:
    return F.pmod(F.col(key) * 7919, F.lit(36000)).cast("double") / 100.0 - 180.0


def lat(key: str) -> Column:
    return F.pmod(F.col(key) * 104729, F.lit(18000)).cast("double") / 100.0 - 90.0


def _xy(table: str, key: str, prefix: str) -> str:
    return f"(SELECT *, CAST(({key} * 7919) % 36000 AS DOUBLE) / 100.0 - 180.0 AS {prefix}x, CAST(({key} * 104729) % 18000 AS DOUBLE) / 100.0 - 90.0 AS {prefix}y FROM {table})"


CUSTOMERS, SUPPLIERS = _xy("customer", "c_custkey", "c"), _xy("supplier", "s_suppkey", "s")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").withColumn("cx", lon("c_custkey")).withColumn("cy", lat("c_custkey"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").withColumn("sx", lon("s_suppkey")).withColumn("sy", lat("s_suppkey"))


# Retrieval.

KEYWORDS = "the then the of"
_tokens = "regexp_extract_all(lower({}), '[a-zA-Z_][a-zA-Z0-9_]*')"
_postings = f"SELECT doc_id, unnest(list_distinct(list_filter({_tokens.format('text')}, lambda t: length(t) >= 2))) AS token FROM documents"


@query(f"""
WITH p AS ({_postings}), q AS (SELECT unnest(['the', 'then', 'the', 'of']) AS token),
a AS (SELECT token, count(*) AS n FROM q GROUP BY token)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS score FROM p JOIN a USING (token) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10
""")
def keyword_search_topk(spark: SparkSession, d: str) -> DataFrame:
    index = search.KeywordIndex.build(load(spark, d, "documents").select("doc_id", "text"), text_col="text")
    return index.search(KEYWORDS, 10).select("doc_id", "score")


@query(f"WITH p AS ({_postings}) SELECT token, count(*) AS df FROM p GROUP BY token")
def keyword_postings_df(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(load(spark, d, "documents"), text_col="text").groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH p AS ({_postings}) SELECT token, doc_id // 65536 AS segment, count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM p GROUP BY 1, 2")
def keyword_posting_segments(spark: SparkSession, d: str) -> DataFrame:
    s = search.posting_segments(load(spark, d, "documents"), text_col="text")
    return s.select("token", "segment", F.size("doc_ids").cast("bigint").alias("n"), F.element_at("doc_ids", 1).alias("low"), F.element_at("doc_ids", -1).alias("high"))


@query(f"""
WITH p AS ({_postings}) SELECT token, doc_id // 65536 AS segment, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS doc_ids
FROM p
GROUP BY 1, 2
""")
def keyword_postings_lists(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every token, however common, by bounded segments."""
    s = search.posting_segments(load(spark, d, "documents"), text_col="text")
    return s.select("token", "segment", F.size("doc_ids").cast("bigint").alias("n"), F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"))


@query(f"WITH p AS ({_postings}) SELECT (SELECT count(*) FROM documents) AS doc_count, (SELECT count(DISTINCT token) FROM p) AS token_count")
def keyword_index_counts(spark: SparkSession, d: str) -> DataFrame:
    return search.KeywordIndex.build(load(spark, d, "documents").select("doc_id", "text"), text_col="text").counts()


_sq = "list_sum(list_transform(range(1, 65), lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))))"


@query(f"""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round({_sq.format(a='v.embedding', b='q.e')}, 6) AS distance FROM embeddings v, q
ORDER BY {_sq.format(a='v.embedding', b='q.e')}, vec_id LIMIT 5
""")
def vector_knn(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    asked = vectors.filter("vec_id = 7").select("embedding").first()[0]
    return search.neighbours(vectors, list(asked), 5, "vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""
WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, {_sq.format(a='v.embedding', b='q.embedding')} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT query_id, neighbour_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def vector_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The query set of every 20th vector against all vectors: the nearest five of each."""
    vectors = load(spark, d, "embeddings")
    found = search.neighbours_of(vectors.filter("vec_id % 20 = 0"), vectors, 5, "vec_id", "vec_id", "embedding", "embedding")
    return found.withColumn("distance", F.round("distance", 6))


@query(f"""
WITH p AS ({_postings}), k AS (SELECT doc_id AS key, CAST(count(*) AS BIGINT) AS score FROM p WHERE token IN ('the', 'and') GROUP BY doc_id ORDER BY score DESC, key LIMIT 20),
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3),
v AS (SELECT vec_id AS key, {_sq.format(a='x.embedding', b='q.e')} AS distance FROM embeddings x, q ORDER BY distance, key LIMIT 20)
SELECT coalesce(v.key, k.key) AS key, score, round(distance, 6) AS distance FROM v FULL JOIN k ON v.key = k.key
ORDER BY coalesce(-CAST(score AS DOUBLE), 0.0), coalesce(v.distance, CAST('inf' AS DOUBLE)), coalesce(v.key, k.key) LIMIT 30
""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    docs, vectors = load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "embeddings")
    asked = vectors.filter("vec_id = 3").select("embedding").first()[0]
    v = search.neighbours(vectors, list(asked), 20, "vec_id").select(F.col("vec_id").alias("key"), F.lit("").alias("document"), "distance")
    k = search.KeywordIndex.build(docs, text_col="text").search("the and", 20).select(F.col("doc_id").alias("key"), "document", "score")
    return search.merged(v, k, 30).select("key", "score", F.round("distance", 6).alias("distance"))


@query("""
WITH t AS (SELECT page_id AS doc_id, list_distinct(list_filter(regexp_extract_all(lower(trim(regexp_replace(regexp_replace(html, '<(script|style).*?</(script|style)>|<[^>]+>', ' ', 'gis'), '\\s+', ' ', 'g'))), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda t: length(t) >= 2)) AS w, url FROM pages)
SELECT doc_id, CAST((list_contains(w, 'the'))::INT + (list_contains(w, 'example'))::INT AS BIGINT) AS score, regexp_extract(url, '^\\w+://([^/?#]+)', 1) AS display_link
FROM t WHERE list_contains(w, 'the') OR list_contains(w, 'example') ORDER BY score DESC, doc_id LIMIT 10
""")
def page_search(spark: SparkSession, d: str) -> DataFrame:
    return search.page_search(load(spark, d, "pages"), "the example", 10).select("doc_id", "score", "display_link")


@query("SELECT doc_id FROM documents WHERE contains(text, 'Licensed under')")
def substring_contains(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter(F.contains("text", F.lit("Licensed under"))).select("doc_id")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_sha256(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


# Space.


@query(f"""
SELECT s_suppkey, s_name, round(sqrt((sx - a.cx) * (sx - a.cx) + (sy - a.cy) * (sy - a.cy)), 6) AS distance
FROM {SUPPLIERS} s, (SELECT cx, cy
FROM {CUSTOMERS}
WHERE c_custkey = 42) a
ORDER BY distance, s_suppkey LIMIT 5
""")
def nearest_supplier(spark: SparkSession, d: str) -> DataFrame:
    """An anchor by key, then the nearest of the other table by the distance that is shown."""
    a = customers(spark, d).filter("c_custkey = 42").select("cx", "cy").first()
    near = joins.nearest_to(suppliers(spark, d), (a["cx"], a["cy"]), ("sx", "sy"), 5, ["s_suppkey"], digits=6)
    return near.select("s_suppkey", "s_name", "distance")


@query(f"""
WITH d AS (SELECT c_custkey, s_suppkey, sqrt((sx - cx) * (sx - cx) + (sy - cy) * (sy - cy)) AS distance FROM {CUSTOMERS} c, {SUPPLIERS} s),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) AS rank FROM d)
SELECT c_custkey, s_suppkey, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2
""")
def nearest_join(spark: SparkSession, d: str) -> DataFrame:
    out = joins.nearest_join(customers(spark, d), suppliers(spark, d), ("cx", "cy"), ("sx", "sy"), "c_custkey", "s_suppkey", 2)
    return out.select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"), "rank")


@query(f"""
SELECT c_custkey, s_suppkey, round(sqrt((sx - cx) * (sx - cx) + (sy - cy) * (sy - cy)), 6) AS distance
FROM {CUSTOMERS} c, {SUPPLIERS} s
WHERE sqrt((sx - cx) * (sx - cx) + (sy - cy) * (sy - cy)) <= 5.0
""")
def distance_join_grid(spark: SparkSession, d: str) -> DataFrame:
    out = joins.within_distance(suppliers(spark, d), customers(spark, d), ("sx", "sy"), ("cx", "cy"), 5.0)
    return out.select("c_custkey", "s_suppkey", F.round("distance", 6).alias("distance"))


_hav = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(sy) - radians(cy)) / 2), 2) + cos(radians(cy)) * cos(radians(sy)) * pow(sin((radians(sx) - radians(cx)) / 2), 2))))"


@query(f"SELECT c_custkey, s_suppkey, round({_hav}, 2) AS metres FROM {CUSTOMERS} c, {SUPPLIERS} s WHERE {_hav} <= 400000")
def distance_join_sphere(spark: SparkSession, d: str) -> DataFrame:
    out = joins.within_sphere(suppliers(spark, d), customers(spark, d), ("sx", "sy"), ("cx", "cy"), 400_000.0)
    return out.select("c_custkey", "s_suppkey", F.round("distance", 2).alias("metres"))


@query(f"""
SELECT c_custkey, round(sqrt((cx - 10.0) * (cx - 10.0) + (cy + 20.0) * (cy + 20.0)), 6) AS planar, round(2 * 6371008.8 * asin(least(1.0,
  sqrt(pow(sin((radians(-20.0) - radians(cy)) / 2), 2) + cos(radians(cy)) * cos(radians(-20.0)) * pow(sin((radians(10.0) - radians(cx)) / 2), 2)))), 2) AS sphere
FROM {CUSTOMERS}
""")
def distances_to_point(spark: SparkSession, d: str) -> DataFrame:
    x, y, ax, ay = F.col("cx"), F.col("cy"), F.lit(10.0), F.lit(-20.0)
    return customers(spark, d).select("c_custkey", F.round(G.planar_distance(x, y, ax, ay), 6).alias("planar"), F.round(G.sphere_distance(x, y, ax, ay), 2).alias("sphere"))


@query(f"SELECT c_custkey FROM {CUSTOMERS} WHERE cx BETWEEN -10 AND 40 AND cy BETWEEN -30 AND 30")
def point_in_bbox(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).filter(G.in_box(F.col("cx"), F.col("cy"), (-10, -30, 40, 30))).select("c_custkey")


TRIANGLE = [(-100.0, -60.0), (120.0, -40.0), (10.0, 80.0)]


def _edge(a: tuple[float, float], b: tuple[float, float]) -> str:
    return f"CAST((({a[1]} > cy) <> ({b[1]} > cy)) AND cx < ({b[0] - a[0]}) * (cy - ({a[1]})) / ({b[1] - a[1]}) + ({a[0]}) AS INTEGER)"


@query(f"SELECT c_custkey FROM {CUSTOMERS} WHERE ({' + '.join(_edge(a, b) for a, b in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1], strict=True))}) % 2 = 1")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).filter(G.in_polygon(F.col("cx"), F.col("cy"), TRIANGLE)).select("c_custkey")


@query(f"SELECT c_custkey FROM {CUSTOMERS} WHERE ({' + '.join(_edge(a, b) for a, b in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1], strict=True))}) % 2 = 1")
def geometry_contains(spark: SparkSession, d: str) -> DataFrame:
    """The polygon as WKT, through the geometry functions; the box prunes before Python sees a row."""
    wkt = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*TRIANGLE, TRIANGLE[0]]) + "))"
    boxed = customers(spark, d).filter(G.in_box(F.col("cx"), F.col("cy"), (-100, -60, 120, 80)))
    return boxed.filter(G.st_contains_point(G.geomfromtext(F.lit(wkt)), "cx", "cy")).select("c_custkey")


@query("SELECT n_nationkey, CAST((n_nationkey + 1) * (n_nationkey + 2) AS DOUBLE) AS area, CAST(2 * (n_nationkey + 1) + 3 AS DOUBLE) AS road FROM nation")
def polygon_area_length(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    box = F.format_string("POLYGON ((0 0, %d 0, %d %d, 0 %d, 0 0))", k + 1, k + 1, k + 2, k + 2)
    line = F.format_string("LINESTRING (0 0, %d 0, %d 3, 0 3)", k + 1, k + 1)
    return load(spark, d, "nation").select("n_nationkey", G.st_area(G.geomfromtext(box)).alias("area"), G.st_length(G.geomfromtext(line)).alias("road"))


@query(f"""
WITH m AS (SELECT s_suppkey, radians(sx) * 6378137.0 AS mx, 6378137.0 * ln(tan(pi() / 4 + radians(sy) / 2)) AS my FROM {SUPPLIERS} WHERE abs(sy) < 85)
SELECT s_suppkey, round(mx, 3) AS mx, round(my, 3) AS my, round(degrees(mx / 6378137.0), 6) AS lon, round(degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2), 6) AS lat FROM m
""")
def mercator_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    mx, my = G.to_mercator(F.col("sx"), F.col("sy"))
    m = suppliers(spark, d).filter(F.abs("sy") < 85).select("s_suppkey", mx.alias("mx"), my.alias("my"))
    x, y = G.from_mercator(F.col("mx"), F.col("my"))
    return m.select("s_suppkey", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round(x, 6).alias("lon"), F.round(y, 6).alias("lat"))


@query("""
SELECT s_suppkey, 'POINT (' || CAST((s_suppkey * 7919) % 36000 AS VARCHAR) || ' ' || CAST((s_suppkey * 104729) % 18000 AS VARCHAR) || ')' AS wkt, 'POINT' AS kind
FROM supplier
""")
def wkt_points(spark: SparkSession, d: str) -> DataFrame:
    """Whole coordinates, through WKB and back."""
    x, y = F.pmod(F.col("s_suppkey") * 7919, F.lit(36000)).cast("double"), F.pmod(F.col("s_suppkey") * 104729, F.lit(18000)).cast("double")
    made = load(spark, d, "supplier").select("s_suppkey", G.point_wkb(x, y).alias("geometry"))
    return made.select("s_suppkey", G.astext("geometry").alias("wkt"), G.geometry_type("geometry").alias("kind"))


# Execution, catalog, pages.


@query("""
SELECT *
FROM (SELECT 'customer' AS name, count(*) AS n
FROM customer
UNION ALL SELECT 'events', count(*)
FROM events
UNION ALL SELECT 'lineitem', count(*)
FROM lineitem
UNION ALL SELECT 'nation', count(*)
FROM nation
UNION ALL SELECT 'orders', count(*)
FROM orders
UNION ALL SELECT 'part', count(*)
FROM part
UNION ALL SELECT 'region', count(*)
FROM region
UNION ALL SELECT 'supplier', count(*)
FROM supplier)
""")
def table_rowcounts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"):
        one = load(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_type AS value, count(*) AS freq FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY freq DESC, value LIMIT 5")
def topk_distinct(spark: SparkSession, d: str) -> DataFrame:
    return catalog.top_distinct(load(spark, d, "part"), "p_type", 5)


@query("SELECT p_brand AS value, count(*) AS freq FROM part GROUP BY 1 ORDER BY freq DESC, value LIMIT 20")
def category_profile(spark: SparkSession, d: str) -> DataFrame:
    return catalog.category_profile(load(spark, d, "part"), "p_brand", 20)


@query("SELECT c_name, 2 AS match_rank FROM customer WHERE lower(c_name) = lower((SELECT max(c_name) FROM customer)) ORDER BY c_name LIMIT 5")
def entity_match(spark: SparkSession, d: str) -> DataFrame:
    """An entity that only differs in case."""
    customers = load(spark, d, "customer")
    name = customers.agg(F.max("c_name")).first()[0]
    return catalog.matches(customers, "c_name", name.swapcase()).select("c_name", "match_rank")


@query("SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def sample_page(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    return execute.page_rows(orders, 3, 20, ["o_orderkey"]).crossJoin(F.broadcast(total))  # one row


@query("""
SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent
FROM orders
WHERE o_totalprice > 1000
GROUP BY o_custkey
ORDER BY o_custkey LIMIT 25 OFFSET 25
""")
def sql_page(spark: SparkSession, d: str) -> DataFrame:
    """A guarded statement with binds, paged."""
    own = spark.newSession()
    register(own, d, ["orders"])
    df = execute.query(own, "/* spend */ SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_totalprice > :least GROUP BY o_custkey;", {"least": 1000})
    page = execute.page_rows(df, 2, 25, ["o_custkey"])
    return page


@query("SELECT l_orderkey, l_linenumber, (SELECT count(*) > 50 FROM lineitem) AS truncated FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50")
def truncated_fetch(spark: SparkSession, d: str) -> DataFrame:
    ranked, most = execute.capped(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber"), 50)
    cut = ranked.agg((F.count(F.lit(1)) > most).alias("truncated"))
    return ranked.orderBy("l_orderkey", "l_linenumber").limit(most).crossJoin(F.broadcast(cut))  # one row


# Logs and history.


@query("""
SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded,
  CAST(count(*) FILTER (event_type <> 'error') AS DOUBLE) / count(*) AS success_rate, round(avg(value), 6) AS avg_latency
FROM events
""")
def exec_log_summary(spark: SparkSession, d: str) -> DataFrame:
    s = logs.summary(load(spark, d, "events"), F.col("event_type") != "error", F.col("value"))
    return s.withColumn("avg_latency", F.round("avg_latency", 6))


@query("""
SELECT event_id, ts, user_id, value
FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND event_type ILIKE 'c%' AND value >= 1.5
ORDER BY ts DESC, event_id DESC
""")
def exec_log_filter(spark: SparkSession, d: str) -> DataFrame:
    names = {"insert_time": "ts", "sql_text": "event_type", "execution_time_ms": "value", "id": "event_id"}
    since = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return logs.filtered(load(spark, d, "events"), since=since, like="C%", least_ms=1.5, columns=names).select("event_id", "ts", "user_id", "value")


@query("""
SELECT (SELECT count(*)
FROM customer) AS users, (SELECT count(*)
FROM events) AS executions, (SELECT count(DISTINCT conv_id)
FROM conversations) AS sessions, (SELECT count(*)
FROM conversations) AS messages, (SELECT count(*)
FROM conversations
WHERE role = 'user') AS questions
""")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "conversations")
    return logs.overview({"users": load(spark, d, "customer"), "executions": load(spark, d, "events"), "sessions": c.select("conv_id").distinct(), "messages": c, "questions": c.filter("role = 'user'")})


@query("SELECT count(*) FILTER (role = 'user') AS questions FROM conversations")
def role_user_count(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").agg(F.count_if(F.col("role") == "user").alias("questions"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def latest_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(load(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""
SELECT conv_id, turn, role
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
ORDER BY turn DESC) AS r
FROM conversations
WHERE role <> 'system')
WHERE r <= 3
""")
def last_n_turns(spark: SparkSession, d: str) -> DataFrame:
    return history.last_turns(load(spark, d, "conversations"), "conv_id", "turn", 3, F.col("role") != "system").select("conv_id", "turn", "role")


@query("""
SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id
ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS request_id
FROM conversations
""")
def request_id_inherit(spark: SparkSession, d: str) -> DataFrame:
    return history.request_ids(load(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "request_id")


_cut = "CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000) || chr(10) || '...[stream truncated]' ELSE text END"


@query(f"""
WITH c AS (SELECT conv_id, turn, {_cut} AS t FROM conversations WHERE trim(text) <> ''),
p AS (SELECT conv_id, turn, t, unnest(range(0, least(200, CAST(ceil(length(t) / 200.0) AS BIGINT)))) AS i FROM c)
SELECT conv_id, turn, CAST(i AS INTEGER) AS chunk_index, substr(t, CAST(i * 200 + 1 AS BIGINT), 200) AS delta, false AS is_final_chunk FROM p
UNION ALL SELECT conv_id, turn, CAST(least(200, CAST(ceil(length(t) / 200.0) AS BIGINT)) AS INTEGER), '', true FROM c
""")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return events.text_chunks(load(spark, d, "conversations"), ["conv_id", "turn"], "text")


@query(f"SELECT conv_id, turn, sha256({_cut}) AS digest FROM conversations WHERE trim(text) <> ''")
def chunk_reassembly(spark: SparkSession, d: str) -> DataFrame:
    pieces = events.text_chunks(load(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return history.joined(pieces, ["conv_id", "turn"], "chunk_index", "delta").select("conv_id", "turn", F.sha2("text", 256).alias("digest"))


@query("""
WITH s AS (SELECT conv_id, turn, unnest(range(1, greatest(1, CAST(ceil(length(text) / 40.0) AS BIGINT)) + 1)) AS seq, text FROM conversations),
c AS (SELECT conv_id, turn, CAST(seq AS INTEGER) AS seq, substr(text, 1, seq * 40) AS t FROM s),
l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id, turn ORDER BY seq) AS p FROM c)
SELECT conv_id, turn, seq, CASE WHEN p IS NULL THEN t WHEN starts_with(t, p) THEN substr(t, CAST(length(p) + 1 AS BIGINT)) ELSE t END AS delta FROM l
""")
def delta_from_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots that grow by 40 characters, up to the whole text, and what each adds."""
    last = F.greatest(F.lit(1), F.ceil(F.char_length("text") / 40).cast("int"))
    grown = load(spark, d, "conversations").select("conv_id", "turn", F.explode(F.sequence(F.lit(1), last)).alias("seq"), "text")
    grown = grown.withColumn("t", F.substring(F.col("text"), F.lit(1), F.col("seq") * 40)).withColumn("stream", F.struct("conv_id", "turn"))
    return history.deltas(grown, "stream", "seq", "t").select("conv_id", "turn", "seq", "delta")


# Joins and sets.


@query("""
SELECT count(*) FILTER (c.c_custkey IS NOT NULL) AS found, count(*) FILTER (c.c_custkey IS NULL) AS orphans
FROM orders o
LEFT
JOIN customer c ON o.o_custkey = c.c_custkey
""")
def orphan_fk_check(spark: SparkSession, d: str) -> DataFrame:
    o, c = load(spark, d, "orders"), load(spark, d, "customer")
    semi = o.join(c, o.o_custkey == c.c_custkey, "left_semi").agg(F.count(F.lit(1)).alias("found"))
    return semi.crossJoin(store.orphans(o, "o_custkey", c, "c_custkey").agg(F.count(F.lit(1)).alias("orphans")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def null_aware_not_in(spark: SparkSession, d: str) -> DataFrame:
    own = spark.newSession()
    register(own, d, ["customer", "orders"])
    return execute.query(own, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")


@query("""
SELECT r_regionkey, r_name, array_to_string(list_sort(list(n_name)), ',') AS nations
FROM region
JOIN nation ON r_regionkey = n_regionkey
GROUP BY 1, 2
""")
def one_to_many_collect(spark: SparkSession, d: str) -> DataFrame:
    r, n = load(spark, d, "region"), load(spark, d, "nation")
    per = n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))
    return r.join(per, r.r_regionkey == per.n_regionkey).select("r_regionkey", "r_name", "nations")


@query("SELECT * FROM (VALUES (1, '1_2'), (2, '1_10'), (3, '2'), (4, '10_0_1')) t(place, version)")
def pending_versions(spark: SparkSession, d: str) -> DataFrame:
    schema = "version string, script_name string, checksum string"
    mine = spark.createDataFrame([(v, f"V{v}__x.sql", "c") for v in ("10_0_1", "1_10", "1", "2", "1_2")], schema)
    left = migrate.pending(mine, spark.createDataFrame([("1", "V1__x.sql", "c")], schema))
    return left.select(F.row_number().over(Window.orderBy(migrate.version_order(F.col("version")))).alias("place"), "version")


@query("SELECT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) ORDER BY name")
def union_sorted_objects(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_name").alias("name")).union(load(spark, d, "region").select("r_name")).distinct().orderBy("name")


@query("""
SELECT 'both' AS kind, c_nationkey AS nationkey
FROM (SELECT c_nationkey
FROM customer INTERSECT SELECT s_nationkey
FROM supplier)
UNION ALL SELECT 'customers', c_nationkey
FROM (SELECT c_nationkey
FROM customer EXCEPT SELECT s_nationkey
FROM supplier)
""")
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    c, s = load(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")), load(spark, d, "supplier").select("s_nationkey")
    return c.intersect(s).select(F.lit("both").alias("kind"), "nationkey").unionByName(c.subtract(s).select(F.lit("customers").alias("kind"), "nationkey"))


@query("""
SELECT e.event_id, l.event_id AS before_id
FROM events e ASOF
LEFT
JOIN (SELECT *
FROM events
WHERE event_type = 'purchase') l ON e.user_id = l.user_id AND e.ts > l.ts
""")
def asof_purchase(spark: SparkSession, d: str) -> DataFrame:
    """For each event the user's last purchase before it: one window, no join."""
    e = load(spark, d, "events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    return e.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("before_id"))


# Questions and JSON.


@query("""
WITH q AS (SELECT conv_id, turn, text || ' Find hotels near Blue Lake' AS t FROM conversations)
SELECT conv_id, turn,
  contains(lower(t), 'nearest') OR contains(lower(t), 'closest') OR contains(lower(t), 'near') AS nearest,
  array_to_string(list_filter(['within', 'distance', 'near', 'intersects', 'buffer', 'area', 'length', 'dwithin', 'closest', 'nearest'], lambda w: contains(lower(t), w)), ',') AS signals,
  array_to_string(list_filter(['restaurant', 'cafe', 'bar', 'hotel', 'hospital', 'school', 'bank', 'pharmacy', 'station', 'park', 'museum', 'supermarket'], lambda c: regexp_matches(lower(t), '(^|[^a-z0-9_])' || c || 's?($|[^a-z0-9_])')), ',') AS categories
FROM q
""")
def question_features(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("text", F.lit(" Find hotels near Blue Lake"))
    return load(spark, d, "conversations").select("conv_id", "turn", X.asks_nearest(t).alias("nearest"), F.array_join(X.spatial_words(t), ",").alias("signals"), F.array_join(X.categories(t), ",").alias("categories"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# Aggregates, windows and time.

_disc = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(28,2))"


def _price() -> Column:
    return F.col("l_extendedprice").cast("decimal(18,2)")


@query(f"""
SELECT l_returnflag, l_linestatus, CAST(sum({_disc}) AS DECIMAL(28,2)) AS total, count(*) AS n
FROM lineitem
GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def rollup_pricing(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum(_price()).cast("decimal(28,2)").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT l_returnflag, l_linestatus, CAST(sum({_disc}) AS DECIMAL(28,2)) AS total, count(*) AS n
FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def cube_pricing(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum(_price()).cast("decimal(28,2)").alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return load(spark, d, "orders").groupingSets([[s], [p], []], s, p).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_custkey, o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, lag(o_orderkey) OVER w AS before_key,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def window_rank_frame(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.lag("o_orderkey").over(w).alias("before_key"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(load(spark, d, "events"), "ts", "1 hour", ["event_type"]).select("window_start", "event_type", "n")


@query("""
SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1
""")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.tumbling(load(spark, d, "events"), "ts", "1 hour", [], slide="30 minutes").select("window_start", "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_counts(spark: SparkSession, d: str) -> DataFrame:
    return events.sessions(load(spark, d, "events"), "ts", "2 hours", ["user_id"]).select("user_id", "session_start", "n")


_rev = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"


def _revenue() -> Column:
    return F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))


@query(f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, CAST(sum({_rev}) AS DECIMAL(28,4)) AS revenue,
  round(avg(l_discount), 6) AS discount, count(*) AS n
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02'
GROUP BY 1, 2
""")
def tpch_q1(spark: SparkSession, d: str) -> DataFrame:
    kept = load(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.sum(_revenue()).cast("decimal(28,4)").alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT l_orderkey, CAST(sum({_rev}) AS DECIMAL(28,4)) AS revenue, o_orderdate
FROM customer
JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15'
GROUP BY l_orderkey, o_orderdate
ORDER BY revenue DESC, l_orderkey LIMIT 10
""")
def tpch_q3(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("1996-03-15").cast("timestamp_ntz")
    c = load(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = load(spark, d, "orders").filter(F.col("o_orderdate") < day).select("o_orderkey", "o_custkey", "o_orderdate")
    li = load(spark, d, "lineitem").filter(F.col("l_shipdate") > day)
    found = li.join(o.join(c, o.o_custkey == c.c_custkey, "left_semi"), li.l_orderkey == o.o_orderkey)
    return found.groupBy("l_orderkey", "o_orderdate").agg(F.sum(_revenue()).cast("decimal(28,4)").alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query(f"""
SELECT n_name, CAST(sum({_rev}) AS DECIMAL(28,4)) AS revenue
FROM customer
JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE r_name = (SELECT min(r_name)
FROM region)
GROUP BY n_name
""")
def tpch_q5(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "region")
    first = r.agg(F.min("r_name").alias("m"))
    n = load(spark, d, "nation").join(r.join(first, r.r_name == first.m, "left_semi"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = load(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    found = li.join(s, li.l_suppkey == s.s_suppkey).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return found.groupBy("n_name").agg(F.sum(_revenue()).cast("decimal(28,4)").alias("revenue"))


@query("""
SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(28,4)) AS revenue
FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""")
def tpch_q6(spark: SparkSession, d: str) -> DataFrame:
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    kept = load(spark, d, "lineitem").filter((F.col("l_shipdate") >= t("1996-01-01")) & (F.col("l_shipdate") < t("1997-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return kept.agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(28,4)").alias("revenue"))


@query(f"""
SELECT c_custkey, c_name, n_name, CAST(sum({_rev}) AS DECIMAL(28,4)) AS revenue
FROM customer
JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R'
GROUP BY 1, 2, 3
ORDER BY revenue DESC, c_custkey LIMIT 20
""")
def tpch_q10(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter("l_returnflag = 'R'")
    per = li.join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum(_revenue()).cast("decimal(28,4)").alias("revenue"))
    named = per.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_custkey", "c_name", "n_name", "revenue").orderBy(F.desc("revenue"), "c_custkey").limit(20)


# The other registered queries.
from . import queries_catalog, queries_flow, queries_space, queries_store, queries_text  # noqa: E402, F401
