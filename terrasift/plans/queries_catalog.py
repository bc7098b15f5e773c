"""Registered queries over catalogs: objects, columns, keys, statements, estimates, candidates and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import catalog, execute
from ..tables import load, register
from .registry import query

TABLES = ("customer", "nation", "region", "supplier")
_types = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE lower(column_type) END"
_described = " UNION ALL ".join(f"SELECT '{t}' AS object, row_number() OVER () - 1 AS position, column_name, column_type FROM (DESCRIBE {t})" for t in TABLES)


def _session(spark: SparkSession, d: str, tables: tuple[str, ...] = TABLES) -> SparkSession:
    own = spark.newSession()
    register(own, d, list(tables))
    return own


def _outcome(call) -> str:
    try:
        return str(call())
    except (ValueError, LookupError) as e:
        return type(e).__name__


def _moved(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows of the driver's size, from a session of their own to this one."""
    return spark.createDataFrame([tuple(r) for r in df.collect()], df.schema)


@query(f"SELECT object, CAST(position AS INTEGER) AS position, column_name AS name, {_types} AS data_type FROM ({_described})")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the session's tables, in order, with its type."""
    own = _session(spark, d)
    found = catalog.columns(own).filter(F.col("table").isin(*TABLES))
    return _moved(spark, found.select(F.col("table").alias("object"), "position", "name", "data_type"))


@query(f"""
SELECT object, string_agg(column_name || ':' || {_types}, ',' ORDER BY position) AS columns,
  CASE object WHEN 'nation' THEN 'fk n_regionkey region r_regionkey' WHEN 'region' THEN 'pk r_regionkey' ELSE '' END AS keys
FROM ({_described}) GROUP BY object
""")
def catalog_introspection(spark: SparkSession, d: str) -> DataFrame:
    """Tables with their columns and the keys declared for them, joined by name."""
    own = _session(spark, d)
    keys = catalog.declare_keys(own, [(None, "nation", "fk", ["n_regionkey"], "region", ["r_regionkey"]), (None, "region", "pk", ["r_regionkey"], None, None)])
    found = catalog.introspect(own, keys=keys).filter(F.col("table").isin(*TABLES))
    listed = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["name"], c["data_type"])), ",")
    known = F.array_join(F.transform("keys", lambda k: F.concat_ws(" ", k["kind"], F.array_join(k["columns"], "+"), k["refers_table"], F.array_join(k["refers_columns"], "+"))), ";")
    return _moved(spark, found.select(F.col("table").alias("object"), listed.alias("columns"), F.coalesce(known, F.lit("")).alias("keys")))


_kinds = "SELECT name, kind FROM (VALUES " + ", ".join(f"('{t}', 'view')" for t in TABLES) + ", ('made', 'view')) v(name, kind)"


@query(f"""
SELECT name, kind, CASE WHEN name = 'made' THEN 'CREATE TEMPORARY VIEW `made` (`n` int);' ELSE '' END AS ddl,
  CASE WHEN name = 'made' THEN 'n:int' ELSE '' END AS columns
FROM ({_kinds})
""")
def catalog_objects(spark: SparkSession, d: str) -> DataFrame:
    """Names and types of objects, the statement that makes one, and its columns."""
    own = _session(spark, d)
    own.sql("SELECT 1 AS n").createOrReplaceTempView("made")
    out = []
    for r in catalog.objects(own).filter(F.col("name").isin(*TABLES, "made")).collect():
        mine = r["name"] == "made"
        listed = ",".join(":".join(c) for c in catalog.object_columns(own, "made")) if mine else ""
        out.append((r["name"], r["type"], catalog.ddl(own, "made") if mine else "", listed))
    return spark.createDataFrame(out, "name string, kind string, ddl string, columns string")


@query("""
SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'LookupError' WHEN 2 THEN 'ValueError' WHEN 3 THEN 'LookupError' ELSE 'ValueError' END AS outcome FROM nation
""")
def catalog_access(spark: SparkSession, d: str) -> DataFrame:
    """Objects are reached by identifiers of their kind alone: what is missing, of another kind, or no identifier is refused."""
    own, out = _session(spark, d), []
    for r in load(spark, d, "nation").orderBy("n_nationkey").collect():
        k = r["n_nationkey"]
        call = [
            lambda: catalog.object_type(own, "nation"),
            lambda k=k: catalog.object_type(own, f"nothing_{k}"),
            lambda: catalog.object_type(own, "nation; DROP TABLE x"),
            lambda: catalog.object_columns(own, "nation", expected="table"),
            lambda: catalog.object_columns(own, "nation", expected="index"),
        ][k % 5]
        out.append((k, _outcome(call)))
    return spark.createDataFrame(out, "k int, outcome string")


_counted = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("customer", "lineitem", "orders"))


@query(f"SELECT name, n AS estimate, 'statistics' AS how, n AS counted FROM ({_counted})")
def row_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of analysed tables by their statistics, and of views by counting."""
    from ..shared import fresh_path

    schema, out = "e_" + fresh_path(spark, "estimates").rsplit("-", 1)[1], []
    spark.sql(f"CREATE DATABASE {schema}")
    try:
        for name in ("customer", "lineitem", "orders"):
            load(spark, d, name).write.saveAsTable(f"{schema}.{name}")
            spark.sql(f"ANALYZE TABLE {schema}.{name} COMPUTE STATISTICS")
            rows, how = catalog.estimated_rows(spark, name, schema)
            own = _session(spark, d, (name,))
            out.append((name, rows, how, catalog.estimated_rows(own, name)[0]))
        assert schema in catalog.schemas(spark)
    finally:
        spark.sql(f"DROP DATABASE {schema} CASCADE")
    return spark.createDataFrame(out, "name string, estimate long, how string, counted long")


@query("SELECT * FROM (VALUES ('anchors', true, false), ('plain', false, false), ('targets', false, true)) t(name, anchor, target)")
def spatial_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tables with a name or a category beside a geometry can be anchors or targets."""
    own = spark.newSession()
    c = load(own, d, "customer")
    point = G.point_wkb(F.col("c_custkey").cast("double"), F.lit(0.0))
    c.select(F.col("c_name").alias("place_name"), point.alias("geometry")).createOrReplaceTempView("anchors")
    c.select(F.col("c_mktsegment").alias("fclass"), point.alias("geom")).createOrReplaceTempView("targets")
    c.select("c_name", "c_mktsegment").createOrReplaceTempView("plain")
    found = catalog.candidates(catalog.columns(own).filter(F.col("table").isin("anchors", "targets", "plain")))
    return _moved(spark, found.select(F.col("table").alias("name"), "anchor", "target"))


@query("""
SELECT 'nation' AS object, 'n_regionkey' AS name, 'region' AS refers_table, 'r_regionkey' AS refers_column, 'many-to-one' AS cardinality
WHERE (SELECT count(*)
FROM nation
LEFT
JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey IS NULL) = 0
""")
def join_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Columns that may refer to another table's key, by name and type, and how many rows a value would find."""
    frames = {t: load(spark, d, t) for t in ("nation", "region")}
    found = catalog.join_options(spark, frames, {"region": "r_regionkey"})
    return found.select(F.col("table").alias("object"), F.col("column").alias("name"), "refers_table", "refers_column", "cardinality")


@query("""
SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*)
FROM orders) AS total, CAST(ceil((SELECT count(*)
FROM orders) / 7.0) AS INTEGER) AS pages, 7 AS on_page
FROM orders
ORDER BY o_orderkey LIMIT 7 OFFSET 14
""")
def table_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a table in a stable order, with the counts of all rows and pages."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    page = execute.page_of(orders, 3, 7, ["o_orderkey"])
    rows = [(r["o_orderkey"], r["o_custkey"], r["o_totalprice"], page.total, page.total_pages, page.page_row_count) for r in page.rows]
    return spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, total long, pages int, on_page int")


@query("SELECT n_regionkey AS k, count(*) AS n, 2 AS total, true AS scanned, 'ValueError' AS refused FROM nation WHERE n_regionkey < 2 GROUP BY 1")
def paged_in_schema(spark: SparkSession, d: str) -> DataFrame:
    """A page of a statement whose names are looked up in one schema, its plan, and a statement that has no pages."""
    from ..shared import fresh_path

    schema = "s_" + fresh_path(spark, "schema").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {schema}")
    try:
        load(spark, d, "nation").write.saveAsTable(f"{schema}.lands")
        sql = "SELECT n_regionkey AS k, count(*) AS n FROM lands WHERE n_regionkey < :most GROUP BY n_regionkey"
        page = execute.sql_page(spark, sql, 1, 10, {"most": 2}, ["k"], schema)
        plan = "\n".join(execute.explain(spark, f"SELECT * FROM {schema}.lands"))
        refused = _outcome(lambda: execute.sql_page(spark, "SHOW TABLES"))
        rows = [(r["k"], r["n"], page.total, "lands" in plan and "Scan" in plan, refused) for r in page.rows]
    finally:
        spark.sql(f"DROP DATABASE {schema} CASCADE")
    return spark.createDataFrame(rows, "k int, n long, total int, scanned boolean, refused string")


@query("""
SELECT 'OK' AS status, 'n_nationkey,n_name' AS columns, CAST((SELECT count(*)
FROM nation) AS INTEGER) AS row_count, false AS truncated, 'ERROR' AS late, 'ERROR' AS wrong, 'ERROR' AS written
""")
def executions(spark: SparkSession, d: str) -> DataFrame:
    """Results of guarded statements: rows and their columns; and errors of a time limit, of a name, and of a write."""
    own = _session(spark, d)
    good = execute.execute_readonly(own, "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= :k", {"k": 0})
    late = execute.execute_readonly(own, "SELECT count(*) FROM range(1000000000000) a WHERE sqrt(id) = 0.5", timeout_ms=300)
    wrong = execute.execute_readonly(own, "SELECT * FROM nowhere")
    write = execute.execute_readonly(own, "INSERT INTO nation VALUES (1)")
    row = (good.status, ",".join(good.columns), good.row_count, good.truncated, late.status, wrong.status, write.status)
    return spark.createDataFrame([row], "status string, columns string, row_count int, truncated boolean, late string, wrong string, written string")
