"""Catalog introspection and profiles of tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import is_geometry
from ..functions.sqltext import identifier, qualified

MOST_DISTINCT, DEFAULT_DISTINCT = 100, 10
SYSTEM = ("information_schema", "pg_catalog", "sys")
COLUMNS = "schema string, table string, type string, position int, name string, data_type string, nullable boolean, geometry boolean"
#: Declared keys, which the catalog cannot hold: kind is pk, fk or index.
KEYS = "schema string, table string, kind string, columns array<string>, refers_table string, refers_columns array<string>"


def schemas(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.lower() not in SYSTEM)


def objects(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Rows (schema, name, type): tables and views, sorted, without blank and system names."""
    rows = []
    for t in spark.catalog.listTables(schema) if schema else spark.catalog.listTables():
        if t.name.strip() and not t.name.lower().startswith("sqlite_"):
            rows.append((".".join(t.namespace or []) or None, t.name, "view" if t.tableType in ("VIEW", "TEMPORARY") else "table"))
    return spark.createDataFrame(sorted(set(rows), key=str), "schema string, name string, type string")


def columns(spark: SparkSession, schema: str | None = None, include_views: bool = True) -> DataFrame:
    """A row per column of every table (and view)."""
    rows = []
    for o in objects(spark, schema).collect():
        if o["type"] == "table" or include_views:
            full = f"{o['schema']}.{o['name']}" if o["schema"] else o["name"]
            rows += [(o["schema"], o["name"], o["type"], i, f.name, f.dataType.simpleString(), f.nullable, is_geometry(f)) for i, f in enumerate(spark.table(full).schema.fields)]
    return spark.createDataFrame(rows, COLUMNS)


def declare_keys(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, KEYS)


def introspect(spark: SparkSession, schema: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Tables with their columns and declared keys, a row each."""
    cols = columns(spark, schema).groupBy("schema", "table", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "data_type", "nullable"))), lambda c: F.struct(c["name"], c["data_type"], c["nullable"])).alias("columns"))
    known = keys if keys is not None else declare_keys(spark, [])
    kept = known.groupBy("schema", "table").agg(F.array_sort(F.collect_list(F.struct("kind", "columns", "refers_table", "refers_columns"))).alias("keys"))
    on = cols["schema"].eqNullSafe(kept["schema"]) & (cols["table"] == kept["table"])
    return cols.join(kept, on, "left").select(cols["schema"], cols["table"], "type", "columns", "keys").orderBy("schema", "table")


def object_type(spark: SparkSession, name: str, schema: str | None = None) -> str:
    """table or view; LookupError if there is none of the name."""
    full = qualified(name, schema)
    if not spark.catalog.tableExists(full.replace("`", "")):
        raise LookupError(f"no table or view {full}")
    return "view" if spark.catalog.getTable(full.replace("`", "")).tableType in ("VIEW", "TEMPORARY") else "table"


def object_columns(spark: SparkSession, name: str, schema: str | None = None, expected: str | None = None) -> list[tuple[str, str]]:
    if expected not in (None, "table", "view"):
        raise ValueError("expected is table or view")
    kind = object_type(spark, name, schema)
    if expected and kind != expected:
        raise LookupError(f"{name} is a {kind}")
    return [(f.name, f.dataType.simpleString()) for f in spark.table(qualified(name, schema)).schema.fields]


def ddl(spark: SparkSession, name: str, schema: str | None = None) -> str:
    """The statement that creates a table or view, with a semicolon; for a temporary view one that lists its columns."""
    full = qualified(name, schema)
    object_type(spark, name, schema)
    try:
        text = spark.sql(f"SHOW CREATE TABLE {full}").first()[0].strip()
    except Exception:  # temporary views have no statement
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(full).schema.fields)
        text = f"CREATE TEMPORARY VIEW {full} ({fields})"
    return text.rstrip("; \n") + ";"


def estimated_rows(spark: SparkSession, table: str, schema: str | None = None) -> tuple[int, str]:
    """Rows of a table and how they were found: by analysed statistics, else by counting."""
    full = qualified(table, schema)
    try:
        for r in spark.sql(f"DESCRIBE EXTENDED {full}").collect():
            if r["col_name"] == "Statistics" and (m := re.search(r"(\d+) rows", r["data_type"])):
                return int(m[1]), "statistics"
    except Exception:  # a temporary view has none
        pass
    return spark.table(full).count(), "count"


def top_distinct(df: DataFrame, column: str, k: int = DEFAULT_DISTINCT) -> DataFrame:
    """The k (1 to 100) most frequent values that are not null, with their counts; ties by value."""
    identifier(column, "column")
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), "value").limit(min(MOST_DISTINCT, max(1, k)))


def category_profile(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values, null among them."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), F.asc_nulls_first("value")).limit(k)


def matches(df: DataFrame, column: str, name: str, pattern: str | None = None, limit: int = 5) -> DataFrame:
    """Rows that name an entity: exactly, else but for case, else by the pattern; the best kind found, with its rank."""
    c = F.col(column)
    like = c.ilike(pattern if pattern is not None else f"%{name}%")
    ranked = df.withColumn("match_rank", F.when(c == name, 1).when(F.lower(c) == name.lower(), 2).when(like, 3)).filter("match_rank is not null")
    best = ranked.agg(F.min("match_rank").alias("_best"))  # one row
    return ranked.join(F.broadcast(best), F.col("match_rank") == F.col("_best")).drop("_best").orderBy(column).limit(limit)


NAME_LIKE, CATEGORY_LIKE = re.compile(r"name|title|label", re.IGNORECASE), re.compile(r"class|category|type|kind", re.IGNORECASE)


def candidates(cols: DataFrame) -> DataFrame:
    """Tables that can be an anchor (a name and a geometry column) or a target (a category and a geometry column)."""
    return cols.groupBy("schema", "table").agg(
        (F.bool_or(F.col("name").rlike("(?i)name|title|label")) & F.bool_or("geometry")).alias("anchor"),
        (F.bool_or(F.col("name").rlike("(?i)class|category|type|kind")) & F.bool_or("geometry")).alias("target"),
    ).orderBy("schema", "table")


def join_options(spark: SparkSession, frames: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Columns of one frame that may refer to another's key: by name (its last part) and type, with both sides' approximate
    distinct counts, and whether each value of the column would find one key."""
    rows = []
    tail = lambda c: c.split("_")[-1].lower()
    for table, df in frames.items():
        for f in df.schema.fields:
            for other, key in keys.items():
                if other != table and tail(f.name) == tail(key) and f.dataType == frames[other].schema[key].dataType:
                    rows.append((table, f.name, other, key))
    found = []
    for table, column, other, key in rows:
        a = frames[table].agg(F.approx_count_distinct(column)).first()[0]
        b, n = frames[other].agg(F.approx_count_distinct(key), F.count(F.lit(1))).first()
        found.append((table, column, other, key, a, b, "many-to-one" if b >= 0.95 * n else "many-to-many"))
    return spark.createDataFrame(found, "table string, column string, refers_table string, refers_column string, distinct_values long, distinct_keys long, cardinality string")
