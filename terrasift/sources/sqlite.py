"""SQLite and SpatiaLite files: their objects and layers, tables as a Spark data source, and a sink.

A file is read in ranges of row numbers, a task each, so it must lie in a folder that all executors share. It has one
writer by its nature: the sink streams rows through the driver, partition by partition.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as G
from ..functions.sqltext import identifier, quoted
from ..shared import ensure_workers
from .shapefile import overwrites

#: Rows that a task reads at most.
ROWS = 100_000
# The table that names geometry columns, and the kinds' codes in it.
LAYERS = "geometry_columns"
_types = {"INT": "long", "CHAR": "string", "CLOB": "string", "TEXT": "string", "BLOB": "binary", "REAL": "double", "FLOA": "double", "DOUB": "double"}


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _connect(path: str) -> closing:
    return closing(sqlite3.connect(local(path)))


def objects(path: str) -> list[tuple[str, str]]:
    """Names and types of tables and views, sorted; none of the system's own."""
    with _connect(path) as db:
        rows = db.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")
        return [(n, t) for n, t in rows if n.strip()]


def is_empty(path: str) -> bool:
    """Whether a database has no table of its own."""
    return not any(t == "table" and n != LAYERS for n, t in objects(path))


def layers(path: str) -> list[tuple[str, str, int, int]]:
    """Table, geometry column, kind and SRID of each layer; none without the table that lists them."""
    if LAYERS not in dict(objects(path)):
        return []
    with _connect(path) as db:
        return list(db.execute(f"SELECT f_table_name, f_geometry_column, geometry_type, srid FROM {LAYERS} ORDER BY 1, 2"))


def columns(path: str, table: str) -> list[tuple[str, str]]:
    """Columns of a table with the Spark types of their affinities; LookupError if there is no such table."""
    with _connect(path) as db:
        found = list(db.execute(f"PRAGMA table_info({quoted(table, chr(34))})"))
    if not found:
        raise LookupError(f"no table {table}")
    return [(r[1], next((s for k, s in _types.items() if k in (r[2] or "").upper()), "double" if r[2] else "binary")) for r in found]


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str]):
        self.path, self.table, self.names = path, table, names

    def partitions(self) -> list[_Range]:
        with _connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table, chr(34))}").fetchone()
        return [] if low is None else [_Range(at, min(at + ROWS, high + 1)) for at in range(low, high + 1, ROWS)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        listed = ", ".join(quoted(n, '"') for n in self.names)
        with _connect(self.path) as db:
            yield from db.execute(f"SELECT {listed} FROM {quoted(self.table, chr(34))} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """format("sqlite").option("table", name).load(file)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return ", ".join(f"{quoted(n)} {t}" for n, t in columns(self.options["path"], self.options["table"]))

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self.options["table"], schema.names)


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a file, all its rows."""
    ensure_workers(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("table", table).load(path)


def write(df: DataFrame, path: str, table: str, if_exists: object = "skip") -> str:
    """Writes df as a table: "written", or "skipped" if it is there and the policy does not replace it.

    Geometry columns are listed as layers with their kind and SRID (those of the first row that has one); a replaced
    table's entries go first, as does the table. All is one transaction. Columns of other types become text.
    """
    name = identifier(table, "table")
    geometries = [f.name for f in df.schema.fields if G.is_geometry(f)]
    affinity = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    with _connect(path) as db:
        there = db.execute("SELECT 1 FROM sqlite_master WHERE lower(name) = lower(?)", (name,)).fetchone()
        if there and not overwrites(if_exists):
            return "skipped"
        with db:
            db.execute(f"CREATE TABLE IF NOT EXISTS {LAYERS} (f_table_name TEXT, f_geometry_column TEXT, geometry_type TEXT, srid INTEGER)")
            db.execute(f"DELETE FROM {LAYERS} WHERE lower(f_table_name) = lower(?)", (name,))
            db.execute(f"DROP TABLE IF EXISTS {quoted(name, chr(34))}")
            kinds = [affinity.get(f.dataType.typeName(), "TEXT") for f in df.schema.fields]
            listed = ", ".join(f"{quoted(f.name, chr(34))} {k}" for f, k in zip(df.schema.fields, kinds, strict=True))
            db.execute(f"CREATE TABLE {quoted(name, chr(34))} ({listed})")
            plain = df.select(*[F.col(f"`{f.name}`") if k != "TEXT" else F.col(f"`{f.name}`").cast("string").alias(f.name) for f, k in zip(df.schema.fields, kinds, strict=True)])
            rows = (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in plain.toLocalIterator(prefetchPartitions=True))
            db.executemany(f"INSERT INTO {quoted(name, chr(34))} VALUES ({', '.join('?' * len(kinds))})", rows)
            for g in geometries:
                first = df.select(G.geometry_type(F.col(f"`{g}`")).alias("k"), G.srid(F.col(f"`{g}`")).alias("s")).filter("k is not null").first()
                db.execute(f"INSERT INTO {LAYERS} VALUES (?, ?, ?, ?)", (name, g, first and first["k"], first["s"] if first else 0))
    return "written"
