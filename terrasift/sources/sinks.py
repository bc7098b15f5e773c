"""Sinks by address: a SQLite file, another database over JDBC, or a table of the session's catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import jdbc, sqlite
from .shapefile import overwrites


def write(df: DataFrame, address: str, table: str, if_exists: object = "skip", **options: str) -> str:
    """Writes df as a table and returns what became of it: "written" or "skipped".

    jdbc:sqlite: files have geometry as WKB and a list of layers; other jdbc: databases get WKB in hexadecimal digits, which
    spatial ones read as geometry, batch by batch from the executors; an address without jdbc: is a schema of the catalog.
    An existing table is replaced or kept by the policy, an unknown one raises.
    """
    replace = overwrites(if_exists)
    if not (address or "").lower().startswith("jdbc:"):
        spark, full = df.sparkSession, f"{address}.{table}" if address else table
        if address:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{address}`")
        if spark.catalog.tableExists(full) and not replace:
            return "skipped"
        df.write.mode("overwrite").saveAsTable(full)
        return "written"
    place = jdbc.parse(address)
    if place.kind == "sqlite":
        return sqlite.write(df, place.database, table, if_exists)
    hexed = [F.hex(f"`{f.name}`").alias(f.name) if G.is_geometry(f) else F.col(f"`{f.name}`") for f in df.schema.fields]
    writer = df.select(*hexed).write.format("jdbc").options(**place.reader_options(), dbtable=table, **options)
    try:
        writer.mode("overwrite" if replace else "error").save()
    except Exception as e:
        if "TABLE_OR_VIEW_ALREADY_EXISTS" in str(e) and not replace:
            return "skipped"
        raise
    return "written"
