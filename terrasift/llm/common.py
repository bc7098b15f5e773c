"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import ensure_workers, fresh_path, remove

#: Rows that a Python worker holds as Python objects at a time; bounds its memory.
ROWS_AT_ONCE = 128

#: Words of the corpus contracts: runs without ASCII white space. ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return fresh_path(spark, name)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and that table's path."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: a table in the shared folder, which any executor can read again.

    It stays until the caller removes it (``shared.tables_of_run`` removes all that a run wrote).
    """
    return write_table(df, name)[0]


def train_row(doc_id: Column) -> Column:
    """True for rows that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def strings(column: pa.Array) -> list[str]:
    """Values as str, null as the empty text; bytes that are not UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def octets(column: pa.Array) -> list[bytes]:
    """Values as UTF-8 bytes, null as none."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, schema: T.StructType, start: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = ROWS_AT_ONCE) -> DataFrame:
    """df through a Python function over Arrow batches of few rows.

    start() runs once a task and returns the function, which gets a batch and returns the columns of schema, each an
    Arrow array or a list. Nothing is shuffled and a task holds one batch at a time.
    """
    ensure_workers(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = f(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


#: A node is a hub if more than one in so many edge ends are its own; so there are at most so many hubs.
HUBS = 4000


def _starred(e: DataFrame, edges: int, small: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b), a > b, of which there are edges."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if not small:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    limit = 2 * edges / HUBS
    hubs = least.filter(F.col("n") > limit).select("u", F.col("m").alias("hub_m"))  # HUBS rows at most
    marked = both.join(F.broadcast(hubs), "u", "left")
    joined = marked.filter("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    joined = joined.unionByName(marked.filter("hub_m is null").select("u", "v").join(least.filter(F.col("n") <= limit).select("u", "m"), "u"))
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.filter(F.col("m") < F.col("u")).select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _ordered(out)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), both long: one row (node, root) per node, root the smallest node reachable.

    Alternates large-star and small-star steps (map-reduce connected components by stars). Edges stay distributed, every
    round is a table in the shared folder (so lineage is cut and a lost executor costs one round) that replaces the last
    one, and a hub's neighbours are never gathered: only minima are grouped, which combine before the shuffle, and the
    few hubs' minima are broadcast to their edges. Null ends are dropped.
    """
    spark = edges.sparkSession
    e, path = write_table(_ordered(edges.filter("a is not null and b is not null")), name)
    before = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.countDistinct("a")).first())
        # A star forest has one edge per leaf, and no step changes it.
        if now[0] == 0 or now == before:
            break
        before, old = now, path
        # Each step is a table of its own: a plan of both would read the edges sixteen times.
        large, middle = write_table(_starred(e, now[0], small=False), name)
        e, path = write_table(_starred(large, 2 * now[0], small=True), name)
        remove(spark, old, middle)
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
