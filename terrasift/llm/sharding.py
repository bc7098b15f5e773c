"""Shards of near equal bytes by sampled splitters.

Keys (hash of the text, then id) are sampled with a chance in proportion to their rows' sizes; quantiles of the sample
split the keys into ranges of about equal bytes; a range that turns out overfull is sampled again and subdivided. Within
its range each row learns how many bytes lie before it, and with the ranges' totals its place on the line of all bytes,
which the shards cut. Equal texts share a key and so a shard. Groups too large for that (over a thousandth of a shard's bytes
or rows, so few enough to list) are packed first, whole if a shard has room; a group that fits no shard is cut by id.

Texts are read once and never shuffled: ranges, windows and sums work on narrow rows.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import remove
from .common import free_name, map_rows, write_table, written

#: Rows of a range at most in the mean, sampled keys per range, ranges at least.
RANGE_ROWS, KEYS_PER_RANGE, LEAST_RANGES = 400_000, 48, 64
#: Ranges of more than so many times the mean bytes, their largest row not counted, are cut again.
OVERFULL = 2.5
#: Groups with more than this share of a shard's bytes or rows are packed one by one: at most 2 * shards / HEAVY exist.
HEAVY = 1e-3


def _weighted_keys(rows: DataFrame, keys: int, total: int, seed: int) -> list[tuple[int, int]]:
    """Keys of rows (h, k, size), each kept with a chance in proportion to its size; about keys of them."""
    u = (F.pmod(F.xxhash64("h", "k", "row", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    return sorted((r["h"], r["k"]) for r in rows.filter(u * float(max(1, total)) < F.col("size") * float(keys)).select("h", "k").collect())


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def _ranges(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """rows with part: how many splitters are at or below the key (h, k)."""
    heads = np.array([s[0] for s in splitters], np.int64)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType())])

    def start():
        def f(batch: pa.RecordBatch) -> list:
            h = batch.column(names.index("h")).to_numpy()
            low, high = np.searchsorted(heads, h), np.searchsorted(heads, h, "right")
            part = low.copy()
            tied = np.flatnonzero(high > low)
            if len(tied):
                k = batch.column(names.index("k")).to_numpy()
                for i in tied.tolist():
                    part[i] = bisect.bisect_right(splitters, (int(h[i]), int(k[i])))
            return [*batch.columns, pa.array(part.astype(np.int32))]

        return f

    return map_rows(rows, schema, start, 10_000)


def _pack(groups: list[tuple[int, int, int]], shards: int, total: int) -> tuple[dict[tuple[int, int], int], list[float]]:
    """Shards of heavy groups (h, crc, bytes) that fit whole, largest first, and the room that is left in each shard."""
    room = [total / shards] * shards
    placed = {}
    for h, crc, size in sorted(groups, key=lambda g: (-g[2], g[0], g[1])):
        s = max(range(shards), key=lambda i: (room[i], -i))
        if size <= room[s]:
            placed[h, crc] = s
            room[s] -= size
    return placed, room


def _ranged(lined: DataFrame, parts: int, total: int) -> tuple[DataFrame, dict[int, int]]:
    """lined as a table with column part, the range of each row, and each range's bytes; parts is how many to start from.

    Overfull ranges are sampled again and cut until none is left that a splitter can cut.
    """
    splitters = _quantiles(_weighted_keys(lined, parts * KEYS_PER_RANGE, total, 0), parts)
    mean = max(1.0, total / parts)
    for seed in itertools.count(1):
        ranged, path = write_table(_ranges(lined, splitters), "shard-ranges")
        found = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.max("size").alias("most")).collect()  # a row a range
        over = {r["part"]: r["bytes"] for r in found if r["bytes"] - r["most"] > OVERFULL * mean}
        finer = splitters
        if over:
            wanted = sum(over.values()) / mean
            within = ranged.filter(F.col("part").isin(*over))
            more = _weighted_keys(within, KEYS_PER_RANGE * int(wanted + len(over)), sum(over.values()), seed)
            finer = sorted({*splitters, *_quantiles(more, 2 * int(wanted) + 2)})
        if finer == splitters:
            return ranged, {r["part"]: r["bytes"] for r in found}
        remove(lined.sparkSession, path)
        splitters = finer
    raise AssertionError


def _heavy(narrow: DataFrame, shards: int, total: int, rows: int) -> list[tuple[int, int, int, int]]:
    """Heavy groups (h, crc, bytes, rows), at most 2 * shards / HEAVY."""
    groups = narrow.groupBy("h", "crc").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    share = HEAVY / shards
    found = groups.filter((F.col("n") > 1) & ((F.col("bytes") > share * total) | (F.col("n") > share * rows)))
    return [(r["h"], r["crc"], r["bytes"], r["n"]) for r in found.collect()]


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): each row's bytes (UTF-8, plus one), shard and place in it from 0.

    Shards' bytes differ from an equal share by a thousandth of it and one row at most. Null counts as the empty text.
    Every row of df gives one row, repeated ones each their own slot; null ids sort first. Other columns are ignored.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    # row tells repeated keys apart in samples
    row = F.monotonically_increasing_id().alias("row")
    narrow = df.select(F.col(id_col).alias("id"), size, F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"), row)
    narrow = written(narrow, "shard-rows")
    total, n = (int(x or 0) for x in narrow.agg(F.sum("size"), F.count(F.lit(1))).first())
    groups = _heavy(narrow, shards, total, n)
    placed, room = _pack([g[:3] for g in groups], shards, total)
    # A heavy group's fate: its shard, or -1 for being cut by id; and the chunks that its rows are numbered in.
    parts = max(LEAST_RANGES, -(-n // RANGE_ROWS))
    chunk = max(1, n // (2 * parts))
    fates = [(h, crc, placed.get((h, crc), -1), 1 + c // chunk) for h, crc, _, c in groups]
    listed = spark.createDataFrame(fates, "h long, crc long, whole int, chunks long")
    marked = narrow.join(F.broadcast(listed), ["h", "crc"], "left")  # at most 2 * shards / HEAVY rows
    number = F.col("id").cast("long") if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.xxhash64("id")
    number = F.coalesce(number, F.lit(-(1 << 63)).cast("long"))
    marked = marked.withColumn("k", F.when(F.col("whole") == -1, number).otherwise(F.lit(0).cast("long")))
    lined = marked.filter("whole is null or whole = -1").select("id", "size", "crc", "h", "k", "row")
    ranged, sums = _ranged(lined, parts, total)
    before, at = {}, 0
    for p in sorted(sums):
        before[p], at = at, at + sums[p]
    # The shards cut the line of all rows that aren't placed, each as much as it has room for.
    ends = np.cumsum(room)
    ends[-1] = max(ends[-1], at)
    line = spark.createDataFrame([(int(p), int(b)) for p, b in before.items()], "part int, before long")
    order = ["h", "crc", "k"]
    through = F.sum("size").over(Window.partitionBy("part").orderBy(*order))  # ends with the last row of the same key
    numbered = F.row_number().over(Window.partitionBy("part").orderBy(*order, "id", "row"))
    cuts = F.array(*[F.lit(float(e)) for e in ends[:-1]])
    own = ranged.withColumn("number", numbered).withColumn("through", through).join(F.broadcast(line), "part")  # a row a range
    own = own.withColumn("shard", F.size(F.filter(cuts, lambda e: e < F.col("before") + F.col("through"))))
    piece = F.xxhash64("h", "crc", F.pmod(F.xxhash64("id", "row"), F.col("chunks")))
    whole = marked.filter("whole >= 0").withColumn("part", (-1 - F.pmod(piece, F.lit(1 << 30))).cast("int"))
    numbered = F.row_number().over(Window.partitionBy("part", "whole").orderBy("id", "row"))
    whole = whole.withColumn("number", numbered).withColumn("shard", F.col("whole"))
    columns = ["id", "size", "crc", "h", "part", "shard", "number"]
    assigned = written(own.select(*columns).unionByName(whole.select(*columns)), "shard-assigned")
    # Slots: a shard's rows of one range are consecutive in it; ranges follow one another.
    spans = assigned.groupBy("shard", "part").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    base, offsets = dict.fromkeys(range(shards), 0), []
    for r in sorted(spans, key=lambda r: (r["shard"], r["part"])):
        offsets.append((r["shard"], r["part"], base[r["shard"]] - r["first"]))
        base[r["shard"]] += r["n"]
    shift = spark.createDataFrame(offsets, "shard int, part int, shift long")
    done = assigned.join(F.broadcast(shift), ["shard", "part"])  # a row a range and shard it touches
    return done.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("number") + F.col("shift")).alias("slot"))


def write_shards(df: DataFrame, folder: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes df as Parquet under folder/shard=N and returns shard()'s rows. Repeated rows (id and text) go together."""
    rows = written(shard(df, shards, id_col, text_col), "shard-result")
    df = df.drop("shard")
    key, crc, size, own_crc, own_size = (free_name(df, n) for n in ("_id", "_crc", "_size", "_own_crc", "_own_size"))
    home = rows.groupBy(F.col(id_col).alias(key), F.col("text_crc32").alias(crc), F.col("size").alias(size)).agg(F.min("shard").alias("shard"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = df.withColumn(own_crc, F.crc32(text.cast("binary"))).withColumn(own_size, (F.octet_length(text) + 1).cast("long"))
    out = named.join(home, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(crc) == F.col(own_crc)) & (F.col(size) == F.col(own_size)))
    out.drop(key, crc, size, own_crc, own_size).write.mode("overwrite").partitionBy("shard").parquet(folder)
    return rows
