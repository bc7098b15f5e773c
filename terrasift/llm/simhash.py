"""SimHash near-duplicates: fingerprints, and links by tables of distances to reference fingerprints (pivots).

The 64 bits form eight groups of eight. The pivots are the base fingerprint (all zeros) and, for each group, the seven other
Walsh code words of eight bits in that group with the base elsewhere. A fingerprint's distance table holds its Hamming
distance to each pivot. By the triangle inequality two fingerprints at distance r differ by at most r in every coordinate.
And r <= 2 flipped bits fall into two groups at most: for one of the 28 choices of two groups the coordinates of all other
groups, less that of the base, are equal. So

1. candidates share, for some choice of two groups, the coordinates of the other six: an equi-join on 28 keys; within a key
   of many fingerprints, those with one or two bits of the two groups flipped;
2. pairs whose largest coordinate difference exceeds 2 are discarded;
3. the Hamming distance of the rest is computed.

The code words of a group are a basis, so equal coordinates of six groups mean 48 equal bits: as keys these pivots are another
name for bands of bits. Pivots drawn at random would discard as well, but offer no key to join on short of all pairs. A key
has 2**16 distinct fingerprints at most however many documents share it. Copies are merged before, and a key's fingerprints
emit a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import ensure_workers
from .common import components, map_rows, octets, written

SEED, RADIUS, SHINGLE = 42, 2, 3
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The Walsh functions on eight points, a byte each.
WALSH = [sum((bin(i & j).count("1") & 1) << j for j in range(8)) for i in range(8)]
GROUPS = 8
#: Distance of each byte to each pivot of its group, within the group; the first pivot is the base.
DISTANCES = np.array([[bin(b ^ w).count("1") for w in WALSH] for b in range(256)], np.int8)
#: Odd multipliers that turn a group's coordinates into its share of a key.
_weights = np.random.default_rng(11).integers(1, 2**63, (GROUPS, len(WALSH)), np.uint64) | np.uint64(1)
SHARES = np.array([[(DISTANCES[b].astype(np.uint64) * _weights[g]).sum(dtype=np.uint64) for b in range(256)] for g in range(GROUPS)])
LEFT_OUT = list(combinations(range(GROUPS), 2))
#: Up to so many fingerprints of a key are compared as pairs; more are looked up by their neighbours.
PAIRWISE = 64


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    """SimHash of a text in UTF-8: a bit is 1 if over half of the shingles' hashes have it; 0 without words."""
    return fingerprint_of(data.translate(LOWER).split(), width)


def fingerprint_of(words: list[bytes], width: int = SHINGLE) -> int:
    """fingerprint() of a text's lower-case words."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        h = [digest(line, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(x + 1 for x in ends[:-1])]
        h = [digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]  # noqa: B905  as many as there are ends
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array(h[at : at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long. Null and empty texts have 0."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def start():
        return lambda batch: [batch.column(0), pa.array(np.array([fingerprint(x) for x in octets(batch.column(1))], np.uint64).view(np.int64))]

    return map_rows(df.select(id_col, text_col), schema, start)


def table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (uint64) to all pivots, a row each; the base stands in every group."""
    parts = fps.astype("<u8").view(np.uint8).reshape(-1, GROUPS)
    outside = np.bitwise_count(fps)[:, None] - np.bitwise_count(parts)  # what the other groups add
    return (DISTANCES[parts] + outside[:, :, None].astype(np.int8)).reshape(len(fps), -1)


def keys(fps: np.ndarray) -> np.ndarray:
    """28 keys per fingerprint: the choice of left-out groups (5 bits) and a hash of all other coordinates."""
    parts = fps.astype("<u8").view(np.uint8).reshape(-1, GROUPS)
    shares = np.stack([SHARES[g][parts[:, g]] for g in range(GROUPS)])
    total = shares.sum(axis=0, dtype=np.uint64)
    out = np.empty((len(fps), len(LEFT_OUT)), np.uint64)
    for k, (a, b) in enumerate(LEFT_OUT):
        h = (total - shares[a] - shares[b]) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = (h >> np.uint64(5)) | np.uint64(k << 59)
    return out.view(np.int64)


def _near(fps: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that the distance table leaves and that are linked."""
    left = np.abs(t[i] - t[j]).max(axis=1, initial=0) <= RADIUS
    i, j = i[left], j[left]
    close = np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS
    return i[close], j[close]


def linked(fps: np.ndarray, left_out: tuple[int, int]) -> list[tuple[int, int]]:
    """Indices of a spanning forest of the links (distance 1 to RADIUS) between distinct fingerprints of one key."""
    n = len(fps)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if n <= PAIRWISE:
        pairs = [np.triu_indices(n, 1)]
    else:
        order = np.argsort(fps)
        ranked = fps[order]
        bits = [1 << (8 * g + k) for g in left_out for k in range(8)]
        pairs = []
        for mask in [*bits, *(x | y for x, y in combinations(bits, 2))]:
            other = ranked ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            hit = (ranked[at] == other) & (other > ranked)
            pairs.append((order[hit], order[at[hit]]))
    t = table(fps)
    pairs = [near for i, j in pairs if len((near := _near(fps, t, i, j))[0])]
    out = []
    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[ry] = rx
                out.append((x, y))
    return out


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): enough to connect all that are linked."""
    ensure_workers(distinct.sparkSession)
    keyed = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])

    def spread():
        def f(batch: pa.RecordBatch) -> list:
            fps = batch.column(0).to_numpy().view(np.uint64)
            return [pa.array(keys(fps).reshape(-1)), pa.array(np.repeat(fps.view(np.int64), len(LEFT_OUT)))]

        return f

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.append(np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1), len(key))
            a, b = [], []
            for k in np.flatnonzero(np.diff(cuts) > 1) if len(key) else []:
                run = fp[cuts[k] : cuts[k + 1]]
                for x, y in linked(run.view(np.uint64), LEFT_OUT[int(key[cuts[k]]) >> 59 & 31]):
                    a.append(int(run[x]))
                    b.append(int(run[y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([kept_key, batch.column(0).to_numpy()])
            fp = np.concatenate([kept_fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            last = np.flatnonzero(key != key[-1])  # the last key may go on in the next batch
            end = int(last[-1]) + 1 if len(last) else 0
            yield edges(key[:end], fp[:end])
            kept_key, kept_fp = key[end:], fp[end:]
        yield edges(kept_key, kept_fp)

    dealt = map_rows(distinct.select("fp"), keyed, spread, 4096).repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(join, "a long, b long")


def _components(docs: DataFrame) -> DataFrame:
    """Rows (fp, root) of a written table with column fp: root is the smallest fingerprint of fp's component."""
    distinct = written(docs.select("fp").distinct(), "simhash-distinct")
    roots = components(links(distinct), "simhash-links")
    return written(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id): the smallest id that links of at most RADIUS differing bits lead to, itself included.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay; null ids get their component's
    smallest id (null if it has none). Other columns are ignored.
    """
    docs = written(fingerprints(df, id_col, text_col), "simhash-fingerprints")
    roots = _components(docs)
    least = docs.groupBy("fp").agg(F.min(id_col).alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(roots.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")
