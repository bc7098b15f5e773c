"""Near-duplicate groups at a similarity of five-word shingles, found and verified exactly.

A 64-bit fingerprint with a radius of two bits finds copies with very few changes. At a similarity of 0.8 fingerprints of
shingles differ in a sixth of their bits, too many for any radius that a table of pivots can serve. So candidates are found
by the shingles themselves (their 64-bit hashes):

1. In one order of all shingles (common ones last, then by hash) two sets of Jaccard similarity s or more share one of
   their first n - ceil(s n) + 1 shingles. Any order is exact; common ones are only last to keep buckets small.
2. Texts that share such a shingle form a bucket. Of a small bucket all pairs are candidates. In a large one all meet a few
   pivots first; hot buckets are dealt over many tasks, whose pivots then meet one another.
3. Pairs are ruled out by size and by a parity sketch of some bits a shingle: sketches differ in no more bits than the sets in
   shingles, and a longer sketch folds to a shorter one.
4. The rest are linked if the Jaccard similarity of their sets is s or more. Each text is first compared with one
   candidate; pairs that these links, or those of the 64-bit fingerprints, connect need no comparison of their own, so
   copies make no square of pairs.
5. In large buckets whose members are still unconnected the pairs across groups are candidates, in cells of bounded size:
   first each text with those nearest to it by the sketches, which connect most, then all that are left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import ensure_workers, release, remove
from .common import components, free_name, map_rows, octets, write_table, written
from .simhash import LOWER, SEED, fingerprint_of, links

WIDTH, SIMILARITY = 5, 0.8
#: Texts that common shingles are counted in, how many hold one, and how many are kept.
SAMPLE, OFTEN, COMMON = 10_000, 6, 20_000
#: Up to so many nodes of a bucket are compared as pairs at once; more meet so many pivots first.
PAIRWISE, PIVOTS = 16, 3
#: Nodes of a cell, in the mean; buckets of more than this share of all entries, and of more nodes than a cell, are dealt.
CELL, SHARE = 4096, 1 / 4000
#: Times that a sketch is folded for pairs that are joined, and partners of a text in a cell that come first.
FOLDS, NEAREST = 2, 2
#: Bits that say which texts are read again.
PLACES = 1 << 25
#: Nodes that a task remembers to have passed on.
MEMORY = 500_000
_steps = np.random.default_rng(23).integers(1, 2**63, WIDTH, np.uint64) | np.uint64(1)
_LONGS = T.ArrayType(T.LongType())


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names])


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of WIDTH words (of all words if there are fewer), from the words' own."""
    digest = xxhash.xxh64_intdigest
    known: dict[bytes, int] = {w: digest(w, SEED) for w in set(words)}
    x = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n, width = max(1, len(words) - WIDTH + 1), min(WIDTH, len(words))
    h = np.full(n if words else 0, width, np.uint64)
    for k in range(width):
        h += x[k : k + n] * _steps[k]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for the parity of each of a power of two of classes of hashes, as signed longs; 2**FOLDS to twice that a hash."""
    places = 64 << (max(0, (len(hashes) - 1).bit_length() - 6) + FOLDS)
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def sketch(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Fingerprint of 64 bits, node, parity sketch, and the sorted hashes of distinct shingles."""
    words = data.translate(LOWER).split()
    hashes, fp = shingles(words), fingerprint_of(words)
    node = xxhash.xxh64_intdigest(fp.to_bytes(8, "little") + hashes.tobytes(), SEED)
    return fp, node, parities(hashes), hashes


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """Those of a text's sorted shingles of which similar texts share one; common is sorted."""
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, common: np.ndarray = np.empty(0, np.int64), whole: bool = True) -> DataFrame:  # noqa: B008
    """Rows (id, h, fp, node, n, bits, prefix, shingles) of each row of df, without whole not the last.

    h tells texts apart, node distinct sketches. Null and empty texts have zeros and no shingles.
    """
    arrays = ("bits", "prefix", *["shingles"] * whole)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *_longs("h", "fp", "node", "n").fields, *(T.StructField(c, _LONGS) for c in arrays)])

    def start():
        def f(batch: pa.RecordBatch) -> list:
            made = [sketch(x) for x in octets(batch.column(2))]
            fps, nodes = (pa.array(np.array([m[k] for m in made], np.uint64).view(np.int64)) for k in (0, 1))
            sets = [m[3] for m in made]
            starts = [prefix(x, similarity, common) for x in sets]
            return [batch.column(0), batch.column(1), fps, nodes, [len(x) for x in sets], [m[2] for m in made], starts, *[sets] * whole]

        return f

    return map_rows(df.select(id_col, F.xxhash64(text_col).alias("h"), text_col), schema, start)


def common_shingles(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of shingles that several of some SAMPLE texts hold, the commonest COMMON of them.

    They only order the shingles: whichever they are, no pair is lost.
    """
    share = int(SAMPLE / max(SAMPLE, df.count()) * (1 << 20)) + 1
    part = df.filter(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < share).select(text_col).distinct()

    def start():
        def f(batch: pa.RecordBatch) -> list:
            found = [shingles(x.translate(LOWER).split()) for x in octets(batch.column(0))]
            return [pa.array(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int64))]

        return f

    held = map_rows(part, _longs("s"), start)
    often = held.groupBy("s").count().filter(f"count >= {OFTEN}").orderBy(F.desc("count"), "s").limit(COMMON)
    return np.array(sorted(r["s"] for r in often.collect()), np.int64)


def sets_of(df: DataFrame, text_col: str) -> Callable[[DataFrame], DataFrame]:
    """A function from nodes (node, h) to rows (node, shingles), each node once, made anew of the texts of df.

    A bitmap of the texts' hashes says which are read again, so no texts are shuffled and no other sets are kept; other
    nodes may come too.
    """

    def of(nodes: DataFrame) -> DataFrame:
        place = lambda h: F.pmod(h, F.lit(PLACES))
        flags = nodes.select(place(F.col("h")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        maps = {r["k"]: bytes(r["m"]) for r in flags.collect()}  # PLACES bits
        shared = df.sparkSession.sparkContext.broadcast(maps)
        schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", _LONGS)])
        h = F.xxhash64(text_col)

        def start():
            got, seen = shared.value, set()

            def wanted(h: int, k: int, p: int) -> bool:
                if h in seen or k not in got or not got[k][p >> 3] >> (p & 7) & 1:
                    return False
                if len(seen) > MEMORY:
                    seen.clear()
                seen.add(h)
                return True

            def f(batch: pa.RecordBatch) -> list:
                want = [wanted(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
                made = [sketch(x) for x in octets(batch.column(3).filter(pa.array(want, pa.bool_())))]
                return [pa.array(np.array([m[1] for m in made], np.uint64).view(np.int64)), [m[3] for m in made]]

            return f

        rows = df.select(h.alias("h"), F.bitmap_bucket_number(place(h)).alias("k"), F.bitmap_bit_position(place(h)).alias("p"), text_col)
        return map_rows(rows, schema, start).dropDuplicates(["node"])

    return of


def hot_keys(rows: DataFrame) -> dict[int, int]:
    """Buckets that are dealt over several tasks, and over how many: estimated from the prefixes of some SAMPLE nodes.

    There are 1 / SHARE of them at most. An estimate only changes where pairs meet, not which.
    """
    n = rows.count()
    part = int(SAMPLE / max(SAMPLE, n) * (1 << 20)) + 1
    some = rows.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < part)
    entries = some.agg(F.sum(F.size("prefix"))).first()[0] or 0
    scale = (1 << 20) / min(part, 1 << 20)
    most = max(CELL, SHARE * entries * scale)
    counted = some.select(F.explode("prefix").alias("key")).groupBy("key").count().filter(F.col("count") * scale > most)
    return {r["key"]: math.ceil(r["count"] * scale / most) for r in counted.collect()}


def _mixed(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A key for each key and salt."""
    with np.errstate(over="ignore"):
        h = (key.view(np.uint64) + (salt.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def prefixes(rows: DataFrame, hot: dict[int, int] | None = None) -> DataFrame:
    """Rows (key, node, n) of the prefixes of sketches, keys of hot buckets salted; copies of a node may repeat."""
    keys = np.array(sorted(hot or {}), np.int64)
    salts = np.array([hot[k] for k in keys.tolist()], np.uint64) if hot else None

    def start():
        seen: set[int] = set()

        def f(batch: pa.RecordBatch) -> list:
            if len(seen) > MEMORY:
                seen.clear()
            new = [x not in seen and not seen.add(x) for x in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(new, pa.bool_()))
            times = batch.column(2).value_lengths().to_numpy()
            key = batch.column(2).flatten().to_numpy()
            node, n = (np.repeat(batch.column(k).to_numpy(), times) for k in (0, 1))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                dealt = np.flatnonzero(keys[at] == key)
                key = key.copy()
                key[dealt] = _mixed(key[dealt], node[dealt].view(np.uint64) % salts[at[dealt]])
            return [pa.array(key), pa.array(node), pa.array(n)]

        return f

    return map_rows(rows.select("node", "n", "prefix"), _longs("key", "node", "n"), start)


#: Kinds of met()'s rows.
PAIR, MEMBER, PIVOT = range(3)


def met(keyed: DataFrame, similarity: float, hot: dict[int, int] | None = None) -> DataFrame:
    """Rows (kind, a, b, key, n) of buckets (key, node, n).

    Pairs (a, b): all of small buckets, in large ones those with a pivot. Members (a, key, n) of large buckets, and pivots
    of dealt ones; key is that before salting. A task holds a batch and a small bucket, however large a bucket is.
    """
    salted = {int(_mixed(np.array([k], np.int64), np.array([s], np.uint64))[0]): k for k, m in (hot or {}).items() for s in range(m)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, np.ndarray, np.ndarray | None, int | None, np.ndarray | None]] = []
        key: int | None = None
        node = n = np.empty(0, np.int64)  # of the small bucket that goes on
        pivots: tuple[np.ndarray, np.ndarray] | None = None
        last: int | None = None

        def pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            near = (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9) & (a != b)
            if near.any():
                a, b = a[near], b[near]
                out.append((PAIR, np.minimum(a, b), np.maximum(a, b), None, None))

        def large(some: np.ndarray, sizes: np.ndarray) -> None:
            for p, size in zip(*pivots, strict=True):
                pairs(np.full(len(some), p), some, np.full(len(some), size), sizes)
            out.append((MEMBER, some, None, salted.get(key, key), sizes))

        def begun(some: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal pivots
            pivots = some[:PIVOTS], sizes[:PIVOTS]
            if key in salted:
                out.append((PIVOT, *pivots[:1], None, salted[key], pivots[1]))
            large(some, sizes)

        def ended() -> None:
            if pivots is None and key in salted and len(node):
                begun(node, n)
            elif pivots is None and len(node) > 1:
                i, j = np.triu_indices(len(node), 1)
                pairs(node[i], node[j], n[i], n[j])

        def flushed() -> pa.RecordBatch:
            size = sum(len(o[1]) for o in out)
            part = lambda k, t: pa.concat_arrays([pa.array(o[k]) if isinstance(o[k], np.ndarray) else pa.nulls(len(o[1]), t) if o[k] is None else pa.array(np.full(len(o[1]), o[k])) for o in out]) if size else pa.array([], t)
            kinds = pa.array(np.repeat(np.array([o[0] for o in out], np.int32), [len(o[1]) for o in out]) if size else np.empty(0, np.int32))
            made = pa.RecordBatch.from_arrays([kinds, *(part(k, pa.int64()) for k in (1, 2, 3, 4))], names=["kind", "a", "b", "key", "n"])
            out.clear()
            return made

        for batch in batches:
            keys, nodes, sizes = (batch.column(k).to_numpy() for k in range(3))
            if not len(keys):
                continue
            fresh = np.append((keys[0], nodes[0]) != (key, last), (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
            keys, nodes, sizes = keys[fresh], nodes[fresh], sizes[fresh]  # copies of a node follow one another
            if not len(keys):
                continue
            last = int(nodes[-1])
            cuts = np.append(np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys))
            of_many = np.diff(cuts) > 1
            of_many[[0, -1]] = True  # these may go on before or after
            if salted:
                of_many |= np.isin(keys[cuts[:-1]], np.fromiter(salted, np.int64, len(salted)))
            for r in np.flatnonzero(of_many).tolist():
                a, b = int(cuts[r]), int(cuts[r + 1])
                if key != keys[a]:
                    ended()
                    key, pivots = int(keys[a]), None
                    node = n = np.empty(0, np.int64)
                some, own = nodes[a:b], sizes[a:b]
                if pivots is not None:
                    large(some, own)
                    continue
                node, n = np.concatenate([node, some]), np.concatenate([n, own])
                if len(node) > PAIRWISE:
                    begun(node, n)
                    node = n = np.empty(0, np.int64)
            yield flushed()
        ended()
        yield flushed()

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "kind int, a long, b long, key long, n long")


def _matrices(column: pa.Array) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Words of each sketch; and for each number of words the sketches of that and of twice the length, these folded, with
    the place of each row in them."""
    lanes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy().view(np.uint64)  # numpy counts bits of absolute values
    begin = np.append(0, np.cumsum(lanes))[:-1]
    out = {}
    for width in np.unique(lanes).tolist():
        own, longer = np.flatnonzero(lanes == width), np.flatnonzero(lanes == 2 * width)
        take = lambda rows, size: flat[begin[rows][:, None] + np.arange(size)]
        twice = take(longer, 2 * width)
        place = np.full(len(lanes), -1)
        place[own], place[longer] = np.arange(len(own)), len(own) + np.arange(len(longer))
        out[width] = place, np.concatenate([take(own, width), twice[:, :width] ^ twice[:, width:]])
    return lanes, out


def unmet(cells: DataFrame, similarity: float, nearest: int | None = None) -> DataFrame:
    """Rows (a, b) of cells (key, node, n, bits, root): pairs of a cell with different roots that size and bits allow; with
    nearest only so many of each node, those whose bits differ least."""
    allowed = (1 - similarity) / (1 + similarity)

    def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, n, root = (rows.column(k).to_numpy() for k in (1, 2, 4))
        lanes, bits = _matrices(rows.column(3))
        for at in range(0, len(n), 64):
            near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            i = slice(at, at + 64)
            last = int(np.searchsorted(n, n[i].max() / similarity + 1e-6, side="right"))
            first = int(np.searchsorted(n, n[i].min() * similarity - 1e-6)) if nearest else at
            for to in range(first, last, 2048):
                j = slice(to, min(to + 2048, last))
                x, y = n[i, None], n[None, j]
                p, q = np.nonzero((root[i, None] != root[None, j]) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9))
                p, q = p + at, q + to
                shorter = np.minimum(lanes[p], lanes[q])
                for width, (place, matrix) in bits.items():
                    of = np.flatnonzero(shorter == width)
                    for k in range(0, len(of), 1 << 14):
                        u, v = p[of[k : k + (1 << 14)]], q[of[k : k + (1 << 14)]]
                        differing = np.bitwise_count(matrix[place[u]] ^ matrix[place[v]]).sum(axis=1, dtype=np.int64)
                        ok = differing <= allowed * (n[u] + n[v]) + 1e-9
                        if ok.any():
                            near.append((u[ok], v[ok], differing[ok] / (n[u[ok]] + n[v[ok]])))
            if near:
                u, v, far = map(np.concatenate, zip(*near, strict=True))
                if nearest:  # the first of each row in order of distance
                    order = np.lexsort((v, far, u))
                    u, v = u[order], v[order]
                    starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
                    u, v = u[rank < nearest], v[rank < nearest]
                a, b = node[u], node[v]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the cell that goes on
        for batch in batches:
            key = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if kept and kept[0].column(0)[0].as_py() != key[a]:
                    yield from found(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                    kept = []
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from found(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return cells.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long")


def cells(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (key, node, n, bits, root) of cells in which all members (key, node, n, root) of a bucket with different roots
    meet; a cell holds some three times CELL of them in the mean.

    Of buckets with the same members one is enough. Members outside a bucket's largest group come in blocks, and every
    block meets every part of all members, so a large group costs its size times the blocks of what is outside it.
    """
    groups = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.expr("bit_xor(xxhash64(node))").alias("h"))
    buckets = groups.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("major"), F.sum("m").alias("m"), F.max("m").alias("top"), F.expr("bit_xor(h)").alias("h"), F.count(F.lit(1)).alias("roots"))
    buckets = buckets.filter("roots > 1").groupBy("h", "m").agg(F.min(F.struct("key", "major", "top")).alias("b")).select("b.*", "m")
    parts = F.ceil(F.col("m") / CELL).cast("long")
    blocks = F.ceil((F.col("m") - F.col("top")) / CELL).cast("long")
    every = members.join(buckets, "key").withColumn("parts", parts).withColumn("blocks", blocks)
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    rest = every.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("block", upto("blocks"))
    outside = every.filter((F.col("root") != F.col("major")) & (F.col("parts") > 1))
    outside = outside.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).withColumn("part", upto("parts"))
    both = rest.select("key", "part", "block", "node", "n", "root").unionByName(outside.select("key", "part", "block", "node", "n", "root")).distinct()
    return both.select(F.xxhash64("key", "part", "block").alias("key"), "node", "n", "root").join(nodes.select("node", "bits"), "node").select("key", "node", "n", "bits", "root")


def near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b), each once, that sizes and bits allow."""
    bits = F.col("bits")
    for _ in range(FOLDS):  # fewer bits are shuffled, and rule out nearly as much
        bits = _half(bits)
    short = nodes.select("node", "n", bits.alias("bits"))
    side = lambda n: short.select(F.col("node").alias(n), F.col("n").alias(f"n_{n}"), F.col("bits").alias(f"s_{n}"))
    close = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    close = close.filter(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) + 1e-9
    return close.filter(_differing(F.col("s_a"), F.col("s_b")) <= most).select("a", "b")


def similar(pairs: DataFrame, nodes: DataFrame, similarity: float, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Those of a written table of pairs (a, b) whose sets have the similarity.

    A set is shuffled to its node once, for both sides of the pairs, and from there to its partner.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    held = sets(nodes.select("node", "h").join(ends, "node", "left_semi"))
    side = lambda n: held.select(F.col("node").alias(n), F.col("shingles").alias(f"s_{n}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    both = both.select("a", "b", F.size("s_a").alias("x"), F.size("s_b").alias("y"), F.size(F.array_intersect("s_a", "s_b")).alias("both"))
    return both.filter(F.col("both") / (F.col("x") + F.col("y") - F.col("both")) >= similarity).select("a", "b")


def _half(x: Column) -> Column:
    """A sketch folded to half its length."""
    n = (F.size(x) / 2).cast("int")
    return F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), lambda a, b: a.bitwiseXOR(b))


def _differing(a: Column, b: Column) -> Column:
    """Differing bits of two sketches, one of them at most twice as long as the other."""
    fold = lambda x, y: F.when(F.size(x) > F.size(y), _half(x)).otherwise(x)
    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _rooted(df: DataFrame, roots: DataFrame, node: str, root: str) -> DataFrame:
    """df with the root of its column node; nodes without links are their own."""
    of = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return df.join(of, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")


def apart(pairs: DataFrame, roots: DataFrame, named: bool = False) -> DataFrame:
    """Pairs (a, b) that are not connected yet; with named the pairs of their roots."""
    found = _rooted(_rooted(pairs, roots, "a", "x"), roots, "b", "y").filter("x <> y")
    return found.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct() if named else found.select("a", "b")


def regrouped(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, root) of groups joined by more edges (a, b): only links between groups are followed. A written table."""
    between = apart(edges, roots, named=True)
    joined = written(components(between, "similar-between"), "similar-joined")
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left")
    moved = moved.select("node", F.coalesce("_to", "root").alias("root"))
    return written(moved.unionByName(joined.join(roots.select("node"), "node", "left_anti")), "similar-roots")


def similar_roots(rows: DataFrame, nodes: DataFrame, similarity: float, sets: Callable[[DataFrame], DataFrame], known: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (node, root) of the groups that known edges (a, b) and similarity link, and the tables of similar edges found;
    nodes (node, h, n, bits) of sketches, rows and known are written tables. Nodes without links have no row.

    Shuffle files and tables of a step are let go after the next.
    """
    spark = nodes.sparkSession
    ensure_workers(spark)
    hot = hot_keys(rows)
    found, found_path = write_table(met(prefixes(rows, hot), similarity, hot), "similar-met")
    release(spark)
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b")
    if hot:
        again = found.filter(F.col("kind") == PIVOT).select("key", F.col("a").alias("node"), "n")
        pairs = pairs.unionByName(met(again, similarity).filter(F.col("kind") == PAIR).select("a", "b"))
    roots = written(components(known, "similar-known"), "similar-roots")
    close = written(apart(near(pairs, nodes, similarity), roots), "similar-close")
    release(spark)
    first = written(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "similar-first")
    made = [written(similar(first, nodes, similarity, sets), "similar-edges")]
    release(spark)
    roots = regrouped(roots, made[0])
    rest, members = apart(close, roots), found.filter(F.col("kind") == MEMBER).select("key", F.col("a").alias("node"), "n")
    large = not members.isEmpty()
    for nearest in [NEAREST, None] if large else [None]:
        if large:
            rooted = written(_rooted(members, roots, "node", "root"), "similar-members")
            late = unmet(cells(rooted, nodes), similarity, nearest).distinct()
            rest = late if nearest is None else rest.unionByName(late).distinct()
        rest = written(rest, "similar-rest")
        release(spark)
        if not rest.isEmpty():
            made.append(written(similar(rest, nodes, similarity, sets), "similar-edges"))
            release(spark)
            roots = regrouped(roots, made[-1])
    remove(spark, found_path)
    return roots, made


def groups(rows: DataFrame, similarity: float = SIMILARITY, sets: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (node, root) of a written table of sketches() at that similarity: roots are equal for texts of a group.

    Texts are linked if their shingles are similar, and if their 64-bit fingerprints are within simhash.RADIUS. Without
    sets, rows have the column shingles.
    """
    sets = sets or (lambda n: rows.select("node", "shingles").dropDuplicates(["node"]))
    nodes = written(rows.select("node", "h", "fp", "n", "bits").dropDuplicates(["node"]), "similar-nodes")
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    same = nodes.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a <> b")
    close = links(first.select("fp")).select(F.col("a").alias("fp"), F.col("b").alias("other"))
    close = close.join(first, "fp").select(F.col("other").alias("fp"), F.col("first").alias("a"))
    close = close.join(first, "fp").select("a", F.col("first").alias("b"))
    known = written(close.unionByName(same), "similar-known")
    release(nodes.sparkSession)
    roots, _ = similar_roots(rows, nodes, similarity, sets, known)
    return _rooted(nodes.select("node"), roots, "node", "root")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of df of each group, all columns: of its smallest id (null ids last), of rows of that id that of the text
    with the smallest hash, and any one of rows equal in both.

    Null and empty texts are one group. The rows of df are shuffled once, on a hash of the text and the id, to meet the
    names of the rows that stay.
    """
    name, own_id, own_h = (free_name(df, n) for n in ("_h", "_id", "_stay"))
    docs = written(sketches(df, id_col, text_col, similarity, common_shingles(df, text_col), whole=False), "similar-sketches")
    named = docs.groupBy("node", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h", "n")
    first = named.groupBy("node").agg(F.min(order).alias("r"))  # copies combine before they meet
    grouped = first.join(groups(docs, similarity, sets_of(df, text_col)), "node").groupBy("root").agg(F.min("r").alias("r"))
    stay = written(grouped.select(F.col("r.id").alias(own_id), F.col("r.h").alias(own_h), F.col("r.n").alias("n")), "similar-stay")
    rows = df.withColumn(name, F.xxhash64(text_col))
    if not stay.filter("n > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, name])  # repeated rows combine before they are shuffled
    # Names of rows are hashed, so texts are not sorted.
    names = stay.select(own_id, own_h).hint("shuffle_hash")
    same = (F.col(name) == F.col(own_h)) & F.col(id_col).eqNullSafe(F.col(own_id))
    return rows.join(names, same, "left_semi").drop(name)
