"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; only the words at its ones are hashed, so a substituted word at a zero does
not hide a copy. Hashes of the benchmark (the test side) are joined with those of every document in the tasks that read
the documents: the benchmark comes in blocks of bounded size, each broadcast, so no document is shuffled however large the
benchmark is. Around each hit the document and the item are aligned word by word and the longest stretch that tolerates
substitutions is measured. Alignments of many items at once are counted as arrays first, and equal patterns of equal words
are measured once, so words that many items share cost little.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, strings

WORDS = re.compile(r"\w+")
#: The seeds: ones are hashed, zeros ignored.
MASKS = ("1111", "11011", "10111", "11101", "110101", "1010011", "1100101", "10010101")
#: A copy has at least so many aligned words (or this share of the item's, if that is less), and so large a share equal.
LEAST_WORDS, SIMILARITY = 13, 0.8
#: Characters of a block of the benchmark (and one item more); its index takes some 20 bytes a character in a worker.
BLOCK_CHARACTERS = 3_000_000
#: Hits, and aligned words, that are looked at together.
HITS, ALIGNED = 1 << 20, 1 << 22
_multipliers = np.random.default_rng(5).integers(1, 2**63, 64, np.uint64) | np.uint64(1)


def words(text: str) -> list[str]:
    """Lower-case words; case, punctuation and white space do not tell copies apart."""
    return WORDS.findall(text.lower())


def least_words(size: int) -> int:
    """Aligned words that a copy of an item of size words has at least."""
    return min(LEAST_WORDS, math.ceil(SIMILARITY * size - 1e-9))


def stretch(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """The longest [start, end) of at least least positions of which SIMILARITY are equal, beginning and ending equal."""
    n = len(equal)
    if n < least or not equal.any():
        return None
    # Whole numbers: an equal word gains 20, another loses 80; a stretch of sum 0 or more is similar enough.
    gain = round(100 * (1 - SIMILARITY))
    total = np.append(0, np.cumsum(np.where(equal, gain, gain - 100)))
    far = 100 * (n + 1)
    from_here = np.minimum.accumulate(np.where(np.append(equal, False), total, far))  # least sum before a start so far
    to_there = np.maximum.accumulate(np.where(np.append(False, equal), total, -far)[::-1])[::-1]  # largest one at an end to come
    best, i, j = None, 0, 0
    while i < n and j <= n:
        if from_here[i] <= to_there[j]:
            if j > i and (best is None or j - i > best[1] - best[0]):
                best = (i, j)
            j += 1
        else:
            i += 1
    return best if best and best[1] - best[0] >= least else None


class Index:
    """Seed hashes of a block of items, and the search of a text for them."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.items = [(key, np.array([number(w, len(self.vocabulary)) for w in words(text)], np.int64)) for key, text in items]
        self.size = np.array([len(ids) for _, ids in self.items], np.int64)
        self.begin = np.append(0, np.cumsum(self.size))
        self.flat = np.concatenate([ids for _, ids in self.items]) if self.items else np.empty(0, np.int64)
        self.least = np.array([least_words(n) for n in self.size.tolist()], np.int64)
        self.seeds = []  # places, sorted hashes, item and place of each
        shorter: dict[int, list[int]] = {}
        for k, (_, ids) in enumerate(self.items):
            if 0 < len(ids) < max(map(len, MASKS)):
                shorter.setdefault(len(ids), []).append(k)  # too short for a seed: all of its words are
        every = range(len(self.items))
        for places, of in [*((np.flatnonzero(np.array(list(m)) == "1"), every) for m in MASKS), *((np.arange(n), of) for n, of in shorter.items())]:
            h, item, at = [], [], []
            for k in of:
                ids = self.items[k][1]
                if len(ids) > places[-1]:
                    found = self._hash(ids, places, np.arange(len(ids) - places[-1]))
                    h.append(found)
                    item.append(np.full(len(found), k))
                    at.append(np.arange(len(found)))
            if h:
                h, item, at = map(np.concatenate, (h, item, at))
                order = np.argsort(h, kind="stable")
                self.seeds.append((places, h[order], item[order], at[order]))

    @staticmethod
    def _hash(ids: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k, p in enumerate(places):
            h += (ids[starts + p].astype(np.uint64) + np.uint64(1)) * _multipliers[k % 64]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h

    def search(self, text: str) -> list[tuple]:
        """(item's key, first word of the copy in the text, its words, equal ones) for the best copy of each item."""
        return self.search_many([text])[0]

    def search_many(self, texts: list[str]) -> list[list[tuple]]:
        """search() of each text; seeds are hashed over all of them at once."""
        get, gap = self.vocabulary.get, [-1] * max(8, *(len(m) for m in MASKS))
        found, begins = [], []
        for text in texts:
            begins.append(len(found))
            found += [get(w, -1) for w in words(text)]
            found += gap  # no seed reaches across it
        ids, first = np.array(found, np.int64), np.array(begins, np.int64)
        known = ids >= 0
        best: list[dict[int, tuple]] = [{} for _ in texts]
        ends = np.append(first[1:], len(ids)) - len(gap)
        held, waiting = [], 0
        for places, hashes, item, at in self.seeds:
            n = len(ids) - int(places[-1])
            if n <= 0:
                continue
            valid = known[:n].copy()
            for p in places[1:]:
                valid &= known[p : p + n]
            starts = np.flatnonzero(valid)
            h = self._hash(ids, places, starts)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(high > low)
            total = np.cumsum(high[hit] - low[hit])
            done = 0
            while done < len(hit):  # some HITS at a time
                to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + HITS)))
                part = hit[done:to]
                many = high[part] - low[part]
                entry = np.repeat(low[part] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                start = np.repeat(starts[part], many)
                doc = np.searchsorted(first, start, "right") - 1
                held.append(np.stack([doc, item[entry], start - first[doc] - at[entry]]))
                waiting += len(entry)
                done = to
                if waiting >= HITS:
                    self._measure(np.concatenate(held, axis=1), ids, first, ends, best)
                    held, waiting = [], 0
        if held:
            self._measure(np.concatenate(held, axis=1), ids, first, ends, best)
        return [[b[k][1] for k in sorted(b)] for b in best]

    def _measure(self, diagonals: np.ndarray, ids: np.ndarray, first: np.ndarray, ends: np.ndarray, best: list[dict[int, tuple]]) -> None:
        """Puts into best the longest stretch of each document and item on diagonals (document, item, shift), of equally
        long ones that of the smallest shift."""
        doc, item, shift = diagonals
        far = int(np.abs(shift).max()) + 1
        codes = np.unique((doc * len(self.items) + item) * (2 * far) + shift + far)
        shift = codes % (2 * far) - far
        doc, item = np.divmod(codes // (2 * far), len(self.items))
        a = np.maximum(0, -shift)
        length = np.minimum(self.size[item], ends[doc] - first[doc] - shift) - a
        need = -(-self.least[item] * round(100 * SIMILARITY) // 100)  # equal words of the shortest stretch
        ok = length >= np.maximum(1, self.least[item])
        doc, item, shift, a, length, need = (x[ok] for x in (doc, item, shift, a, length, need))
        known: dict[tuple[bytes, int], tuple[int, int] | None] = {}
        total, done = np.cumsum(length), 0
        while done < len(doc):  # some ALIGNED words at a time
            to = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + ALIGNED)))
            n = length[done:to]
            begin = np.append(0, np.cumsum(n)[:-1])
            place = np.arange(n.sum()) - np.repeat(begin, n)
            own = np.repeat(first[doc[done:to]] + a[done:to] + shift[done:to], n) + place
            equal = self.flat[np.repeat(self.begin[item[done:to]] + a[done:to], n) + place] == ids[own]
            for i in np.flatnonzero(np.add.reduceat(equal, begin, dtype=np.int64) >= need[done:to]).tolist():
                k, d, least = int(item[done + i]), int(doc[done + i]), int(self.least[item[done + i]])
                same = equal[begin[i] : begin[i] + n[i]]
                pattern = same.tobytes(), least
                if pattern not in known:
                    known[pattern] = stretch(same, least)
                if found := known[pattern]:
                    x, y = found
                    start = int(a[done + i] + shift[done + i])
                    order = (x - y, int(shift[done + i]))
                    if k not in best[d] or order < best[d][k][0]:
                        best[d][k] = (order, (self.items[k][0], start + x, y - x, int(same[x:y].sum())))
            done = to


#: The index that a worker used last: tasks of a pass over the documents share it.
_indexes: dict[str, Index] = {}


def index_of(name: str, items: Callable[[], list[tuple]]) -> Index:
    """The index of items(), made once a worker for consecutive tasks of the same name."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(items())
    return _indexes[name]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[Callable[[], list[tuple]]]:
    """A reader for each block of about BLOCK_CHARACTERS of items, so that one block at a time is on the driver."""
    size = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-int(total) // BLOCK_CHARACTERS))
    part = F.pmod(F.xxhash64(item_col, text_col), F.lit(n))
    return [lambda k=k: [tuple(r) for r in benchmark.filter(F.col(text_col).isNotNull() & (part == k)).select(item_col, text_col).distinct().orderBy(item_col, text_col).collect()] for k in range(n)]


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds a copy of: where the copy begins (word), its words, equal words.

    Documents without a copy have no row. Null and empty texts, and items without words, match nothing; repeated rows of
    df give their rows each, repeated items one row. Other columns are ignored.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start_word", "n_aligned", "n_equal")), T.StructField("similarity", T.DoubleType())])

    def found(items: list[tuple]) -> DataFrame:
        shared, name = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def start():
            index = index_of(name, lambda: shared.value)

            def f(batch: pa.RecordBatch) -> list:
                found = index.search_many(strings(batch.column(1)))
                rows = [(d, *m) for d, of in zip(batch.column(0).to_pylist(), found, strict=True) for m in of]
                return [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[4] / r[3] for r in rows]]

            return f

        return map_rows(df.select(id_col, text_col), schema, start)

    return reduce(DataFrame.unionByName, [found(block()) for block in blocks(benchmark, item_col, item_text)])


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """df without the rows whose text holds a copy of an item; no shuffle, and every column stays.

    Null and empty texts are clean. Of a benchmark of several blocks each is one more pass over what the last kept.
    """
    at = df.columns.index(text_col)

    def kept(d: DataFrame, items: list[tuple]) -> DataFrame:
        shared, name = d.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def start():
            index = index_of(name, lambda: shared.value)

            def f(batch: pa.RecordBatch) -> list:
                stay = pa.array([not found for found in index.search_many(strings(batch.column(at)))], pa.bool_())
                return batch.filter(stay).columns

            return f

        return map_rows(d, d.schema, start)

    for block in blocks(benchmark, "item_id", "text"):
        df = kept(df, block())
    return df
