"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Metadata is the length that a document's row declares (n_chars), and whether its text has it: of the columns of documents all
others are kept from scores. Its score of a document with features x is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The pairs are summed in
linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2 in each factor.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows, octets, train_row
from .learning import sample

#: Labelled rows that the model is fitted on at most (hash order of their ids).
TRAIN_ROWS = 4000
#: Hash buckets of words, bins of each statistic, factors.
BUCKETS, BINS, FACTORS = 1 << 14, 12, 6
ACCEPT = 0.7
STATISTICS = 14
#: Metadata: a bin of the declared length, and whether it is missing, that of the text, or another.
DECLARED, AGREED = BUCKETS + STATISTICS * BINS, BUCKETS + (STATISTICS + 1) * BINS
SIZE = AGREED + 3
UPPER, DIGITS, SYMBOLS, STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>@^~_=+{}[]\\/", b".,;:!?"
LETTERS = UPPER + UPPER.lower()


def statistics(data: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a text and its length, each from 0 to 1."""
    n, size = len(words), max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    letters = max(1, len(data) - len(data.translate(None, LETTERS)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        min(1.0, math.log1p(n) / 12),
        min(1.0, len(counts) / max(1, n)),
        min(1.0, 10 * share(SYMBOLS)),
        min(1.0, 10 * share(STOPS)),
        min(1.0, 10 * share(b"!?")),
        min(1.0, 10 * share(DIGITS)),
        (len(data) - len(data.translate(None, UPPER))) / letters,
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n - 1),  # noqa: B905
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, n / max(1, len(lines)) / 120),
        min(1.0, sum(map(len, counts)) / max(1, len(counts)) / 20),
        max(counts.values(), default=0) / max(1, n),
        sum(w[-1:] in b".!?" for w in words) / max(1, n),
        min(1.0, 20 * share(b"|")),
    ]


def features(data: bytes, declared: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values, SIZE at most. Words: the root of each bucket's count, of length 1 together; statistics and
    metadata: a bin each. declared is the length in the document's row, in code points."""
    words = data.split()
    counts = Counter(words)
    stats = statistics(data, words, counts)
    bins = BUCKETS + np.arange(STATISTICS) * BINS + np.minimum((np.array(stats) * (BINS - 1) + 0.999).astype(np.int64), BINS - 1)
    if declared is None:
        about = [AGREED]
    else:
        own = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
        about = [DECLARED + min(BINS - 1, int(math.log1p(max(0, declared)))), AGREED + (1 if own == declared else 2)]
    crc = zlib.crc32
    hashed, place = np.unique(np.fromiter((crc(w) & (BUCKETS - 1) for w in counts), np.int64, len(counts)), return_inverse=True)
    values = np.sqrt(np.bincount(place, np.fromiter(counts.values(), np.float64, len(counts)), len(hashed)))
    index = np.concatenate([hashed, bins, about])
    length = max(1e-9, math.sqrt(float((values**2).sum())))
    return index.astype(np.int64), np.concatenate([values / length, np.full(STATISTICS + len(about), 0.5)])


def declared_length(df: DataFrame, column: str = "n_chars") -> Column:
    """The metadata column as a number; null where a table has none."""
    known = next((f for f in df.schema.fields if f.name == column and isinstance(f.dataType, T.NumericType)), None)
    return (F.col(column) if known else F.lit(None)).cast("long")


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.factors[index] * value[:, None]
        s = vx.sum(axis=0)
        return float(self.bias + self.weights[index] @ value + 0.5 * (s @ s - np.einsum("ij,ij->", vx, vx)))

    def score(self, data: bytes, declared: int | None = None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(*features(data, declared))))))


def fit(rows: list[tuple[list[int], list[float], int]], updates: int = 800, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Machine | None:
    """Adagrad on the logistic loss, in numpy; None without rows. rows have indices, values and label.

    Whole passes are made until there were at least updates steps, so that small samples are fitted as well as large ones.
    """
    if not rows:
        return None
    r = np.random.default_rng(seed)
    y = np.array([x[2] for x in rows], np.float64)
    w, v = np.zeros(SIZE), r.normal(0, 0.02, (SIZE, FACTORS))
    p = (y.sum() + 1) / (len(y) + 2)
    bias = math.log(p / (1 - p))
    gw, gv = np.full(SIZE, 1e-2), np.full((SIZE, FACTORS), 1e-2)
    packed = [(np.asarray(x[0], np.int64), np.asarray(x[1])) for x in rows]
    for _ in range(max(1, -(-updates // -(-len(rows) // batch)))):
        order = r.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            index = np.concatenate([packed[k][0] for k in part])
            value = np.concatenate([packed[k][1] for k in part])
            cuts = np.append(0, np.cumsum([len(packed[k][0]) for k in part]))[:-1]
            doc = np.repeat(np.arange(len(part)), np.diff(np.append(cuts, len(index))))
            vx = v[index] * value[:, None]
            s = np.add.reduceat(vx, cuts)
            m = bias + np.add.reduceat(w[index] * value, cuts) + 0.5 * ((s**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), cuts))
            e = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part]) / len(part)
            bias -= rate * float(e.sum())
            used, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, e[doc] * value, len(used)) + decay * w[used]
            each = (e[doc] * value)[:, None] * (s[doc] - vx)
            dv = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(FACTORS)], axis=1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return Machine(bias, w, v)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Machine | None:
    """The machine for labels.quality, from training rows alone; executors send features of the bounded sample only."""
    few = sample(df, labels, "quality", rows, id_col, text_col, {"declared": declared_length(df)})
    schema = T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("h", T.LongType())])

    def start():
        def f(batch: pa.RecordBatch) -> list:
            data = octets(batch.column(0))
            made = [features(x, n) for x, n in zip(data, batch.column(2).to_pylist(), strict=True)]
            return [[i.astype(np.int32) for i, _ in made], [x.astype(np.float32) for _, x in made], batch.column(1), [zlib.crc32(x) for x in data]]

        return f

    got = map_rows(few, schema, start).toArrow().to_pandas().sort_values(["h", "label"], kind="stable")  # any order of tasks gives the same model
    return fit([(i, np.asarray(x, np.float64), y) for i, x, y in zip(got["i"], got["x"], got["label"], strict=True)])


def scored(df: DataFrame, model: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted). Null and empty texts are scored by the bins of their zero statistics, tables
    without a number column n_chars as documents that declare no length.

    Without a model (no labelled rows) every score is 0.5. Every row of df gives one row; other columns are ignored. A
    null id is not held out.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def f(batch: pa.RecordBatch) -> list:
            rows = zip(octets(batch.column(2)), batch.column(3).to_pylist(), strict=True)
            return [batch.column(0), batch.column(1), [m.score(x, n) if m else 0.5 for x, n in rows]]

        return f

    held = F.coalesce(~train_row(F.col(id_col)), F.lit(False)).alias("held_out")
    made = map_rows(df.select(F.col(id_col), held, F.col(text_col), declared_length(df).alias("_declared")), schema, start)
    return made.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(df: DataFrame, model: Machine | None, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of df that the model accepts, all columns; without a model, all rows."""
    if model is None:
        return df
    at = df.columns.index(text_col)
    name = free_name(df, "_declared")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value

        def f(batch: pa.RecordBatch) -> list:
            rows = zip(octets(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            return batch.filter(pa.array([m.score(x, n) >= accept for x, n in rows], pa.bool_())).columns[:-1]

        return f

    return map_rows(df.withColumn(name, declared_length(df)), df.schema, start)
