"""Quality rules: how many characters of a text lie in repeated n-grams and lines, by rolling hashes in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WORD, map_rows, octets

WORDS = re.compile(WORD)
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Words of an n-gram, and the largest share of a kept text's characters that may lie in n-grams found twice or more, the
#: first copies included. They lie below the half that the base rule allows to repeated triples, so a passage that comes
#: twice and is over a fifth of a text fails; a line of eight words that comes twice in a text of the least length does not.
LIMITS = {5: 0.45, 7: 0.42, 10: 0.40}
LINE_LIMIT = 0.30
#: Odd multiplier of the rolling hash, modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
LEAST_WORDS, MOST_REPEATED = 50, 50


def word_ids(words: list) -> np.ndarray:
    """A number per word, equal for equal words."""
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def rolling(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all n-grams of each length; a longer one's hash comes from that of one word less."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    out, h = {}, x
    for n in range(1, max(lengths) + 1):
        if n > 1:
            h = h[:-1] * BASE + x[n - 1 :]
        if not len(h):
            break
        if n in lengths:
            out[n] = h
    return out


def covered(grams: np.ndarray, n: int, size: int) -> np.ndarray | None:
    """Which of size words lie in an n-gram that occurs twice or more; None if no n-gram does."""
    s = np.sort(grams)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    at = np.searchsorted(twice, grams)
    hit = twice[np.minimum(at, len(twice) - 1)] == grams
    step = np.zeros(size + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def trigrams(ids: np.ndarray) -> np.ndarray:
    """A number per three words, equal for equal ones and for no others."""
    first, second, third = ids[:-2], ids[1:-1], ids[2:]
    if len(ids) and ids.max() >= 1 << 21:  # three numbers would not fit one; pairs get numbers of their own
        pair = np.unique((first << 31) | second, return_inverse=True)[1]
        return (pair << 31) | third
    return (first << 42) | (second << 21) | third


def measure(data: bytes) -> tuple:
    """Of a text in UTF-8: words, their characters, symbols, repeated lines, words in repeated trigrams, base verdict,
    verdict, share of characters in repeated lines and in repeated n-grams of each length."""
    words = data.split()
    n = len(words)
    ascii_only = data.isascii()
    spaces = len(data) - len(data.translate(None, SPACE))
    points = len(data) if ascii_only else len(data.decode("utf-8", "replace"))
    chars = points - spaces
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_chars = 0
    lines = data.split(b"\n")
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup_lines += 1
                dup_chars += len(line.translate(None, SPACE).decode("utf-8", "replace"))
            elif line.strip(SPACE):
                seen.add(line)
    ids = word_ids(words)
    mask = covered(trigrams(ids), 3, n) if n > 3 else None
    repeated = int(mask.sum()) if mask is not None else 0
    shares = dict.fromkeys(LIMITS, 0.0)
    if repeated:  # a longer n-gram repeats only if its trigrams do
        lengths = None
        for k, grams in rolling(ids, list(LIMITS)).items():
            mask = covered(grams, k, n)
            if mask is None:
                break
            if lengths is None:
                lengths = np.array([len(w) for w in (words if ascii_only else WORDS.findall(data.decode("utf-8", "replace")))])
            shares[k] = float(lengths[mask].sum() / max(1, chars))
    line_share = dup_chars / max(1, chars)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    kept = not failed and line_share <= LINE_LIMIT and all(shares[k] <= most for k, most in LIMITS.items())
    return (n, chars, symbols, dup_lines, repeated, failed, kept, line_share, *shares.values())


COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("dup_line_share", T.DoubleType()), *((f"dup_{n}gram_share", T.DoubleType()) for n in LIMITS)]


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document with measure()'s figures. Null and empty texts have no words, fail and are not kept.

    Every row of df gives one row; other columns are ignored. A text is measured whole, in memory of its own size.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, t) for c, t in COLUMNS)])

    def start():
        def f(batch: pa.RecordBatch) -> list:
            return [batch.column(0), *map(list, zip(*map(measure, octets(batch.column(1))), strict=True))]

        return f

    return map_rows(df.select(id_col, text_col), schema, start)
