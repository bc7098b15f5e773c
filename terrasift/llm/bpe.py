"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, offsets, and decoding by the byte table."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shared import ensure_workers
from .common import map_rows, strings

#: Pieces that a worker remembers, and the longest piece it does; the memory is emptied when full.
MEMORY_PIECES, MEMORY_LENGTH = 600_000, 48


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next character from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return {b: chr(b if b in visible else next(hidden)) for b in range(256)}


class ByteCodec:
    """Encodes and decodes by a rank file (base64 of a token's bytes, then its id, a line each).

    The model of the tokenizers library gets every split of a token into two known tokens as a merge, in order of rank.
    It so joins the adjacent pair of least rank whatever that pair's parts are, which is the rule of rank files.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.character = byte_characters()
        self.byte = {c: b for b, c in self.character.items()}
        shown = {t: "".join(map(self.character.__getitem__, t)) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # \s is taken as the Unicode property: Python's own also has the four separators U+001C to U+001F.
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # Decoding goes through the byte table: a token's characters, each back to its byte.
        size = max(ranks.values()) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, rank in ((self.tokenizer.id_to_token(r), r) for r in ranks.values()):
            self.token_bytes[rank] = bytes(map(self.byte.__getitem__, token))
        self.token_length = np.array([len(x) for x in self.token_bytes])
        self.memory: dict[str, bytes] = {}

    def encode_packed(self, texts: Iterable[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(x) for x in texts]
        every = set().union(*cut)
        new = list(every.difference(self.memory))
        if len(self.memory) + len(new) > MEMORY_PIECES:
            self.memory.clear()
            new = list(every)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            coded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.memory.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in coded), strict=True))
        out = [b"".join(map(self.memory.__getitem__, pieces)) for pieces in cut]
        for p in new:
            if len(p) > MEMORY_LENGTH:
                del self.memory[p]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_packed([text])[0], "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id that is not in the table raises IndexError."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode_stream(self, parts: Iterable[np.ndarray]) -> Iterable[str]:
        """Text of ids that come in parts; a character that two parts share comes with the later one."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield decoder.decode(self.decode_bytes(ids))
        yield decoder.decode(b"", True)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each token in characters, and whether it begins or ends inside a character.

        A token that holds a part of a character covers that character.
        """
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        first = (data & 0xC0) != 0x80  # a character's first byte
        place = np.append(np.cumsum(first) - 1, int(first.sum()))
        ends = np.cumsum(self.token_length[ids])
        starts = ends - self.token_length[ids]
        whole = np.append(first, True)
        return place[starts], np.where(ends > 0, place[np.maximum(ends - 1, 0)] + 1, 0), ~(whole[starts] & whole[ends])


_codecs: dict[tuple[int, str], ByteCodec] = {}


def _codec(rank_file: bytes, pattern: str) -> ByteCodec:
    """The worker's codec; workers serve many tasks."""
    key = (hash(rank_file), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ByteCodec(rank_file, pattern)
    return _codecs[key]


def _shared(df: DataFrame, path: str):
    """The rank file of the driver for all workers: a vocabulary, so of fixed size (under 1 MB here)."""
    ensure_workers(df.sparkSession)
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, starts, ends): tokens with their character offsets.

    A null or empty text gives empty arrays. Repeated rows and null ids are kept as they are; other columns are ignored.
    """
    ranks = _shared(df, path)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends"))])

    def start():
        codec = _codec(ranks.value, pattern)

        def f(batch: pa.RecordBatch) -> list:
            texts = strings(batch.column(1))
            ids = [np.frombuffer(x, "<u4") for x in codec.encode_packed(texts)]
            places = [codec.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
            return [batch.column(0), [x.astype(np.int32) for x in ids], [p[0].astype(np.int32) for p in places], [p[1].astype(np.int32) for p in places]]

        return f

    return map_rows(df.select(id_col, text_col), schema, start, 32)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) of rows (id, ids). Null ids give the empty text; bytes that are no UTF-8 become U+FFFD."""
    ranks = _shared(df, path)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def start():
        codec = _codec(ranks.value, pattern)
        return lambda batch: [batch.column(0), ["".join(codec.decode_stream([np.array(x or [], np.int64)])) for x in batch.column(1).to_pylist()]]

    return map_rows(df.select(id_col, ids_col), schema, start, 32)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document digests of its ids and of the bytes that these decode to, and how many tokens split a character.

    Null and empty texts give no tokens and the digests of no bytes. Every row of df gives one row.
    """
    ranks = _shared(df, path)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_split", T.LongType())])

    def start():
        codec = _codec(ranks.value, pattern)

        def f(batch: pa.RecordBatch) -> list:
            texts = strings(batch.column(1))
            packed = codec.encode_packed(texts)
            ids = [np.frombuffer(x, "<u4") for x in packed]
            split = [0 if t.isascii() else int(codec.offsets(t, x)[2].sum()) for t, x in zip(texts, ids, strict=True)]
            return [batch.column(0), [len(x) for x in ids], [hashlib.sha256(x).hexdigest() for x in packed], [hashlib.sha256(codec.decode_bytes(x)).hexdigest() for x in ids], split]

        return f

    return map_rows(df.select(id_col, text_col), schema, start)
