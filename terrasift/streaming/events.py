"""Progress events as streams: envelopes, chunking, what cumulative texts add, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import chunks, iso
from ..shared import ensure_workers

# Kinds of events.
KINDS = ("start", "progress", "error", "end", "agent_start", "agent_progress", "agent_end")


def envelope(kind: Column, payload: Column, at: Column, request_id: Column) -> Column:
    """The event as a struct; an unknown kind raises."""
    checked = F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), kind)).cast("string"))
    return F.struct(checked.alias("type"), iso(at).alias("timestamp"), F.coalesce(request_id, F.lit("")).alias("request_id"), payload.alias("payload"))


def sse(event: Column, data: Column) -> Column:
    """A server-sent event's text."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def text_chunks(df: DataFrame, keys: list[str], text: str, size: int = 200, most_chars: int = 12_000, most_chunks: int = 200) -> DataFrame:
    """Rows (keys, chunk_index, delta, is_final_chunk): the pieces of each text, then an empty final one. Texts without any
    piece have no rows. Works on streams too: nothing is kept."""
    pieces = chunks(F.col(text), size, most_chars, most_chunks)
    final = F.struct(F.lit("").alias("delta"), F.lit(True).alias("is_final_chunk"))
    all_pieces = F.when(F.size(pieces) > 0, F.concat(F.transform(pieces, lambda p: F.struct(p.alias("delta"), F.lit(False).alias("is_final_chunk"))), F.array(final)))
    return df.select(*keys, F.posexplode(all_pieces).alias("chunk_index", "p")).select(*keys, "chunk_index", "p.delta", "p.is_final_chunk")


def until_end(df: DataFrame, request: str = "request_id", order: str = "seq", kind: str = "kind") -> DataFrame:
    """Events of each request up to its first end; what comes later is dropped."""
    last = df.filter(F.col(kind) == "end").groupBy(request).agg(F.min(order).alias("_end"))
    return df.join(last, request, "left").filter(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def tool_times(df: DataFrame, call: str = "call_id", kind: str = "kind", at: str = "ts") -> DataFrame:
    """Per tool call its milliseconds from start to end or error (null if it has not ended), and whether it failed."""
    closed = F.col(kind).isin("end", "error")
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    return df.groupBy(call).agg((F.max(F.when(closed, millis(F.col(at)))) - F.min(F.when(F.col(kind) == "start", millis(F.col(at))))).alias("elapsed_ms"), F.bool_or(F.col(kind) == "error").alias("failed"))


def step(previous: str, mode: str, incoming: str) -> tuple[str, str, str]:
    """(delta, new previous, new mode) of a text that follows previous. Modes: unknown, cumulative, delta.

    A first text is new. While unknown, a text that extends the last one shows cumulative texts, as does one that it
    extends; an equal one shows nothing; another shows deltas. Once known the mode stays.
    """
    if not incoming:
        return "", previous, mode
    if mode == "delta" or not previous:
        return incoming, incoming, mode
    extends = incoming.startswith(previous) and len(incoming) > len(previous)
    if mode == "unknown":
        if incoming == previous:
            return "", previous, mode
        mode = "cumulative" if extends or previous.startswith(incoming) else "delta"
        if mode == "delta":
            return incoming, incoming, mode
    if extends:
        return incoming[len(previous) :], incoming, mode
    return ("", previous, mode) if len(incoming) <= len(previous) else (incoming, incoming, mode)


def stream_deltas(df: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "text") -> DataFrame:
    """Rows (key, order, delta) of a stream whose texts are either cumulative or deltas, told per key as they come.

    The state of a key is its last text and its mode. Rows of a batch are taken in their order.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous, mode = state.get if state.exists else ("", "unknown")
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for seq, incoming in zip(rows[order], rows[text], strict=True):
            delta, previous, mode = step(previous, mode, incoming or "")
            if delta:
                out.append((k[0], seq, delta))
        state.update((previous, mode))
        yield pd.DataFrame(out, columns=[key, order, "delta"])

    ensure_workers(df.sparkSession)
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, delta string"
    return df.groupBy(key).applyInPandasWithState(update, schema, "previous string, mode string", "append", GroupStateTimeout.NoTimeout)


def stream_buffers(df: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "delta", end: str = "is_end") -> DataFrame:
    """Rows (key, text): what a key's deltas add up to, sent when its end comes; then its state goes."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ("",)
        for delta, is_end in pd.concat(list(frames)).sort_values(order, kind="stable")[[text, end]].itertuples(index=False):
            held += delta or ""
            if is_end:
                yield pd.DataFrame([(k[0], held)], columns=[key, "text"])
                if state.exists:
                    state.remove()
                return
        state.update((held,))
        yield pd.DataFrame([], columns=[key, "text"])

    ensure_workers(df.sparkSession)
    return df.groupBy(key).applyInPandasWithState(update, f"{key} {dict(df.dtypes)[key]}, text string", "held string", "append", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, at: str, width: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts per window (tumbling, or sliding with slide) and keys; with late, a watermark for streams."""
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.window(at, width, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")


def sessions(df: DataFrame, at: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key: rows less than gap apart; with late, a watermark for streams."""
    rows = df.withWatermark(at, late) if late else df
    return rows.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def distinct_events(df: DataFrame, at: str, keys: list[str], late: str) -> DataFrame:
    """Each key's first event within the watermark; later copies go."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)
