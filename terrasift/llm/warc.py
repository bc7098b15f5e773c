"""WARC archives: writing captures, reading records back, and assembling records to captures by their concurrent-to ids.

A page becomes three records: the request, a response (or a revisit of the response with the same payload) and metadata.
They are written by Spark's own text writer, so any store that Spark reaches will do: a row is the text of the records, and
the two line ends that close a WARC record are the writer's line separator. Files are gzip streams of many records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shared import ensure_workers
from .common import written


# Fixed values of the format.
VERSION, END, CLOSE = "WARC/1.1", "\r\n", "\r\n\r\n"
BASE32, RADIX32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file's payloads, before compression, in the mean; captures of a file at most.
FILE_BYTES, FILE_CAPTURES = 64 << 20, 20_000
#: Bits that say which payloads may be repeated.
PLACES = 1 << 25
#: Records, and bytes of their payloads, that a batch of the reader holds at most (one record more).
BATCH_RECORDS, BATCH_BYTES = 1_000, 16 << 20
DATE = "2024-01-01T00:00:00Z"

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


def digest(payload: Column) -> Column:
    """SHA-1 of a text in base 32, upper case: five hexadecimal digits are four of base 32."""
    hexes = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), RADIX32, BASE32)


def record_id(*parts: Column) -> Column:
    """A name-based record id of the values."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to its last block byte; null headers are left out."""
    lines = [F.concat(F.lit(f"{VERSION}{END}WARC-Type: {kind}{END}WARC-Record-ID: "), rid, F.lit(f"{END}WARC-Date: {DATE}{END}"))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CLOSE), block)


def _flagged(base: DataFrame, repeated: DataFrame) -> DataFrame:
    """base with column flagged: false only if no row of repeated has the row's digest. A bitmap of hashed digests, of PLACES
    bits, is broadcast; no page is shuffled."""
    place = F.pmod(F.xxhash64("digest"), F.lit(PLACES))
    bucket, position = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = repeated.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(position).alias("_bits"))
    marked = base.withColumn("_bucket", bucket).withColumn("_at", position).join(F.broadcast(maps), "_bucket", "left")
    octet = F.conv(F.hex(F.expr("substring(_bits, CAST(_at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("CAST(_at % 8 AS INT)")
    found = marked.withColumn("_octet", octet).withColumn("_bit", bit)
    flagged = F.coalesce(F.expr("(shiftright(_octet, _bit) & 1) = 1"), F.lit(False))
    return found.withColumn("flagged", flagged).drop("_bucket", "_at", "_bits", "_octet", "_bit")


def _lines(rows: DataFrame) -> DataFrame:
    """The text of each capture's three records: rows (own, id, url, digest, size, html), html null for a revisit."""
    own, size, url = F.col("own"), F.col("size"), F.col("url")
    sha = F.concat(F.lit("sha1:"), F.col("digest"))
    host = F.coalesce(F.regexp_extract("url", r"^\w+://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract("url", r"^\w+://[^/?#]*([^#]*)", 1), F.lit(""))
    target, together = ("WARC-Target-URI", url), ("WARC-Concurrent-To", own)
    asked = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{END}Host: "), host, F.lit(CLOSE))
    asking = ("Content-Type", F.lit("application/http; msgtype=request"))
    request = _record("request", record_id(F.lit("request"), own), [target, together, asking], asked)
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size.cast("string"), F.lit(CLOSE))
    http, checked = ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", sha)
    response = _record("response", own, [target, http, checked], F.concat(head, "html"))
    before = [("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id(F.lit("main"), F.col("digest")))]
    revisit = _record("revisit", own, [target, http, checked, *before], head)
    page = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit(END)), F.lit(""))
    fields = ("Content-Type", F.lit("application/warc-fields"))
    noted = F.concat(page, F.lit("payload-bytes: "), size.cast("string"), F.lit(END))
    metadata = _record("metadata", record_id(F.lit("metadata"), own), [target, together, fields], noted)
    main = F.when(F.col("html").isNotNull(), response).otherwise(revisit)
    return rows.select(F.concat(request, F.lit(CLOSE), main, F.lit(CLOSE), metadata).alias("value"))


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a capture per row of df under folder (must not exist).

    Of rows with equal payloads the one with the smallest id (nulls last; of those the smallest url, nulls last; of rows
    equal in all any one) is the response, the others revisit it. A null payload is empty, a null url has no target header.
    Line ends within a url are blanked. Other columns are ignored.

    Records are named by their content, so df may come in any order each time it is read. Only pages whose payload may be
    repeated are shuffled, of each task one for a payload; a file has some FILE_BYTES.
    """
    url = F.regexp_replace(F.col(url_col), r"[\r\n]+", " ")
    base = df.select(F.col(id_col).alias("id"), url.alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    base = base.withColumn("digest", digest(F.col("html"))).withColumn("size", F.octet_length("html").cast("long"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    counted = base.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    counted = written(counted, "warc-digests")
    total = counted.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    repeated = counted.filter("n > 1").select("digest", "first")
    marked = _flagged(base, repeated)
    main = record_id(F.lit("main"), F.col("digest"))
    columns = ["own", "id", "url", "digest", "size", "html"]
    single = marked.filter("not flagged").withColumn("own", main).select(*columns)
    maybe = written(marked.filter("flagged").drop("flagged"), "warc-repeated")
    kept = maybe.groupBy("digest", "size").agg(F.min(order).alias("first"), F.any_value("html").alias("html"))
    kept = kept.withColumn("own", main).withColumn("id", F.col("first.id")).withColumn("url", F.col("first.url")).select(*columns)
    # Rows equal in all are told apart by their number.
    again = maybe.groupBy("digest", "id", "url", "size").agg(F.count(F.lit(1)).alias("n")).join(repeated, "digest")
    again = again.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    is_main = F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("number") == 1)
    named = record_id(F.lit("again"), F.col("id").isNull(), F.col("id"), F.col("url").isNull(), F.col("url"), F.col("digest"), F.col("number"))
    again = again.filter(~is_main).withColumn("own", named).withColumn("html", F.lit(None).cast("string")).select(*columns)
    mean = int(total["bytes"] or 0) // max(1, int(total["n"] or 0)) + 1000
    lines = _lines(single.unionByName(kept).unionByName(again))
    captures_a_file = min(FILE_CAPTURES, max(1, FILE_BYTES // mean))
    lines.write.option("compression", "gzip").option("lineSep", CLOSE).option("maxRecordsPerFile", captures_a_file).text(folder)


def _header(stream: io.BufferedIOBase) -> list[tuple[str, str]]:
    """Named fields up to an empty line, names in lower case; continued lines are joined."""
    out: list[tuple[str, str]] = []
    while (line := stream.readline().rstrip(b"\r\n")) != b"":
        if line[:1] in b" \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out.append((name.strip().lower(), value.strip()))
    return out


def records(content: bytes) -> Iterator[tuple[dict, bytes | None]]:
    """The records of an archive, plain or of gzip members, in RECORD's columns, each with its payload.

    The digest of a response is computed from its payload; that of a revisit, which has none, is the one it declares.
    A file that ends within a record raises.
    """
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = _header(stream)
        get = dict(reversed(fields)).get
        size = int(get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        kind = get("warc-type")
        row = {"record_id": get("warc-record-id"), "record_type": kind, "target_uri": get("warc-target-uri")}
        row |= {"concurrent_to": [v for n, v in fields if n == "warc-concurrent-to"], "refers_to": get("warc-refers-to")}
        row |= {"payload_digest": None, "payload_bytes": None, "fields": None}
        payload = None
        if kind in ("response", "resource"):
            payload = block.partition(b"\r\n\r\n")[2] if (get("content-type") or "").startswith("application/http") else block
            row |= {"payload_bytes": len(payload), "payload_digest": _base32(hashlib.sha1(payload).digest())}
        elif kind == "revisit":
            row["payload_digest"] = (get("warc-payload-digest") or "").rpartition(":")[2] or None
        elif kind == "metadata":
            row["fields"] = list(dict(_header(io.BytesIO(block))).items())
        yield row, payload


def _base32(data: bytes) -> str:
    import base64

    return base64.b32encode(data).decode()


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all archives in folder, with their payloads (binary) if wanted."""
    ensure_workers(spark)
    schema = T.StructType([*RECORD.fields, T.StructField("payload", T.BinaryType())]) if payload else RECORD
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for content in batch.column(0):
                for row, body in records(content.as_py()):
                    if payload:
                        row["payload"] = body
                        held += len(body or b"")
                    rows.append(row)
                    if len(rows) >= BATCH_RECORDS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, schema)


def assemble(found: DataFrame, hops: int = 1) -> DataFrame:
    """One row per capture: its response, resource or revisit record (main) with its request and metadata records nested.

    A record belongs to a capture if either names the other as concurrent, directly or over up to hops - 1 other records.
    Of several requests or metadata records of a capture the one with the smallest id is nested (n_requests and n_metadata
    count them); without any the struct is null. Records of no capture, and those without an id, are left out. found is
    read several times, so pass a written table.
    """
    main = found.filter(F.col("record_type").isin("response", "resource", "revisit") & F.col("record_id").isNotNull())
    named = found.filter(F.size("concurrent_to") > 0).select("record_id", F.explode("concurrent_to").alias("other"))
    rest = found.filter(F.col("record_type").isin("request", "metadata"))
    # links: (record, record it is concurrent with) from a request or metadata record towards a capture
    links = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    home = links.join(main.select(F.col("record_id").alias("other")), "other", "left_semi").groupBy("record_id").agg(F.min("other").alias("capture"))
    for _ in range(hops - 1):
        further = links.join(home.withColumnRenamed("record_id", "other"), "other").groupBy("record_id").agg(F.min("capture").alias("capture"))
        home = home.unionByName(further.join(home, "record_id", "left_anti"))
    placed = rest.join(home, "record_id")
    columns = ["record_id", "target_uri", "fields"]

    def nested(kind: str, name: str) -> DataFrame:
        of = placed.filter(F.col("record_type") == kind)
        return of.groupBy("capture").agg(F.min_by(F.struct(*columns), "record_id").alias(kind), F.count(F.lit(1)).alias(name))

    every = F.struct(*[c for c in found.columns if c not in ("concurrent_to", "fields")]).alias("main")
    out = main.select(F.col("record_id").alias("capture"), every).join(nested("request", "n_requests"), "capture", "left").join(nested("metadata", "n_metadata"), "capture", "left")
    return out.withColumn("n_requests", F.coalesce("n_requests", F.lit(0))).withColumn("n_metadata", F.coalesce("n_metadata", F.lit(0)))


def captures(nested: DataFrame, id_type: T.DataType) -> DataFrame:
    """Per capture: page id, payload's bytes and digest, type, and the page id of the response that a revisit refers to."""
    flat = nested.select(F.expr("metadata.fields['page-id']").cast(id_type).alias("page_id"), F.coalesce("main.payload_bytes", F.expr("metadata.fields['payload-bytes']").cast("long")).alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"), F.col("main.record_type").alias("record_type"), F.col("main.refers_to").alias("_to"), F.col("capture"))
    pages = flat.filter("record_type = 'response'").select(F.col("capture").alias("_to"), F.col("page_id").alias("refers_to"))
    revisits = flat.filter("record_type <> 'response'").join(pages, "_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return flat.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast(id_type)).select(*columns).unionByName(revisits.select(*columns))
