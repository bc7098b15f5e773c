"""Shapefiles as a Spark data source: a partition per file, attributes with geometry (WKB) and srid."""

from __future__ import annotations

import datetime as dt
import re
import struct
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import geometry as G
from ..shared import ensure_workers

# Fixed values of the formats.
SHAPES = {0: 0, 1: 1, 3: 5, 5: 6, 8: 4, 11: 1, 13: 5, 15: 6, 18: 4, 21: 1, 23: 5, 25: 6, 28: 4}
OVERWRITE = {"true": True, "replace": True, "1": True, "yes": True, "y": True, "overwrite": True, "false": False, "0": False, "no": False, "n": False, "skip": False, "fail": False}


def overwrites(if_exists: object) -> bool:
    """Whether an existing table is replaced (else the write is skipped); an unknown policy raises."""
    key = str(if_exists).strip().lower()
    if key not in OVERWRITE:
        raise ValueError(f"unknown policy {if_exists!r}")
    return OVERWRITE[key]


def files(path: str) -> list[Path]:
    """The shapefile, or those of a folder (not of folders in it); FileNotFoundError for a missing path."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    return sorted(f for f in p.iterdir() if f.suffix.lower() == ".shp") if p.is_dir() else [p]


def _beside(shp: Path, suffix: str) -> Path | None:
    return next((f for f in shp.parent.iterdir() if f.stem == shp.stem and f.suffix.lower() == suffix), None)


def table_fields(shp: Path) -> list[tuple[str, str, int, int]]:
    """Name, kind, length and decimals of each attribute."""
    dbf = _beside(shp, ".dbf")
    if not dbf:
        return []
    with dbf.open("rb") as f:
        head = f.read(32)
        raw = f.read(struct.unpack("<H", head[8:10])[0] - 32)
    out = []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        d = raw[at : at + 32]
        out.append((d[:11].split(b"\0")[0].decode("ascii", "replace"), chr(d[11]), d[16], d[17]))
    return out


def _type(kind: str, decimals: int) -> str:
    return {"N": "double" if decimals else "long", "F": "double", "L": "boolean", "D": "date"}.get(kind, "string")


def _value(raw: bytes, kind: str, decimals: int, encoding: str):
    text = raw.decode(encoding, "replace").strip("\0 ")
    if kind == "L":
        return {"y": True, "t": True, "n": False, "f": False}.get(text.lower())
    if not text or set(text) == {"*"}:
        return None
    if kind in "NF":
        return float(text) if decimals or kind == "F" else int(float(text))
    if kind == "D":
        return dt.datetime.strptime(text, "%Y%m%d").date()
    return text


def rows_of(shp: Path) -> Iterator[tuple]:
    """Attribute values of each record that is not deleted."""
    dbf, fields = _beside(shp, ".dbf"), table_fields(shp)
    if not dbf:
        return
    cpg = _beside(shp, ".cpg")
    encoding = cpg.read_text().strip() if cpg else "utf-8"
    with dbf.open("rb") as f:
        head = f.read(32)
        count, start, size = struct.unpack("<IHH", head[4:12])
        f.seek(start)
        for _ in range(count):
            record, at, values = f.read(size), 1, []
            for _, kind, width, decimals in fields:
                values.append(_value(record[at : at + width], kind, decimals, encoding))
                at += width
            yield tuple(values) if record[:1] != b"*" else None


def shapes_of(shp: Path) -> Iterator[bytes | None]:
    """WKB of each record; null shapes are None. Rings turned clockwise are outer ones, others holes of the outer before."""
    with shp.open("rb") as f:
        f.seek(100)
        while head := f.read(8):
            body = f.read(2 * struct.unpack(">I", head[4:8])[0])
            kind = SHAPES.get(struct.unpack("<I", body[:4])[0])
            if kind is None:
                raise ValueError(f"unknown shape in {shp.name}")
            if kind == 0:
                yield None
            elif kind == 1:
                yield G.to_wkb((1, struct.unpack("<2d", body[4:20]), 0))
            elif kind == 4:
                (n,) = struct.unpack("<I", body[36:40])
                flat = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
                yield G.to_wkb((4, list(zip(flat[::2], flat[1::2], strict=True)), 0))
            else:
                parts, n = struct.unpack("<II", body[36:44])
                cuts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), n]
                flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
                points = list(zip(flat[::2], flat[1::2], strict=True))
                lines = [points[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
                if kind == 5:
                    yield G.to_wkb((2, lines[0], 0) if len(lines) == 1 else (5, lines, 0))
                    continue
                polygons: list[list] = []
                for r in lines:
                    if G.ring_area(r[:-1]) < 0 or not polygons:
                        polygons.append([r])
                    else:
                        polygons[-1].append(r)
                yield G.to_wkb((3, polygons[0], 0) if len(polygons) == 1 else (6, polygons, 0))


def srid_of(shp: Path) -> int:
    """The system that the projection file names: 4326 (also without a file), 3857 or a UTM zone; another raises."""
    prj = _beside(shp, ".prj")
    text = prj.read_text().upper() if prj else ""
    if not text.strip() or text.lstrip().startswith("GEOGCS") and ("WGS" in text or "ETRS" in text):
        return 4326
    if "PSEUDO" in text or "MERCATOR_AUXILIARY" in text or "3857" in text:
        return 3857
    if m := re.search(r"UTM[ _]ZONE[ _](\d{1,2})([NS])", text):
        return {"N": 32600, "S": 32700}[m[2]] + int(m[1])
    raise ValueError(f"no reprojection for {shp.name}")


def write_points(rows: list[tuple], names: list[str], path: str, srid: int = 4326) -> None:
    """Writes a shapefile of points with text attributes: rows of (x, y, values); a shapefile is one file, so rows are few."""
    shp = Path(path)
    width = [max([1, *(len(str(r[2 + k]).encode()) for r in rows)]) for k in range(len(names))]
    body = b"".join(struct.pack(">ii", n, 10) + struct.pack("<idd", 1, float(r[0]), float(r[1])) for n, r in enumerate(rows, 1))
    xs, ys = [r[0] for r in rows] or [0.0], [r[1] for r in rows] or [0.0]
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, 1, min(xs), min(ys), max(xs), max(ys), 0, 0, 0, 0)
    shp.write_bytes(head + body)
    fields = b"".join(struct.pack("<11sc4xBB14x", n.encode()[:10], b"C", w, 0) for n, w in zip(names, width, strict=True))
    size = 1 + sum(width)
    table = struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 33 + len(fields), size) + fields + b"\r"
    cells = (b" " + b"".join(str(v).encode().ljust(w) for v, w in zip(r[2:], width, strict=True)) for r in rows)
    shp.with_suffix(".dbf").write_bytes(table + b"".join(cells) + b"\x1a")
    zone, half = srid % 100, "N" if srid // 100 == 326 else "S"
    known = {4326: 'GEOGCS["WGS 84"]', 3857: 'PROJCS["WGS 84 / Pseudo-Mercator"]'}
    shp.with_suffix(".prj").write_text(known.get(srid) or f'PROJCS["WGS 84 / UTM zone {zone}{half}"]')


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(str(f)) for f in files(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        shp = Path(partition.path)
        srid, attributes = srid_of(shp), rows_of(shp)
        for shape in shapes_of(shp):
            row = next(attributes, ())
            if row is not None:
                yield (*row, shape, srid)


class ShapefileSource(DataSource):
    """format("shapefile").load(file or folder of files with the same attributes)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        first = files(self.options["path"])[0]
        return ", ".join([*(f"`{n}` {_type(k, d)}" for n, k, _, d in table_fields(first)), "geometry binary", "srid int"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Features of one file or of a folder in EPSG:4326, repaired."""
    ensure_workers(spark)
    spark.dataSource.register(ShapefileSource)
    df = spark.read.format("shapefile").load(path)
    moved = F.when(F.col("srid") == 4326, F.col("geometry")).otherwise(G.st_transform("geometry", F.lit(4326)))
    return df.withColumn("geometry", G.make_valid(moved)).withColumn("srid", F.lit(4326))


def import_tables(spark: SparkSession, path: str, table: str | None = None, schema: str | None = None, if_exists: object = "skip") -> dict[str, str]:
    """Writes each file as a table named after it (a single file: table, if given); returns what became of each."""
    replace, found = overwrites(if_exists), files(path)
    if schema:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{schema}`")
    out = {}
    for shp in found:
        name = table if table and len(found) == 1 and not Path(path).is_dir() else shp.stem
        full = f"{schema}.{name}" if schema else name
        if spark.catalog.tableExists(full) and not replace:
            out[name] = "skipped"
            continue
        read(spark, str(shp)).write.mode("overwrite").saveAsTable(full)
        out[name] = "written"
    return out
