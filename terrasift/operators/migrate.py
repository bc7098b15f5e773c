"""Versioned SQL scripts: order, checksums, pending scripts, and statements of a script."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"V(\d+(?:_\d+)*)__(\w[\w-]*)\.sql")
APPLIED = "version string, script_name string, checksum string, installed_on timestamp_ntz"
_piece = re.compile(r"'(?:[^']|'')*'?|\"(?:[^\"]|\"\")*\"?|`[^`]*`?|--[^\n]*|/\*.*?(?:\*/|\Z)|;|[^'\"`;/-]+|[/-]", re.DOTALL)
_trigger = re.compile(r"\s*create\s+(?:temp\w*\s+)?trigger\b", re.IGNORECASE)


@dataclass(frozen=True)
class Script:
    version: str
    name: str
    text: str

    @property
    def order(self) -> tuple[int, ...]:
        return tuple(map(int, self.version.split("_")))

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()


def version_order(version: Column) -> Column:
    """A sort key: the version's numbers."""
    return F.transform(F.split(version, "_"), lambda v: v.cast("int"))


def scripts(files: dict[str, str]) -> list[Script]:
    """Scripts of files (name to text) in order of version; other names are ignored, a repeated version raises."""
    out = sorted((Script(m[1], name, text) for name, text in files.items() if (m := NAME.fullmatch(name))), key=lambda s: s.order)
    for a, b in zip(out, out[1:]):  # noqa: B905
        if a.order == b.order:
            raise ValueError(f"{a.name} and {b.name} have the same version")
    return out


def statements(text: str) -> list[str]:
    """Statements that semicolons end outside quotes and comments; a trigger's body ends with END."""
    out, now = [], ""
    for m in _piece.finditer(text):
        if m[0] == ";" and not (_trigger.match(_bare(now)) and not re.search(r"\bend\s*$", _bare(now), re.IGNORECASE)):
            out.append(now.strip())
            now = ""
        else:
            now += m[0]
    return [s for s in [*out, now.strip()] if _bare(s).strip()]


def _bare(text: str) -> str:
    return "".join("" if m[0].startswith(("--", "/*")) else m[0] for m in _piece.finditer(text))


def pending(all_scripts: DataFrame, applied: DataFrame) -> DataFrame:
    """Scripts (version, script_name, checksum) that were not applied, in order."""
    return all_scripts.join(applied, "version", "left_anti").orderBy(version_order(F.col("version")))


def changed(all_scripts: DataFrame, applied: DataFrame) -> DataFrame:
    """Applied scripts whose text is another now."""
    was = applied.select("version", F.col("checksum").alias("_was"))
    return all_scripts.join(was, "version").filter(F.col("checksum") != F.col("_was")).drop("_was")


def run(spark: SparkSession, files: dict[str, str], folder: str) -> list[str]:
    """Applies pending scripts in order and notes each in folder; a changed one raises before anything runs."""
    found = scripts(files)
    path = f"{folder.rstrip('/')}/schema_migrations"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    applied = spark.read.schema(APPLIED).parquet(path) if exists else spark.createDataFrame([], APPLIED)
    mine = spark.createDataFrame([(s.version, s.name, s.checksum) for s in found], "version string, script_name string, checksum string")
    if bad := [r["script_name"] for r in changed(mine, applied).collect()]:
        raise ValueError(f"changed after they were applied: {', '.join(bad)}")
    todo = {r["version"] for r in pending(mine, applied).collect()}
    done = []
    for s in found:
        if s.version in todo:
            for statement in statements(s.text):
                spark.sql(statement)
            now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
            spark.createDataFrame([(s.version, s.name, s.checksum, now)], APPLIED).coalesce(1).write.mode("append").parquet(path)
            done.append(s.name)
    return done
