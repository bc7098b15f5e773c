"""What driver and executors share: tables that are kept for later stages, and this package itself."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Paths that this process has given out and not removed, oldest first.
_given: list[str] = []


def ensure_workers(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster that installs the package on every node (or ships it by --py-files) this changes nothing.
    """
    spark = spark or SparkSession.active()
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or the checkpoint folder set on the context.

    A local master without one, as in tests, gets a temporary folder; a cluster without one raises, since its executors
    would write to their own disks.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if base:
        return str(base).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terrasift-"))
    return shared_base(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder; paths that are gone are no error."""
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        if path in _given:
            _given.remove(path)


def release(spark: SparkSession) -> None:
    """Lets the session delete the shuffle files of finished queries now, not when the driver next runs out of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def tables_of_run(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at the end, the tables that operators wrote to the shared folder in between.

    DataFrames that still read them must be written elsewhere first. Paths put on the yielded list stay.
    """
    before, kept = set(_given), []
    try:
        yield kept
    finally:
        remove(spark, *[p for p in list(_given) if p not in before and p not in kept])


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the session's checkpoint folder; lost executors cost nothing of it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()
