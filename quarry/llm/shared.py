"""Tables written to the folder that all executors share.

Long plans are cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back: unlike a local
checkpoint, such a table outlives the executor that wrote it.  The folder is the cluster's own setting; where none is
set, a temporary one serves on a single machine (tests), and on a cluster that is an error.

All tables of an application lie in ``quarry-<application id>`` there.  Operators delete what they need no more; what
a result is read from stays until ``clean`` is called.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Most rows and bytes of a batch that goes to a Python worker, so that long texts do not fill its memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: A task holds one row group in memory while it writes; nobody looks for a mark that such a table is whole.
_WRITE = {"parquet.block.size": str(16 << 20), "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_KEY = "spark.checkpoint.dir"
_made_up: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """This application's folder among the shared ones."""
    sc = spark.sparkContext
    where = spark.conf.get(_KEY, None) or sc.getConf().get(_KEY) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        if sc.applicationId not in _made_up:
            _made_up[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        where = _made_up[sc.applicationId]
    return f"{where.rstrip('/')}/quarry-{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder; the result reads that table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.options(**_WRITE).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a session, unless Python there finds it by itself (PYTHONPATH or the
    working folder, as on one machine)."""
    root = Path(__file__).resolve().parents[2]
    known = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    sc = spark.sparkContext
    if root in known or getattr(sc, "_quarry_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (root / "quarry").rglob("*.py"):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._quarry_shipped = True


#: What a Python worker keeps from task to task, by the operator that keeps it.
KEPT: dict[str, object] = {}


def _trim() -> None:
    """Gives memory that is free back to the machine: workers stay alive between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _task(run: Callable, keeps: str | None) -> Callable:
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in [k for k in KEPT if k != keeps]:
            del KEPT[other]
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, what runs sends Python workers batches held to ``BATCH``; smaller settings of the user's stay, and all
    are as before afterwards."""
    conf, before = spark.conf, {}
    for key, most in BATCH.items():
        now = conf.get(key, None)
        size = int(now) if now and now.lstrip("-").isdigit() else -1
        if size <= 0 or size > most:
            before[key] = now
            conf.set(key, most)
    try:
        yield
    finally:
        for key, old in before.items():
            conf.unset(key) if old is None else conf.set(key, old)


def map_arrow(df: DataFrame, run: Callable, schema: str, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow``.  A task drops what operators other than ``keeps`` left in its worker's ``KEPT``, and frees its
    own memory.  Batches have the size of the session's settings; ``written`` and ``small_batches`` hold them down."""
    ship(df.sparkSession)
    return df.mapInArrow(_task(run, keeps), schema)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_quarry_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all tables of this application; results not yet read are gone."""
    remove(spark, folder(spark))
