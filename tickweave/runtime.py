"""Session plumbing: shipping the package to executors and shared scratch tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()

#: Rows of an Arrow batch where the session has the default: whole texts make large rows, and every
#: task holds a batch in the JVM and in Python.
ARROW_ROWS, ARROW_DEFAULT = "2000", "10000"


#: By operator: a cached function, whose results a Python worker keeps from task to task.
_kept: dict[str, Callable] = {}


def kept_for(operator: str):
    """Decorates a function with ``lru_cache``: its results go when a worker begins a thrifty task of another operator."""

    def note(cached):
        _kept[operator] = cached
        return cached

    return note


def give_back() -> None:
    """Return freed memory to the system. Allocators keep it, and Spark's Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # only glibc has it
        trim(0)


def drop_kept(operator: str) -> None:
    """Drop what this worker keeps for operators other than the one named."""
    held = [cached for name, cached in _kept.items() if name != operator and cached.cache_info().currsize]
    for cached in held:
        cached.cache_clear()
    if held:
        gc.collect()
        give_back()


def thrifty(run: Callable[[Iterator], Iterator], operator: str) -> Callable[[Iterator], Iterator]:
    """``run``, for ``mapInArrow``, in a worker that holds no more than its task needs.

    The same workers serve all operators of a pipeline, beside a heap of the executor
    that only grows, so what one leaves behind would count in all that follow.
    """

    def task(batches):
        drop_kept(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Python operators are pickled by reference, so the workers must be able to
    import the package; a cluster's executors don't see the driver's folders.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == ARROW_DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tickweave-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent).as_posix())
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the
    session is a local one (as in tests) a temporary folder of this machine is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="tickweave-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


class Scratch:
    """Named Parquet tables in the shared folder that cut lineage.

    A table can be dropped as soon as what was derived from it is written; the
    rest goes when the driver ends. With ``compact``, tables are written by at most
    four tasks per core, each of which takes several partitions in turn: for many
    small tables, whose files and tasks would cost more than their rows.
    """

    def __init__(self, spark: SparkSession, name: str, compact: bool = False):
        self.spark, self.compact = spark, compact
        self.root = f"{shared_folder(spark)}/tickweave/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        (frame.coalesce(4 * self.spark.sparkContext.defaultParallelism) if self.compact else frame).write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(frame._scratch_path)

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            return

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
