"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: The same characters, literally.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker takes at once.
SLICE_BYTES = 8 << 20
#: Rows of a narrow table that a file should get.
FILE_ROWS = 100_000
#: Applications that have the package already.
_sent: set[str] = set()


def text_of(column: str = "text") -> Column:
    """The column as a string; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``; where that is unset a temporary folder
    serves on one machine, and a cluster, whose machines do not share one, is refused.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.gettempdir()
    return f"{base.rstrip('/')}/chronolith-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    A lost executor costs a re-read, not a recomputation.  The files go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a narrow table of about ``rows`` rows, in no more partitions than they need, or than there are cores if those are more.

    To create a file in a local folder an executor starts several processes, each for a
    moment a copy of the executor; a file for each shuffle partition would be thousands.
    The rows are the same whatever ``rows`` is.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


@functools.cache
def _package() -> str:
    """This package's modules as a zip archive, in a folder that goes when the driver ends."""
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{root.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
            archive.write(file, file.relative_to(root.parent))
    return path


def give_back() -> None:
    """Return freed memory to the machine; otherwise a worker that waits keeps what its largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` by workers that have this package, installed there or not, and that keep no memory between tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    context = df.sparkSession.sparkContext
    if context.applicationId not in _sent:
        context.addPyFile(_package())
        _sent.add(context.applicationId)
    return df.mapInArrow(task, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about SLICE_BYTES of the named string column."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = taken = 0
    for i, n in enumerate(sizes):
        taken += n or 0
        if taken >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, taken = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)
