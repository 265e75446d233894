"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Text handled at once inside a task; longer batches are cut into slices of whole rows.
SLICE_BYTES = 4 << 20
#: Rows of a few numbers that are broadcast at most.
FEW = 250_000
#: Bytes of the rows that Spark hands to Python at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, a temporary folder is set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Let rows reach Python in batches of at most ``BATCH_BYTES``, whatever their texts' lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:  # a size with another unit is the user's own
        spark.conf.set(name, f"{BATCH_BYTES}b")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but as compressed Parquet that survives lost executors.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no later step reads."""
    path = getattr(df, "_materialized_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that Spark deletes the shuffle files of tables that have been written down."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``most`` bytes; a longer row stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` that gives the memory it has freed back to the system when its task ends; a Python worker lives on for other tasks."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # what only the GNU library has
            ctypes.CDLL(None).malloc_trim(0)

    return ran


def text_bytes(column) -> tuple:
    """The bytes of a string column as one numpy array, and the n + 1 offsets; null is empty."""
    import numpy as np
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def small_enough(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most ``most`` rows; reads no more than it has to."""
    return len(df.select(F.lit(1)).limit(most + 1).take(most + 1)) <= most


def pre_tokens(data, offsets, cut) -> tuple:
    """Cut texts into pre-tokens: ``(strings, starts, first)``.

    ``data``, ``offsets``: as of :func:`text_bytes`. ``cut[i]``: whether a pre-token begins at byte i
    (the start of each text is added). ``strings`` is an Arrow array that shares the bytes of ``data``;
    ``first[k]`` is the index of the first pre-token of text k, with one more entry for the end.
    """
    import numpy as np

    cut = np.append(cut, False)
    cut[offsets[:-1]] = True
    cut = cut[:-1]
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(data)).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    return strings, starts, np.searchsorted(starts, offsets, side="left")
