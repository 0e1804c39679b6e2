"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from ..ship import ship

#: Bytes of text that one numpy pass holds at a time; a longer document makes a pass of its own.
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send the sources to the workers, and bound what Spark hands to one at once, so long texts cannot fill its memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


#: Paths of the tables that were written and not dropped since, in order.
made: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join in which no side is broadcast: what Spark takes for small by its bytes in files is many times that as the driver builds it."""
    return df.hint("merge")


def drop(spark: SparkSession, since: int, but: int = 0) -> None:
    """Delete the tables ``made`` from number ``since`` on, but for the last ``but`` ones, which is for callers that read them no more."""
    jvm = spark._jvm
    for path in made[since : len(made) - but]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        made.remove(path)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted now: Spark does so when the driver collects what refers to them, which may be long after."""
    for _ in range(2):  # what the first round frees lets go of the rest
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def release() -> None:
    """Give memory that Arrow and the C library hold for later back to the system: workers idle long, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """An Arrow function over batches that leaves its worker as small as it found it."""

    @functools.wraps(run)
    def trimmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return trimmed


def lean_group(run: Callable) -> Callable:
    """The same of a function over one group's table."""

    @functools.wraps(run)
    def trimmed(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            del table
            release()

    return trimmed


def passes(batches: Iterable[pa.RecordBatch], text: str, limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the ``text`` column of each holds at most ``limit`` bytes (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end
