"""A sieve of bounded size for the keys of a table: rows whose key is not among them stay where they are read."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches
from .flat import mix

#: Bits for a key, how many of them it sets, and bits of a sieve at least and at most (32 MB, sent to all tasks); of other keys one in
#: 400 passes, and more only beyond 17 million keys.
BITS, PROBES, FEWEST, MOST = 16, 4, 1 << 21, 1 << 28
#: Bits of one of Spark's bitmaps.
BLOCK = 1 << 15

_SALT = np.uint64(0x5851F42D4C957F2D)


def _bits(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The numbers of the bits that keys set, probe by probe."""
    at = mix(keys.view(np.uint64) ^ _SALT)
    step = mix(at) | np.uint64(1)
    for _ in range(PROBES):
        yield (at & np.uint64(size - 1)).view(np.int64)
        at = at + step


class Sieve:
    """Lets all keys pass that it was made of, and few others."""

    def __init__(self, spark: SparkSession, bits: np.ndarray):
        self.sent = spark.sparkContext.broadcast(bits)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether each 64-bit key passes."""
        bits = self.sent.value
        out = np.ones(len(keys), bool)
        for at in _bits(keys, 8 * len(bits)):
            out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out

    def column(self, key: str) -> Column:
        """Whether the bigint column ``key`` passes; null does not."""

        def run(keys: pa.Array) -> pa.Array:
            return pa.array(self.passes(keys.fill_null(0).to_numpy(zero_copy_only=False)) & keys.is_valid().to_numpy(zero_copy_only=False))

        return F.arrow_udf(run, "boolean")(F.col(key))


def sieve(keys: DataFrame) -> Sieve:
    """A sieve of the one bigint column of ``keys``, without nulls, which is read twice.

    Blocks of the bits are made by the tasks and put together in the driver: a bitmap of ``MOST`` bits at most, whatever the keys.
    """
    spark = keys.sparkSession
    small_batches(spark)
    size = min(MOST, max(FEWEST, 1 << (BITS * keys.count()).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(_bits(batch.column(0).to_numpy(), size))))
            yield pa.RecordBatch.from_pydict({"block": pa.array((at // BLOCK).astype(np.int32)), "bit": pa.array(at % BLOCK)})

    blocks = keys.mapInArrow(lean(run), "block int, bit long").repartition("block").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for r in blocks.collect():
        bits[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return Sieve(spark, bits)
