"""Approximate nearest neighbours: multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, written

#: Bits of a code at least, bits of a substring, rows the rotations and the radius are learned on, rows of one index.
BITS, SUB, SAMPLE, INDEX = 128, 8, 8_000, 16_384
#: Queries that are sent to the tasks at a time; more queries go in more blocks, one after the other.
BLOCK = 20_000
#: Share of the sample's true neighbours that must lie within the learned radius.
COVER = 0.96
#: Share of the sample that probing may reach, and values that one query may probe of a substring, for buckets to be shuffled.
REACH, PROBES = 0.2, 5000

_count = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Substrings by Hamming distance: those to exclusive-or a substring with to get all at that distance.
_masks = [np.flatnonzero(_count == r).astype(np.uint8) for r in range(SUB + 1)]


class Codes:
    """Rotations learned by alternating between signs and the rotation that fits them best, and the search radius."""

    def __init__(self, x: np.ndarray, k: int, iterations: int = 15):
        rng = np.random.default_rng(31)
        n, d = x.shape
        self.mean = x.mean(0) if n else np.zeros(d)
        y = x - self.mean
        self.turns = []
        axes = np.linalg.svd(y, full_matrices=False)[2] if n >= d else np.eye(d)
        for _ in range(-(-BITS // d)):
            turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(iterations if n >= d else 0):
                u, _, vt = np.linalg.svd(np.where((z := y @ axes.T) @ turn >= 0, 1.0, -1.0).T @ z)
                turn = (u @ vt).T
            self.turns.append(axes.T @ turn)
        ask = x[:: max(1, n // 300)][:300]
        code, own = self.encode(x), self.encode(ask)
        seen = []
        for q, c in zip(ask, own, strict=True):
            near = np.argsort(((x - q) ** 2).sum(1), kind="stable")[: k + 1]
            seen.append(_count[code[near] ^ c].sum(1)[1:])
        self.radius = int(np.ceil(np.quantile(np.concatenate(seen), COVER))) if n > 1 else self.bits // 4

    @property
    def bits(self) -> int:
        return -(-sum(t.shape[1] for t in self.turns) // SUB) * SUB

    def reach(self, x: np.ndarray, sub: int) -> tuple[list[int], int, float]:
        """With substrings of ``sub`` bits: how far each is probed for the radius, values probed of one at most, and which share of ``x`` that reaches."""
        parts = -(-self.bits // sub)
        r, a = divmod(self.radius, parts)
        far = [r if j <= a else r - 1 for j in range(parts)]
        bits = np.unpackbits(self.encode(x), axis=1).astype(np.float32)
        ask = bits[:: max(1, len(bits) // 200)][:200]
        hit = np.zeros((len(ask), len(bits)), bool)
        for j, f in enumerate(far):
            p, q = bits[:, j * sub : (j + 1) * sub], ask[:, j * sub : (j + 1) * sub]
            hit |= q.sum(1)[:, None] + p.sum(1)[None, :] - 2 * q @ p.T <= f
        return far, sum(comb(sub, i) for i in range(min(r, sub) + 1)), float(hit.mean()) if hit.size else 0.0

    def encode(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes, the substrings, for each vector."""
        return np.packbits(np.concatenate([(x - self.mean) @ t >= 0 for t in self.turns], 1), axis=1)


class Index:
    """Multi-index hashing: for each substring of the codes, a table from its value to the rows that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.bound = [np.concatenate(([0], np.cumsum(np.bincount(c, minlength=256)))) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is at Hamming distance ``radius`` or less.

        With m substrings and radius = m r + a, such a code is within r in one of the first a + 1 substrings or within r - 1 in
        another (pigeonhole), so probing those values misses none.
        """
        m = len(self.order)
        r, a = divmod(radius, m)
        hit = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = r if j <= a else r - 1
            if reach < 0:
                continue
            if reach >= SUB:
                hit[:] = True
                break
            for value in (code[j] ^ np.concatenate(_masks[: reach + 1])).tolist():
                hit[self.order[j][self.bound[j][value] : self.bound[j][value + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[_count[self.codes[rows] ^ code].sum(1) <= radius]


def _usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _values(bits: int, most: int) -> list[int]:
    """All numbers of ``bits`` bits of which ``most`` or fewer are set."""
    out, last = [0], [(0, -1)]
    for _ in range(min(bits, most)):
        last = [(v | 1 << b, b) for v, top in last for b in range(top + 1, bits)]
        out += [v for v, _ in last]
    return out


def _bucketed(rows: DataFrame, asked: DataFrame, codes: Codes, sub: int, far: list[int], k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, q, vec_id, score) of all within the radius, by buckets of (substring, value) that are shuffled, and the queries (q, vec_id, v) with fewer than ``k``.

    Rows go to the bucket of each of their substrings with their codes alone; queries to those of the values they probe, so a query
    meets no rows but those its probes hit.  Vectors are joined to what lies within the radius, for the rerank.
    """
    spark, parts, words = rows.sparkSession, len(far), -(-codes.bits // 64)
    shared = spark.sparkContext.broadcast(codes)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bits = np.unpackbits(shared.value.encode(x), axis=1)
                pad = lambda size: np.pad(bits, ((0, 0), (0, size - bits.shape[1])))
                subs = pad(parts * sub).reshape(len(bits), parts, sub) @ (1 << np.arange(sub, dtype=np.int64))
                code = np.packbits(pad(words * 64), axis=1).view("<i8")
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(subs), lists(code)], ["vec_id", "subs", "code"])

    kind = "vec_id long, subs array<long>, code array<long>"
    coded = rows.mapInArrow(lean(encode), kind)
    index = coded.select("vec_id", "code", F.posexplode("subs").alias("j", "value"))
    asks = written(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    own = asks.select("q", "v").withColumnRenamed("q", "vec_id").mapInArrow(lean(encode), kind)
    masks = spark.createDataFrame([(j, v) for j, f in enumerate(far) if f >= 0 for v in _values(sub, f)], "j int, mask long")  # PROBES a substring at most
    probes = own.select(F.col("vec_id").alias("q"), F.col("code").alias("own"), F.posexplode("subs").alias("j", "at")).join(F.broadcast(masks), "j")
    probes = probes.select("q", "own", "j", F.col("at").bitwiseXOR(F.col("mask")).alias("value"))
    apart = F.aggregate(F.zip_with("own", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = probes.join(index, ["j", "value"]).where(apart <= codes.radius).select("q", "vec_id").distinct()
    full = near.join(asks.select("q", F.col("vec_id").alias("query_id"), F.col("v").alias("x")), "q").where("vec_id <> query_id").join(rows, "vec_id")
    score = F.sqrt(F.aggregate(F.zip_with("x", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda x, y: x + y))
    full = full.select("query_id", F.col("q").alias("q"), "vec_id", score.alias("score"))
    best = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    found = written(full.withColumn("place", best).where(F.col("place") <= k).drop("place"), "found")
    enough = found.groupBy("q").count().where(F.col("count") >= k)
    return found, written(asks.join(enough, "q", "left_anti"), "few")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", reach: float = REACH) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id, score (Euclidean distance of the original vectors in double precision).

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those of the query's id.  Codes
    and radius are learned on about ``SAMPLE`` rows at most, picked by hash.  Substrings have about as many bits as the number of rows.

    Where probing the radius reaches less than ``reach`` of the sample, buckets of (substring, value) are shuffled and a query meets only what
    it probes (see ``_bucketed``).  Queries with fewer than ``k`` rows within the radius, and all queries where the radius is too wide
    for buckets to tell rows apart, as of vectors without clusters, go to indexes of ``INDEX`` rows in the rows' tasks, in
    blocks of about ``BLOCK`` queries, one block after the other: the driver holds one block.  Each index returns the nearest ``k`` of
    what lies within the radius; where that is fewer, the radius grows until there are ``k`` or no more rows.

    Vectors that are null, zero, hold null or non-finite components or differ in length from most take no part, nor do
    rows without an id.  Ties go to the smaller id; of rows that repeat a query's id and vector one asks.  Of rows that repeat any other
    id and vector each is a candidate.  An empty table has no rows; further columns play no part.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == usual.d)
    n = rows.count()
    part = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000_000)) < F.lit(int(1e9 * SAMPLE / n)))
    sample = part.orderBy("vec_id", "v").select("v").toArrow().column(0).combine_chunks()
    x = sample.values.to_numpy(zero_copy_only=False).reshape(-1, usual.d)
    codes = Codes(x, k)
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    sub = max(8, min(30, int(np.log2(n))))
    far, probed, share = codes.reach(x, sub)
    order = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if share < reach and probed <= PROBES:
        found, few = _bucketed(rows, asked, codes, sub, far, k)
        if not few.limit(1).count():
            return top(found)
        return top(found.join(few.select("q"), "q", "left_anti")).unionByName(top(_blocks(spark, rows, few.select("vec_id", "v"), codes, usual.d, k)))
    return top(_blocks(spark, rows, asked, codes, usual.d, k))


def _blocks(spark: SparkSession, rows: DataFrame, asked: DataFrame, codes: Codes, size: int, k: int) -> DataFrame:
    """(query_id, q, vec_id, score): the nearest ``k`` that each index of ``INDEX`` rows has for each query."""
    kind = "query_id long, q long, vec_id long, score double"
    blocks = max(1, -(-asked.count() // BLOCK))

    def search(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, ids, ask = shared.value
            own = codes.encode(ask) if len(ids) else None
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

            def block(parts: list[pa.RecordBatch]) -> None:
                table = pa.Table.from_batches(parts).combine_chunks()
                who = table.column(0).to_numpy()
                lists = table.column(1).combine_chunks()
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(who), -1)
                index = Index(codes.encode(x))
                for i, (q, code) in enumerate(zip(ask, own, strict=True)):
                    radius = codes.radius
                    while True:
                        at = index.within(code, radius)
                        at = at[who[at] != ids[i]]
                        if len(at) >= k or radius >= codes.bits:
                            break
                        radius += SUB
                    far = np.sqrt(((x[at] - q) ** 2).sum(1))
                    w, s = np.concatenate((best[i][0], who[at])), np.concatenate((best[i][1], far))
                    take = np.lexsort((w, s))[:k]
                    best[i] = w[take], s[take]

            parts, held = [], 0
            for batch in batches:
                if batch.num_rows and len(ids):
                    parts.append(batch)
                    held += batch.num_rows
                    if held >= INDEX:
                        block(parts)
                        parts, held = [], 0
            if parts:
                block(parts)
            for i in range(0, len(ids), 1000):
                some = range(i, min(i + 1000, len(ids)))
                n = [len(best[j][0]) for j in some]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(ids[i : i + 1000], n)), "q": pa.array(np.repeat(np.arange(i, i + len(n)), n)),
                    "vec_id": pa.array(np.concatenate([best[j][0] for j in some])), "score": pa.array(np.concatenate([best[j][1] for j in some])),
                })

        return run

    found = None
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id", "v").toArrow()
        ids = got.column(0).combine_chunks().to_numpy()
        ask = got.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), size)
        shared = spark.sparkContext.broadcast((codes, ids, ask))
        part = rows.mapInArrow(lean(search(shared)), kind)
        if blocks > 1:  # let go of this block before the next
            part = written(part, "block")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found
