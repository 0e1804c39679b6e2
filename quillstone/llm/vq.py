"""Vector code compression: product quantisation in whole numbers, searched by partial distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, written

#: Components become floor(SCALE * x); vectors are cut into PARTS parts, each coded by one of ENTRIES entries after ROUNDS rounds of learning.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Magnitude of whole components up to which a sum of squares of any length in use stays within 64 bits.
LARGEST = 1 << 27
#: Rows searched at a time, dimensions that are summed for all entries before the first are dropped, and dimensions between later drops.
ROWS, FIRST, STEP = 1024, 4, 2
#: Labels whose sums are sent to every task; more are met by a join.
SENT_LABELS = 10_000


class Book:
    """One part position's codebook, with its dimensions in descending order of the entries' variance (ties to the earlier one)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        spread = entries.astype(np.float64).var(0) if len(entries) else np.zeros(entries.shape[1])
        self.order = np.argsort(-spread, kind="stable")
        self.turned = np.ascontiguousarray(entries[:, self.order].T)  # a row for each dimension, most telling first

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each row; ties go to the lower index.

        After the first dimensions the entry that is nearest so far is measured in full: the row's best complete distance.  From then on
        an entry is dropped once what it has summed is strictly more than that; equal ones stay, so ties are decided at the end.
        """
        n, width = parts.shape
        code, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for a in range(0, n, ROWS):
            x = np.ascontiguousarray(parts[a : a + ROWS, self.order].T)
            sums = np.zeros((x.shape[1], self.turned.shape[1]), np.int64)
            for d in range(min(FIRST, width)):
                gap = x[d][:, None] - self.turned[d]
                sums += gap * gap
            guess = sums.argmin(1)
            best = ((x - self.turned[:, guess]) ** 2).sum(0)
            row, entry = np.nonzero(sums <= best[:, None])
            got = sums[row, entry]
            for d in range(FIRST, width, STEP):
                for e in range(d, min(d + STEP, width)):
                    gap = x[e][row] - self.turned[e][entry]
                    got += gap * gap
                alive = got <= best[row]
                row, entry, got = row[alive], entry[alive], got[alive]
            starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))  # the guess is never dropped, so each row has some
            least = np.minimum.reduceat(got, starts)
            hit = np.flatnonzero(got == least[row])
            first = hit[np.concatenate(([True], row[hit][1:] != row[hit][:-1]))]  # rows ascend, and entries within them
            code[a : a + ROWS], far[a : a + ROWS] = entry[first], least
        return code, far


def _sound(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of equal length as rows, filled up with zeros to ``PARTS`` parts of ``width``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x = x.reshape(len(column), len(x) // max(len(column), 1))
    return np.pad(x, ((0, 0), (0, PARTS * width - x.shape[1])))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector kept: vec_id, code, error, label_error, codebooks_sha256.

    Each round is one pass: tasks assign their rows and hand on at most one sum for each codebook entry, Spark adds these up, and the driver
    gets one row an entry (``PARTS * ENTRIES`` at most).  Sums are of whole numbers, so neither order nor retries change them.

    Rows whose vector is null or holds null or non-finite components are dropped, zero vectors stay.  Vectors of another length than the most
    common one (of equally common ones the shorter) take no part either.  A length that ``PARTS`` does not divide is filled up with zeros.
    With fewer vectors than ``ENTRIES`` the codebooks are that much smaller.  Null ids come last among the first entries, repeated ids in the
    order of their vectors; each row is coded, repeated ones too.  Null labels are one label.  A whole component beyond ``LARGEST`` in
    magnitude is an error, as its squares could pass 64 bits.  An empty table gives no rows; further columns play no part.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).where(_sound(F.col("v")))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = usual.d if usual else 0
    whole = F.transform("v", lambda x: F.when(F.abs(x * SCALE) < LARGEST, F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more in magnitude"))).cast("int"))
    rows = written(rows.where(F.size("v") == size).select("vec_id", "label", whole.alias("v")), "whole")
    width = -(-size // PARTS)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow().column(0).combine_chunks()
    books = _matrix(first, width).reshape(len(first), PARTS, width).transpose(1, 0, 2)  # part, entry, position

    def sums(shared):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            found = [Book(b) for b in books]
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0), width)
                    for p, book in enumerate(found):
                        part = x[:, p * width : (p + 1) * width]
                        code, _ = book.nearest(part)
                        order = np.argsort(code, kind="stable")
                        starts = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
                        used = code[order][starts]
                        count[p, used] += np.diff(np.append(starts, len(code)))
                        total[p, used] += np.add.reduceat(part[order], starts) if width else 0
            p, e = np.nonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), pa.array(total[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), lists], ["part", "entry", "n", "total"])

        return run

    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(books)
        parts = rows.select("v").mapInArrow(lean(sums(shared)), "part int, entry int, n long, total array<long>")
        columns = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
        new = books.copy()
        for r in parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns).collect():
            new[r.part, r.entry] = [r[2 + i + 1] // r.n for i in range(width)]
        books = new
        shared.destroy()

    shared = spark.sparkContext.broadcast(books)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Book(b) for b in shared.value]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2), width)
                got = [book.nearest(x[:, p * width : (p + 1) * width]) for p, book in enumerate(found)]
                codes = np.stack([c for c, _ in got], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(d for _, d in got))], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    out = rows.mapInArrow(lean(coded), f"vec_id long, label {kind}, code string, error long")
    out = written(out, "coded")
    labels = written(out.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "_label")
    if labels.count() <= SENT_LABELS:
        labels = F.broadcast(labels)
    out = out.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: a codebook table and an assignment for each round."""
    steps = [
        "v AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT r, p, w[p * len(w) // {PARTS} + 1 : (p + 1) * len(w) // {PARTS}] AS w FROM v, range({PARTS}) AS t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r - 1 AS e, w FROM p WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        gap = "list_sum(list_transform(range(1, len(p.w) + 1), lambda j: (p.w[j] - b.w[j]) * (p.w[j] - b.w[j])))::BIGINT"
        steps.append(f"d{i} AS (SELECT r, p.p, b.e, {gap} AS far FROM p JOIN b{i} AS b ON b.p = p.p)")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, min(far) AS far, arg_min(e, (far, e)) AS e FROM d{i} GROUP BY r, p)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT p, a.e, j, sum(w[j])::HUGEINT AS s, count(*) AS n FROM a{i} AS a JOIN p USING (r, p), range(1, 5000) AS t(j) WHERE j <= len(w) GROUP BY p, a.e, j)")
            steps.append(f"m{i} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS w FROM s{i} GROUP BY p, e)")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{i} AS b LEFT JOIN m{i} AS m ON m.p = b.p AND m.e = b.e)")
    steps += [
        f"c AS (SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)",
        f"h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})",
    ]
    text = "SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (r), h"
    return "WITH " + ",\n     ".join(steps) + "\n" + text


SQL = _sql()
