"""An inverted-file table of vectors: rows stored by cell, searched exactly by reading the cells that may hold an answer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from ..ship import ship
from .lexical import ranked
from .nearjoin import lists, unit_rows

#: Rows that centroids are learned from at most, centroids at most, rounds, and rows and queries that meet in one task.
SAMPLE, CELLS, ROUNDS, BLOCK, ASKED = 20_000, 2048, 6, 4096, 1024


def learn(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors by alternating assignment and means."""
    rng = np.random.default_rng(17)
    c = x[rng.permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class VectorTable:
    """Vectors below ``root``: ``rows`` (cell, block, id, archived, v) sorted by cell, and ``cells`` (cell, n, blocks, radius, center), ``CELLS`` at most."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        ship(spark)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/cells")

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> VectorTable:
        """Store (id, v[, archived]).  Centroids are learned from ``sample`` rows at most, picked by hash; every row is stored, in its nearest centroid's cell.

        A cell's radius is its rows' greatest distance to the centroid.  Vectors have unit length, zero ones stay zero.
        """
        given = vectors.select("id", F.col("v").cast("array<double>").alias("v"), (F.coalesce("archived", F.lit(False)) if "archived" in vectors.columns else F.lit(False)).alias("archived"))
        n = given.count()
        share = min(1.0, sample / max(n, 1))
        some = given.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000_000)) < F.lit(int(1e9 * share))).select("v").toArrow().column(0).combine_chunks()
        x = unit_rows(some, len(some))
        centers = learn(x, min(cells or max(1, int(np.sqrt(n))), CELLS)) if len(x) else np.zeros((1, 0))
        shared = self.spark.sparkContext.broadcast(centers)
        kind = given.schema["id"].dataType.simpleString()

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    x = unit_rows(part.column(1), part.num_rows)
                    square = np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T)
                    own = square.argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.sqrt(square[np.arange(len(x)), own])), part.column(0), part.column(2), lists(x)], ["cell", "far", "id", "archived", "v"])

        placed = kept(given.mapInArrow(assign, f"cell int, far double, id {kind}, archived boolean, v array<double>"), "placed")
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        sizes = kept(sizes, "sizes")
        known = {r.cell: r for r in sizes.collect()}  # a row a centroid
        made = [(i, known[i].n, known[i].blocks, known[i].radius, centers[i].tolist()) for i in sorted(known)]
        self.spark.createDataFrame(made, "cell int, n long, blocks int, radius double, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/cells")
        rows = placed.join(F.broadcast(sizes.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.select("cell", "block", "id", "archived", "v").repartitionByRange("cell", "block").sortWithinPartitions("cell", "block")
        rows.write.mode("overwrite").parquet(f"{self.root}/rows")
        return self

    def search(self, queries: DataFrame, k: int, penalty: float = 0.0) -> DataFrame:
        """(query_id, id, score, order, rank): the ``k`` rows of highest cosine for each query (query_id, v), ``order`` the cosine less ``penalty`` for archived rows.

        Each query goes to the cells nearest to it that hold ``k`` rows; its k-th best there is a bar.  By the triangle inequality no row of a cell is
        nearer than the distance to the centroid less the radius, so the query goes on only to cells whose bound reaches the bar, and the
        result is that of reading all.  Queries are shuffled to the cells' blocks; the driver holds the cells' table alone.  Ties, to nine
        places, go to the smaller id.
        """
        cells = self.cells.orderBy("cell").collect()
        centers = np.array([r.center for r in cells]).reshape(len(cells), -1)
        n, radius, blocks = (np.array([r[c] for r in cells]) for c in ("n", "radius", "blocks"))
        names = np.array([r.cell for r in cells], np.int32)
        shared = self.spark.sparkContext.broadcast((names, centers, n, radius, blocks))
        kind = queries.schema["query_id"].dataType.simpleString()
        asked = kept(queries.select("query_id", F.col("v").cast("array<double>").alias("v")), "asked")

        def probes(nearest: bool):
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                names, c, n, radius, blocks = shared.value
                for batch in batches:
                    if not batch.num_rows or not len(names):
                        continue
                    x = unit_rows(batch.column(1), batch.num_rows)
                    far = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T))
                    least = np.maximum(0, far - radius - 1e-9)
                    most = 1 - least * least / 2
                    order = np.argsort(least, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    first = np.zeros(far.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    if nearest:
                        go = first
                    else:
                        bar = batch.column(2).to_numpy(zero_copy_only=False).astype(float)  # null: nothing to beat
                        go = ~first & ~(most < bar[:, None] - 1e-8)
                    row, to = np.nonzero(go)
                    row, to = np.repeat(row, blocks[to]), np.repeat(to, blocks[to])
                    block = np.arange(len(to)) - np.searchsorted(row * len(names) + to, row * len(names) + to)
                    yield pa.RecordBatch.from_arrays([pa.array(names[to]), pa.array(block, pa.int32()), batch.column(0).take(pa.array(row)), lists(x[row])], ["cell", "block", "query_id", "v"])

            return run

        sent = f"cell int, block int, query_id {kind}, v array<double>"
        first = self._meet(asked.mapInArrow(probes(True), sent), k, penalty, kind)
        first = kept(ranked(first, k, score="order"), "first")
        bar = first.where(F.col("rank") == k).select("query_id", F.col("order").alias("bar"))
        rest = self._meet(asked.join(bar, "query_id", "left").select("query_id", "v", "bar").mapInArrow(probes(False), sent), k, penalty, kind)
        return ranked(first.drop("rank").unionByName(rest), k, score="order")

    def _meet(self, sent: DataFrame, k: int, penalty: float, kind: str) -> DataFrame:
        """(query_id, id, score, order): the best ``k`` of each block for each query sent there.  Many queries of a block come in parts, each of which meets its rows."""
        part = F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")
        sent = kept(sent, "sent")
        many = sent.groupBy("cell", "block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
        asks = sent.join(many, ["cell", "block"]).withColumn("part", part).drop("parts")
        rows = self.rows
        rows = rows.join(many, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        own = rows.schema["id"].dataType.simpleString()

        def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
            asks, rows = asks.combine_chunks(), rows.combine_chunks()
            if not asks.num_rows or not rows.num_rows:
                return pa.table({"query_id": asks.column("query_id").slice(0, 0), "id": rows.column("id").slice(0, 0), "score": pa.array([], pa.float64()), "order": pa.array([], pa.float64())})
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            ids = rows.column("id").combine_chunks()
            by_id = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
            x, late = matrix(rows)[by_id], rows.column("archived").to_numpy(zero_copy_only=False).astype(float)[by_id]
            score = matrix(asks) @ x.T
            order = score - penalty * late
            take = np.argsort(-np.round(order, 9), axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(score)), take.shape[1])
            r = take.ravel()
            return pa.table({"query_id": asks.column("query_id").combine_chunks().take(pa.array(q)), "id": ids.take(pa.array(by_id[r])), "score": pa.array(score[q, r]), "order": pa.array(order[q, r])})

        return asks.groupBy("cell", "block", "part").cogroup(rows.groupBy("cell", "block", "part")).applyInArrow(run, f"query_id {kind}, id {own}, score double, order double")
