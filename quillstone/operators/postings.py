"""Inverted indexes kept as tables: blocks of a term's rows with their greatest weight, and top-k that reads no block it can rule out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, tokenize
from ..session import kept
from ..ship import ship
from . import similarity
from .lexical import B, K1, ranked

#: Rows of a block on average, terms that are named in the scan's filter, and blocks that set the bar for the others.
BLOCK, NAMED, SEEDS = 1024, 400, 4


class Postings:
    """One index below ``root``: ``blocks`` (term, block, n, most, ids, weights) in ranges of terms, and ``totals`` of the whole.

    A block of rows is the same for all terms, so a row's best possible score is bounded by the sum of its block's
    greatest weights.  Blocks hold rows of like size, whose weights are alike, which keeps that bound low for most.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/blocks")

    def totals(self) -> tuple[int, float]:
        """(rows, mean size) of what was indexed."""
        r = self.spark.read.parquet(f"{self.root}/totals").first()
        return r.n, r.mean

    def build(self, entries: DataFrame, sizes: DataFrame, weight: Column, block: int = BLOCK) -> Postings:
        """From ``entries`` (id, term, size, count) and ``sizes`` (id, size) of all rows, ``weight`` an expression over entries and ``mean``.

        Blocks are a class of size and a hash of the id: two rows of a task's count decide how many a class gets.  What is gathered is one
        term's rows of one block, about ``block`` of them, so a term of every row is as many rows of the table as there are blocks.  Entries are shuffled once, into the
        order that the table is written in, and gathered as they pass by.  ``id`` and ``term`` occur together once.
        """
        kind = F.floor(2 * F.log2(F.lit(1.0) + F.col("size"))).cast("int").alias("kind")
        classes = sizes.groupBy(kind).agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        classes = kept(classes, "classes")  # at most twice 64 rows, as sizes are of 64 bits
        total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.nullif(F.sum("total") / F.sum("n"), F.lit(0.0)), F.lit(1.0)).alias("mean"))
        total.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/totals")
        mean = F.lit(self.totals()[1])
        many = classes.select("kind", F.ceil(F.col("n") / block).alias("parts"))
        rows = entries.withColumn("mean", mean).select("id", "term", weight.alias("w"), kind).join(F.broadcast(many), "kind")
        number = F.col("kind").cast("long") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts"))
        order = ("term", "block", "id", "w")
        ordered = _packed(rows.select("term", number.alias("block"), "id", "w").repartitionByRange(F.col("term"), F.col("block")).sortWithinPartitions(*order))
        ordered.write.mode("overwrite").option("parquet.block.size", 8 << 20).option("parquet.page.size", 64 << 10).parquet(f"{self.root}/blocks")
        return self

    def named(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(blocks of the terms asked for, asked): few terms go into the scan's filter, so files and pages without them are not read, and are sent to the tasks."""
        terms = [r.term for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        if len(terms) > NAMED:
            return self.blocks, asked
        return self.blocks.where(F.col("term").isin(terms) if terms else F.lit(False)), F.broadcast(asked) if asked.limit(10 * NAMED + 1).count() <= 10 * NAMED else asked

    def top(self, asked: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
        """(query_id, id, score, rank): the ``k`` rows of highest sum of weight times ``qw`` for each query of ``asked`` (query_id, term, qw >= 0).

        The blocks that could hold the best rows are scored first; the k-th score there is a bar, and of the others only blocks whose bound
        reaches it are read.  The result is that of scoring all.  Rows without a positive score are not there.
        """
        blocks, asked = self.named(asked)
        bounds = blocks.select("term", "block", "most").join(asked, "term").groupBy("query_id", "block").agg(F.sum(F.col("most") * F.col("qw")).alias("bound"))
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        first = bounds.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= seeds).select("query_id", "block")
        bar = ranked(self._scores(blocks, asked, first), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        open_ = bounds.join(bar, "query_id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - 1e-8)).select("query_id", "block")
        return ranked(self._scores(blocks, asked, open_), k)

    def best(self, weights: dict, k: int, seeds: int = SEEDS) -> DataFrame:
        """(id, score, rank): ``top`` of one question whose terms and weights the driver knows, by which nothing is joined but the open blocks."""
        named = [c for t, w in weights.items() for c in (F.lit(t), F.lit(w))]
        blocks = self.blocks.where(F.col("term").isin(list(weights)) if weights else F.lit(False))
        blocks = blocks.withColumn("qw", F.create_map(*named)[F.col("term")] if named else F.lit(0.0))
        bounds = blocks.groupBy("block").agg(F.sum(F.col("most") * F.col("qw")).alias("bound"))
        order = (F.desc(F.round("score", 9)), F.asc("id"))

        def scored(rows: DataFrame) -> DataFrame:
            cells = rows.select("qw", F.explode(F.arrays_zip("ids", "weights")).alias("e"))
            return cells.groupBy(F.col("e.ids").alias("id")).agg(F.sum(F.col("e.weights") * F.col("qw")).alias("score")).where("score > 0").orderBy(*order).limit(k)

        first = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(seeds).collect()]
        found = scored(blocks.where(F.col("block").isin(first))).select("score").collect() if first else []
        bar = found[-1].score - 1e-8 if len(found) == k else 0.0
        hits = scored(blocks.join(bounds.where(F.col("bound") >= bar).select("block"), "block", "left_semi"))
        return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows

    @staticmethod
    def _scores(blocks: DataFrame, asked: DataFrame, chosen: DataFrame) -> DataFrame:
        rows = blocks.select("term", "block", "ids", "weights").join(asked, "term").join(chosen, ["query_id", "block"])
        cells = rows.select("query_id", "qw", F.explode(F.arrays_zip("ids", "weights")).alias("e")).select("query_id", F.col("e.ids").alias("id"), (F.col("e.weights") * F.col("qw")).alias("part"))
        return cells.groupBy("query_id", "id").agg(F.sum("part").alias("score")).where("score > 0")


def _packed(rows: DataFrame) -> DataFrame:
    """(term, block, n, most, ids, weights) from (term, block, id, w) in order of term and block, which no partition shares with another."""
    ship(rows.sparkSession)
    term, ident = (rows.schema[c].dataType.simpleString() for c in ("term", "id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            w = table.column("w").combine_chunks().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.append(starts, table.num_rows).astype(np.int32))
            at = pa.array(starts)
            names = table.column("term").combine_chunks().take(at), table.column("block").combine_chunks().take(at)
            columns = [*names, pa.array(np.diff(offsets.to_numpy()).astype(np.int64)), pa.array(np.maximum.reduceat(w, starts)), pa.ListArray.from_arrays(offsets, table.column("id").combine_chunks()), pa.ListArray.from_arrays(offsets, pa.array(w))]
            return pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "most", "ids", "weights"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            before, after = batch.slice(0, batch.num_rows - 1), batch.slice(1)
            new[1:] = np.logical_or(*(pc.not_equal(before.column(c), after.column(c)).to_numpy(zero_copy_only=False) for c in (0, 1)))
            new[0] = not waiting or any(waiting[-1].column(c)[-1] != batch.column(c)[0] for c in (0, 1))
            starts = np.flatnonzero(new)
            if waiting and len(starts):
                # the group that was open ends in this batch
                done = pa.Table.from_batches([*waiting, batch.slice(0, starts[0])])
                yield pack(done, np.zeros(1, np.int64))
                waiting = []
            if len(starts) > 1:
                yield pack(pa.Table.from_batches([batch.slice(starts[0], starts[-1] - starts[0])]), starts[:-1] - starts[0])
            waiting.append(batch.slice(starts[-1]) if len(starts) else batch)
        if waiting:
            yield pack(pa.Table.from_batches(waiting), np.zeros(1, np.int64))

    return rows.mapInArrow(run, f"term {term}, block long, n long, most double, ids array<{ident}>, weights array<double>")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, term, count) of the tokens of each text, counted where it is read; ids are unique."""
    ship(docs.sparkSession)
    ident = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile("[a-z0-9]+")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                found = [words.findall(t) for t in piece.column(1).to_pylist()]
                counts = [Counter(f) for f in found]
                row = pa.array(np.repeat(np.arange(len(counts)), [len(c) for c in counts]))
                columns = [piece.column(0).take(row), pa.array([len(f) for f in found], pa.int64()).take(row), pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "size", "term", "count"])

    return docs.select(F.col(id_col).alias("id"), F.lower(or_empty(F.col(text_col))).alias("text")).mapInArrow(run, f"id {ident}, size long, term string, count long")


class Lexical(Postings):
    """BM25 over stored postings: a weight is the part of the score that does not depend on the question."""

    def index(self, docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", block: int = BLOCK) -> Lexical:
        rows = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens"))
        sizes = rows.select("id", F.size("tokens").cast("long").alias("size"))
        entries = term_counts(docs, id_col, text_col)
        weight = F.col("count") * (K1 + 1) / (F.col("count") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
        self.build(entries, sizes, weight, block)
        return self

    def weights(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, qw) of questions (query_id, text): each token once, with its inverse document frequency."""
        asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))
        n = self.totals()[0]
        blocks, _ = self.named(asked)
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.greatest(F.lit(0.0), F.log(F.lit(1.0) + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        return asked.join(df, "term").select("query_id", "term", idf.alias("qw"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) as of ``lexical.bm25`` over all that was indexed."""
        return self.top(kept(self.weights(queries), "asked"), k)

    def ask(self, text: str, k: int) -> DataFrame:
        """(id, score, rank) for one question: reads the counts of its terms' blocks, then their bounds, then what may hold the best ``k``."""
        terms = self.spark.range(1).select(F.array_distinct(tokenize(F.lit(text))).alias("t")).first().t
        n, _ = self.totals()
        df = self.blocks.where(F.col("term").isin(terms) if terms else F.lit(False)).groupBy("term").agg(F.sum("n").alias("df"))
        return self.best({r.term: max(0.0, log(1 + (n - r.df + 0.5) / (r.df + 0.5))) for r in df.collect()}, k)


class Cells(Postings):
    """Cosines of hashed embeddings over stored cells: a term is a bucket, a weight its share of a vector of unit length."""

    def index(self, docs: DataFrame, id_col: str = "chunk_id", text_col: str = "text", block: int = BLOCK) -> Cells:
        cells = kept(similarity.hash_embedding(docs, id_col, text_col), "cells")
        sizes = cells.groupBy("id").agg(F.count("*").alias("size"))
        entries = cells.join(sizes, "id").select("id", F.col("bucket").alias("term"), "size", F.col("w").alias("count"))
        self.build(entries, sizes, F.col("count"), block)
        return self

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): the nearest of what shares a bucket with a question."""
        asked = similarity.hash_embedding(queries, "query_id").select(F.col("id").alias("query_id"), F.col("bucket").alias("term"), F.col("w").alias("qw"))
        return self.top(kept(asked, "asked"), k)

    def ask(self, text: str, k: int) -> DataFrame:
        """(id, score, rank) for one question."""
        asked = similarity.hash_embedding(self.spark.range(1).select("id", F.lit(text).alias("text")), "id")
        return self.best({r.bucket: r.w for r in asked.collect()}, k)
