"""A store of embedded chunks and what is asked of it: search, sources, synthesis, and the three-phase ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import corpus_path
from ..session import kept
from ..sources.convert import Converter, to_markdown
from ..sources.tables import Tables
from . import chunking, lexical, relations, similarity, state

HITS = 8
_CHUNKS = "chunk_id string, source string, heading_path string, page int, text string"
_CELLS = "id string, source string, bucket int, w double"
_CORPUS = "source string, text string, hash string"


def list_sources(chunks: DataFrame) -> DataFrame:
    """(source, chunks) by source."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks")).orderBy("source")


def sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").distinct().orderBy("source")


def citation() -> Column:
    return F.struct("source", "heading_path", "page", "chunk_id")


def checked(query: str, k: int) -> None:
    """What a search refuses."""
    if not query or not query.strip():
        raise ValueError("empty query: pass a non-empty search string")
    if k < 1:
        raise ValueError(f"k must be >= 1 (got {k})")


def nearest(cells: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` nearest by cosine of ``cells`` (id, bucket, w) for queries (query_id, bucket, w); ties by id."""
    score = cells.join(asked.select("query_id", "bucket", F.col("w").alias("qw")), "bucket").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return lexical.ranked(score, k)


def search(chunks: DataFrame, query: str, k: int = HITS, cells: DataFrame | None = None) -> DataFrame:
    """(rank, score, text, citation): vector search alone, scores to four places.  ``cells``, the stored embeddings, saves making them anew."""
    checked(query, k)
    spark = chunks.sparkSession
    asks = spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
    if cells is None:
        hits = lexical.ranked(similarity.hash_top(chunks, asks, k, "chunk_id"), k)
    else:
        hits = nearest(cells, similarity.hash_embedding(asks, "query_id").withColumnRenamed("id", "query_id"), k)
    hits = kept(hits.withColumnRenamed("id", "chunk_id"), "hits")
    return chunks.join(F.broadcast(hits), "chunk_id").select("rank", F.round("score", 4).alias("score"), "text", citation().alias("citation")).orderBy("rank")  # ``k`` hits


def synthesize(query: str, chunks: DataFrame, contains: DataFrame, mentions: DataFrame, nodes: DataFrame, k: int = HITS, limit: int = 12, cells: DataFrame | None = None) -> DataFrame:
    """(rank, chunk_id, why, text, citation) around what a vector search finds: the hits, chunks of concepts they mention, chunks beside them."""
    seeds = search(chunks, query, k, cells).select(F.col("citation.chunk_id").alias("chunk_id"), "rank")
    around = relations.synthesize(seeds, contains, mentions, nodes, limit)
    return around.join(chunks, "chunk_id").select("rank", "chunk_id", "why", "text", citation().alias("citation")).orderBy("rank")


class Store:
    """Chunks with their embeddings, by source, in versioned tables; nothing is seen by others before ``save``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Tables(spark, root)
        self.chunks, self.cells = self.tables.read("chunks", _CHUNKS), self.tables.read("cells", _CELLS)

    def upsert(self, chunks: DataFrame, cells: DataFrame | None = None) -> None:
        """Takes in chunks, in place of those with the same ids; ``cells`` (id, bucket, w) or, without, hashed ones."""
        chunks = chunks.select("chunk_id", "source", "heading_path", F.col("page").cast("int").alias("page"), "text")
        made = similarity.hash_embedding(chunks, "chunk_id") if cells is None else cells
        made = made.join(chunks.select(F.col("chunk_id").alias("id"), "source"), "id").select("id", "source", "bucket", "w")
        ids = chunks.select("chunk_id")
        self.chunks = self.chunks.join(ids, "chunk_id", "left_anti").unionByName(chunks)
        self.cells = self.cells.join(ids.withColumnRenamed("chunk_id", "id"), "id", "left_anti").unionByName(made)

    def delete_sources(self, names: DataFrame) -> None:
        """Drops all of the sources (source); ones that are not there change nothing."""
        self.chunks, self.cells = (df.join(names.select("source"), "source", "left_anti").select(df.columns) for df in (self.chunks, self.cells))

    def delete_source(self, name: str) -> None:
        self.chunks, self.cells = (df.where(F.col("source") != name) for df in (self.chunks, self.cells))

    def save(self) -> None:
        chunks, cells = self.chunks, self.cells
        self.tables.write("chunks", chunks)
        self.tables.write("cells", cells)
        self.chunks, self.cells = self.tables.read("chunks", _CHUNKS), self.tables.read("cells", _CELLS)

    def all_records(self) -> DataFrame:
        return self.chunks

    def sources(self) -> DataFrame:
        return sources(self.chunks)

    def query(self, asked: DataFrame, k: int = HITS) -> DataFrame:
        """(query_id, rank, score, citation, text) for embedded queries (query_id, bucket, w)."""
        hits = nearest(self.cells, asked, k).withColumnRenamed("id", "chunk_id")
        return hits.join(self.chunks, "chunk_id").select("query_id", "rank", "score", citation().alias("citation"), "text")

    # ---- The graph of the chunks

    def build_graph(self) -> DataFrame:
        """Makes and writes nodes and edges; (what, n) of them."""
        nodes, contains = relations.graph_nodes(self.chunks).withColumn("page", F.lit(None).cast("int")), relations.graph_contains(self.chunks)
        self.tables.write("graph_nodes", nodes)
        self.tables.write("graph_edges", contains.unionByName(relations.graph_mentions(self.chunks)))
        nodes, contains, mentions = self.graph()
        return relations.graph_stats(nodes, contains, mentions)

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, contains, mentions) as written last."""
        edges = self.tables.read("graph_edges", schema.GRAPH_EDGES)
        return self.tables.read("graph_nodes", schema.GRAPH_NODES), edges.where("kind = 'contains'"), edges.where("kind = 'mentions'")


def ingest(store: Store, raw: DataFrame, incremental: bool = True, rebuild_graph: bool = True, target: int | None = None, converter: Converter | None = None) -> DataFrame:
    """Brings a store up to raw files (path, content); (what, name) says what was converted, indexed, skipped, removed, or an error.

    Three phases: raw files whose content is new are converted into the corpus table; corpus texts whose hash is new
    are cut, embedded and put in place of what their source had; sources that are not in the corpus are dropped.  The manifest
    table has the hash of each ``raw:`` and ``corpus:`` key.  A raw file that is gone leaves its corpus text as it is.
    """
    tables = store.tables
    manifest = tables.read("manifest", schema.MANIFEST)
    corpus = tables.read("corpus", _CORPUS)
    before = manifest if incremental else manifest.limit(0)
    present = raw.select(F.concat(F.lit("raw:"), "path").alias("key"), F.sha2("content", 256).alias("hash"), "path", "content")
    changed = present.join(before.select("key", "hash"), ["key", "hash"], "left_anti")
    done = to_markdown(changed, converter).join(changed.select("path", "key", F.col("hash").alias("raw_hash")), "path")
    tables.write("converted", done.select("path", "key", "raw_hash", corpus_path(F.col("path")).alias("source"), F.col("text"), F.sha2("text", 256).alias("hash"), "error"))
    done = tables.read("converted", "path string, key string, raw_hash string, source string, text string, hash string, error string")
    good = done.where("error IS NULL")
    # Files whose corpus names are one: the last by path is kept, as if they were written one after the other.
    texts = good.groupBy("source").agg(F.max_by(F.struct("text", "hash"), "path").alias("t")).select("source", "t.text", "t.hash")
    tables.write("corpus", state.replace_by(corpus, texts, "source", texts))
    corpus = tables.read("corpus", _CORPUS)
    keyed = corpus.select(F.concat(F.lit("corpus:"), "source").alias("key"), "hash", "source", "text")
    fresh = keyed.join(before.select("key", "hash"), ["key", "hash"], "left_anti")
    cut = kept(chunking.chunk(fresh, **({} if target is None else {"target": target})), "cut")  # the chunker runs once
    had = store.sources()
    removed = had.join(corpus.select("source"), "source", "left_anti")
    tables.write("removed", removed)
    removed = tables.read("removed", "source string")
    store.delete_sources(fresh.select("source").unionByName(removed))
    store.upsert(cut)
    store.save()
    sizes = store.chunks.groupBy("source").agg(F.count("*").cast("int").alias("chunks"))
    raws = manifest.where(F.startswith("key", F.lit("raw:"))).join(good.select("key"), "key", "left_anti").unionByName(good.select("key", F.col("raw_hash").alias("hash"), F.lit(None).cast("int").alias("chunks"), F.col("source").alias("corpus")))
    indexed = keyed.join(sizes, "source", "left").select("key", "hash", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit(None).cast("string").alias("corpus"))
    said = lambda df, what, name: df.select(F.lit(what).alias("what"), name.alias("name"))
    skipped = keyed.join(fresh.select("key"), "key", "left_anti")
    report = said(good, "converted", F.col("source")).unionByName(said(fresh, "indexed", F.col("source"))).unionByName(said(skipped, "skipped", F.col("source")))
    report = report.unionByName(said(removed, "removed", F.col("source"))).unionByName(said(done.where("error IS NOT NULL"), "error", F.concat("path", F.lit(": "), "error")))
    tables.write("report", report)
    tables.write("manifest", raws.unionByName(indexed))
    if rebuild_graph:
        store.build_graph()
    return tables.read("report", "what string, name string")


def remove_source(store: Store, name: str) -> None:
    """Takes a text out of the corpus; the next ingest drops its chunks."""
    corpus = store.tables.read("corpus", _CORPUS)
    store.tables.write("corpus", corpus.where(F.col("source") != name))
