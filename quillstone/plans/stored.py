"""Queries over what is stored to be asked again: postings, cells, vectors by cell, and joins by bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, mail, nearjoin, postings, search, vectortable
from ..session import kept, shared_dir
from ..sources.tables import Buckets
from ..streaming import jobs, stateful
from .catalog import _ASKS, _FLAT, _FUSED, _SNIP, _TOP, _VEC, ASK, SQL, _bm25_sql, _messages, _r, _t, _vectors, query

_opened: dict[tuple[str, str, str], object] = {}


def _open(spark: SparkSession, sf: str, name: str, build):
    """The stored index of a folder of tables: built when it is first asked for, read from then on."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _opened:
        _opened[key] = build(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _opened[key]


def _lexical(spark: SparkSession, sf: str) -> postings.Lexical:
    return _open(spark, sf, "lexical", lambda root: postings.Lexical(spark, root).index(_t(spark, sf, "documents"), "doc_id"))


def _cells(spark: SparkSession, sf: str) -> postings.Cells:
    return _open(spark, sf, "cells", lambda root: postings.Cells(spark, root).index(_t(spark, sf, "documents"), "doc_id"))


def _table(spark: SparkSession, sf: str) -> vectortable.VectorTable:
    return _open(spark, sf, "vectors", lambda root: vectortable.VectorTable(spark, root).build(_vectors(spark, sf).withColumn("archived", F.col("label") == 0)))


def _named(hits: DataFrame, name: str = "doc_id") -> DataFrame:
    return hits.select("query_id", F.col("id").alias(name), _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_sql('documents', _ASKS)} {_TOP.format(k=20)}")
def postings_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_lexical(spark, sf).ask(ASK, 20).withColumn("query_id", F.lit(0).cast("long")))


@query(f"WITH {_bm25_sql('documents', '(SELECT item_id AS query_id, text FROM benchmark)')} {_TOP.format(k=10)}")
def postings_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _named(_lexical(spark, sf).search(_t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10))


@query(
    _FUSED.format(late="") + f", x AS (SELECT id, rank, {_SNIP.format(t=_FLAT)} AS snippet FROM g WHERE rank <= 20), "
    "y AS (SELECT *, sum(length(snippet) + 160) OVER (ORDER BY rank) AS used FROM x) "
    "SELECT id AS doc_id, rank, snippet, CAST(used AS BIGINT) AS used FROM y WHERE used <= 4000 OR rank = 1"
)
def search_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search that reads the question's terms and buckets, then the texts of the hits."""
    hits = search.stored(_lexical(spark, sf), _cells(spark, sf), ASK, 20)
    hits = hits.join(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return search.within_budget(hits, 4000).select(F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "snippet", F.col("used").cast("long").alias("used"))


@query("WITH" + _VEC.format(where="q.id % 50 = 0", penalty="0", k=8))
def vector_table_batch(spark: SparkSession, sf: str) -> DataFrame:
    asks = _vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    return _named(_table(spark, sf).search(asks, 8), "vec_id")


@query("WITH" + _VEC.format(where="q.id % 70 = 0", penalty="CASE WHEN archived THEN 2 ELSE 0 END", k=20))
def vector_table_archived(spark: SparkSession, sf: str) -> DataFrame:
    asks = _vectors(spark, sf).where("id % 70 = 0").select(F.col("id").alias("query_id"), "v")
    return _named(_table(spark, sf).search(asks, 20, penalty=2.0), "vec_id")


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS s FROM e a JOIN e b ON a.id < b.id)
SELECT a, b, round(s, 6) AS similarity FROM c WHERE s >= 0.4""")
def near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of embeddings that are near each other."""
    return nearjoin.near_pairs(_vectors(spark, sf).select("id", "v"), 0.4).select("a", "b", _r("similarity").alias("similarity"))


# ---- Streams, tables by bucket, the chunker in SQL


@query(SQL["weekly_digest"])
def stream_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly digests as a stream of lines in several batches, late and repeated ones among them; the last of each is there at the end."""
    where = f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    items = kept(mail.digest_items(mail.triage(_messages(spark, sf))), "items").select("source_ref", "title", F.col("message_id").cast("string").alias("message_id"), "line")
    for part in range(3):
        items.where(F.pmod(F.xxhash64("message_id"), F.lit(4)).isin(part, 3)).coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    tables = Buckets(spark, f"{where}/out", 8)
    jobs.sync(stateful.digests(stream), tables, "digests", stateful.DIGEST, "source_ref", lambda df: df, f"{where}/ck", "n", mode="update").awaitTermination()
    return tables.read("digests", stateful.DIGEST)


@query("""WITH e AS (SELECT user_id::VARCHAR AS key, ts FROM events), g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) > INTERVAL 6 HOUR, true) AS fresh FROM e), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY key ORDER BY ts, fresh) AS run FROM g)
SELECT key, count(*) AS n, min(ts) AS first, max(ts) AS last FROM r GROUP BY key, run""")
def expiring_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of each user's events that no gap of six hours parts, in the stream's batch form."""
    events = _t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    runs = stateful.counts_until(events, 6 * 3600)
    return runs.select("key", "n", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN 'new' ELSE lang END AS lang, CASE WHEN doc_id % 10 = 1 THEN 0 ELSE length(coalesce(text, '')) END::BIGINT AS size FROM documents WHERE doc_id % 10 NOT IN (2, 3)")
def bucket_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A table by buckets after an upsert and a removal of a tenth of its keys each; another tenth was never there."""
    d = _t(spark, sf, "documents").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    schema = "doc_id long, lang string, size long"
    tables = Buckets(spark, f"{shared_dir(spark)}/buckets-{uuid.uuid4().hex}", 16)
    tables.upsert("notes", schema, d.where("doc_id % 10 <> 3"), "doc_id")
    tables.upsert("notes", schema, d.where("doc_id % 10 = 1").select("doc_id", F.lit("new").alias("lang"), F.lit(0).cast("long").alias("size")), "doc_id")
    tables.remove("notes", schema, d.where("doc_id % 10 = 2"), "doc_id")
    return tables.read("notes", schema)


@query(SQL["chunk_sections"])
def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """The sections again, by the chunker as a table function of SQL."""
    chunking.register(spark)
    _t(spark, sf, "documents").where(F.trim("text") != "").createOrReplaceTempView("chunk_table_documents")
    text = "concat('# T', doc_id, '\n\nintro\n\n<!-- page: 7 -->\n\n## Body\n\n', text, '\n\n### Deep\n\n```\n# no heading\n\nx\n```\n\n# Z\n\nend')"
    return spark.sql(f"SELECT c.chunk_id, c.ordinal, c.heading_path, c.page, c.text FROM chunk_table_documents, LATERAL chunks(source => doc_id, text => {text}, target => 1000000000) AS c")
