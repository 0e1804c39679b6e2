"""Queries over the test tables, one or more for each operator, with the same result in SQL where there is one.

The tables stand in for notes and their kin: documents for notes and chunks, embeddings for vectors, events for
mail, calendar and access logs, labels for importance, part for files, conversations for journals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.time import digest_title, moment, week_key
from ..session import kept, shared_dir
from ..operators import chunking, files, knowledge, lexical, lifecycle, mail, nearjoin, relations, search, similarity, state
from ..streaming import jobs

NOW = "2024-02-01 00:00:00"
ASK = "the and of thing"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ask(spark: SparkSession, text: str = ASK) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("long").alias("query_id"), F.lit(text).alias("text"))


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


# ---- Lexical, vector and hybrid search

_TOK = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"


def _bm25_sql(docs: str, asks: str) -> str:
    """WITH parts up to ``bm`` (query_id, id, score)."""
    return f"""
d AS (SELECT doc_id AS id, {_TOK.format(c="text")} AS toks FROM {docs}),
s AS (SELECT count(*) AS n, coalesce(nullif(avg(len(toks)), 0), 1) AS mean FROM d),
a AS (SELECT DISTINCT query_id, unnest({_TOK.format(c="text")}) AS term FROM {asks}),
w AS (SELECT id, len(toks) AS l, unnest(toks) AS term FROM d),
tf AS (SELECT id, l, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query_id, id, sum(greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean))) AS score
       FROM tf JOIN df USING (term) JOIN a USING (term), s GROUP BY ALL HAVING score > 0)"""


_ASKS = f"(SELECT 0 AS query_id, '{ASK}' AS text)"
_TOP = "SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm) WHERE rank <= {k}"


def _top(scores: DataFrame, k: int) -> DataFrame:
    return lexical.ranked(scores, k).select("query_id", F.col("id").alias("doc_id"), _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_bm25_sql('documents', _ASKS)} {_TOP.format(k=20)}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(lexical.bm25_top(_t(spark, sf, "documents"), _ask(spark), 20, "doc_id"), 20)


_EN = "(SELECT * FROM documents WHERE lang = 'en')"


@query(f"WITH {_bm25_sql(_EN, _ASKS)} {_TOP.format(k=20)}")
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _top(lexical.bm25_top(_t(spark, sf, "documents").where("lang = 'en'"), _ask(spark), 20, "doc_id"), 20)


@query(f"WITH {_bm25_sql('documents', '(SELECT item_id AS query_id, text FROM benchmark)')} {_TOP.format(k=10)}")
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    asks = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _top(lexical.bm25_top(_t(spark, sf, "documents"), asks, 10, "doc_id"), 10)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_VEC = """
e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT q.id AS query_id, e.id, e.label = 0 AS archived,
             list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS score
      FROM e q, e WHERE {where}),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score - {penalty}, 12) DESC, id) AS rank FROM c)
SELECT query_id, id AS vec_id, round(score, 6) AS score, rank FROM o WHERE rank <= {k}"""


def _nearest(found: DataFrame, k: int) -> DataFrame:
    found = found.withColumn("order", F.round("order", 12))
    return lexical.ranked(found, k, score="order").select("query_id", F.col("id").alias("vec_id"), _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH" + _VEC.format(where="q.id = 0", penalty="0", k=8))
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    asks = rows.where("id = 0").select(F.col("id").alias("query_id"), "v")
    return _nearest(similarity.vector_search(rows, asks, 8), 8)


@query("WITH" + _VEC.format(where="q.id % 50 = 0", penalty="0", k=8))
def vector_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    asks = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    return _nearest(similarity.vector_search(rows, asks, 8), 8)


@query("WITH" + _VEC.format(where="q.id = 0", penalty="CASE WHEN archived THEN 2 ELSE 0 END", k=20))
def vector_archived_penalty(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).withColumn("archived", F.col("label") == 0)
    asks = rows.where("id = 0").select(F.col("id").alias("query_id"), "v")
    return _nearest(similarity.vector_search(rows, asks, 20, penalty=2.0), 20)


_HASHED = f"""
t AS (SELECT doc_id AS id, unnest({_TOK.format(c="text")}) AS t FROM documents),
n AS (SELECT id, CAST('0x' || right(md5(t), 2) AS INT) AS bucket, count(*) AS n FROM t GROUP BY ALL),
h AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM n)"""


@query(f"WITH {_HASHED} SELECT id AS doc_id, bucket, round(w, 6) AS w FROM h")
def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.hash_embedding(_t(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "bucket", _r("w").alias("w"))


_FUSED = f"""WITH {_bm25_sql("documents", _ASKS)}, {_HASHED},
q AS (SELECT CAST('0x' || right(md5(t), 2) AS INT) AS bucket, count(*) AS n FROM (SELECT unnest({_TOK.format(c=f"'{ASK}'")}) AS t) GROUP BY ALL),
v AS (SELECT id, sum(w * n) / (SELECT sqrt(sum(n * n)) FROM q) AS score FROM h JOIN q USING (bucket) GROUP BY id),
l AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM v UNION ALL
      SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM bm),
p AS (SELECT id, rank FROM l WHERE rank <= 80),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM p GROUP BY id),
g AS (SELECT f.*, doc.text, doc.lang, row_number() OVER (ORDER BY {{late}} round(score, 12) DESC, id) AS rank FROM f JOIN documents doc ON doc.doc_id = f.id)"""


def _hybrid(spark: SparkSession, sf: str, late: Column | None = None, k: int = 20) -> DataFrame:
    """Both rankings of one question over documents, each by the best of every task, fused; texts are read for the hits."""
    docs, ask = _t(spark, sf, "documents"), _ask(spark)
    n = search.pool(k)
    near, words = similarity.hash_top(docs, ask, n), lexical.bm25_top(docs, ask, n, "doc_id")
    best = [lexical.ranked(x.withColumn("score", F.round("score", 9)), n) for x in (near, words)]
    archived = None if late is None else docs.where(late).select(F.col("doc_id").alias("id"))
    hits = kept(search.fuse(best, archived), "hits")
    return docs.select(F.col("doc_id").alias("id"), "text", "lang").join(F.broadcast(hits), "id")  # twice ``n`` rows at most


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("doc_id"), _r("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_FUSED.format(late="") + "SELECT id AS doc_id, round(score, 6) AS score, rank FROM g WHERE rank <= 20")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(_hybrid(spark, sf).where("rank <= 20"))


@query(_FUSED.format(late="(lang = 'fr')::INT,") + "SELECT id AS doc_id, round(score, 6) AS score, rank FROM g WHERE rank <= 20")
def rrf_active_first(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(_hybrid(spark, sf, F.col("lang") == "fr").where("rank <= 20"))


_SNIP = r"""CASE WHEN length({t}) <= 300 THEN {t} ELSE rtrim(regexp_replace(left({t}, 300), ' [^ ]*$', '')) || '…' END"""
_FLAT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(
    _FUSED.format(late="") + f", x AS (SELECT id, rank, {_SNIP.format(t=_FLAT)} AS snippet FROM g WHERE rank <= 20), "
    "y AS (SELECT *, sum(length(snippet) + 160) OVER (ORDER BY rank) AS used FROM x) "
    "SELECT id AS doc_id, rank, snippet, CAST(used AS BIGINT) AS used FROM y WHERE used <= 4000 OR rank = 1"
)
def search_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.within_budget(_hybrid(spark, sf).where("rank <= 20"), 4000)
    return rows.select(F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "snippet", F.col("used").cast("long").alias("used"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return search_budget(spark, sf)


@query(f"SELECT doc_id, {_SNIP.format(t=_FLAT)} AS snippet FROM documents")
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


# ---- Duplicates and centroids


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md"))
    return d.select(F.col("doc_id").alias("id"), path.alias("path"), F.col("text").alias("body"), "lang", "source")


_NOTES = "n AS (SELECT doc_id AS id, lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.md' AS path, text AS body, lang, source, sha256(trim(coalesce(text, ''))) AS body_hash FROM documents)"


@query(f"WITH {_NOTES}, f AS (SELECT body_hash, arg_min(id, path) AS canonical_id FROM n GROUP BY body_hash) SELECT path, canonical_id, body_hash FROM n JOIN f USING (body_hash) WHERE id <> canonical_id")
def exact_dups(spark: SparkSession, sf: str) -> DataFrame:
    return relations.exact_duplicates(_notes(spark, sf))


@query(f"WITH {_NOTES}, f AS (SELECT body_hash, arg_min(id, path) AS c, min(path) AS p FROM n GROUP BY body_hash) SELECT n.path, f.c AS canonical_id, f.p AS canonical_path FROM n JOIN f USING (body_hash) WHERE n.id <> f.c")
def duplicates_named(spark: SparkSession, sf: str) -> DataFrame:
    notes = _notes(spark, sf)
    return relations.named_duplicates(relations.exact_duplicates(notes), notes).select("path", "canonical_id", "canonical_path")


@query(f"WITH {_NOTES} SELECT arg_min(id, path) AS id, min(path) AS path, body_hash FROM n GROUP BY body_hash")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    return state.index(_notes(spark, sf)).select("id", "path", "body_hash")


@query(f"WITH {_NOTES} SELECT arg_min(id, path) AS id, min(path) AS path, body_hash FROM n GROUP BY body_hash")
def index_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same, from a state built when English notes had other texts and French ones were not there."""
    notes = _notes(spark, sf)
    before = notes.where("lang <> 'fr'").withColumn("body", F.when(F.col("lang") == "en", F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return state.index(notes, state.index(before)).select("id", "path", "body_hash")


_CENT = """
u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS w FROM u GROUP BY ALL),
c AS (SELECT label, pos, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM m)"""


@query(f"WITH {_CENT} SELECT label, CAST(pos AS INT) AS pos, round(w, 6) AS w FROM c")
def doc_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.centroids(_t(spark, sf, "embeddings"), "label", "embedding").select("label", "pos", _r("w").alias("w"))


@query(f"""WITH {_CENT}, s AS (SELECT e.vec_id, c.label, sum(e.x * c.w) / sqrt(sum(e.x * e.x)) AS score FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) e JOIN c USING (pos) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS k FROM s) SELECT vec_id, label, round(score, 6) AS score FROM r WHERE k = 1 AND score >= 0.2""")
def best_similar(spark: SparkSession, sf: str) -> DataFrame:
    """For each vector the nearest centroid, if it is near enough; centroids, one a label, are gathered by position."""
    rows = _t(spark, sf, "embeddings")
    mean = similarity.centroids(rows, "label", "embedding").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("p")).select(F.col("label").alias("to"), F.transform("p", lambda p: p["w"]).alias("c"))
    return _best(rows, mean)


def _best(rows: DataFrame, mean: DataFrame) -> DataFrame:
    from ..functions.vector import dot, norm

    v = F.col("embedding")
    scored = rows.select("vec_id", "embedding").join(mean, F.lit(True)).select("vec_id", "to", (dot(v, F.col("c")) / norm(v)).alias("score"))
    best = scored.groupBy("vec_id").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("to")).alias("m"), "score")).alias("b"))
    return best.select("vec_id", (-F.col("b.m")).alias("label"), _r("b.score").alias("score")).where("b.score >= 0.2")


@query(f"""WITH {_HASHED}, o AS (SELECT min(doc_id) AS id FROM documents GROUP BY sha256(trim(coalesce(text, '')))), k AS (SELECT h.* FROM h JOIN o USING (id)),
p AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS s FROM k x JOIN k y ON x.bucket = y.bucket AND x.id < y.id GROUP BY ALL) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.99""")
def near_dups(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents")
    first = docs.groupBy(tx.body_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    counts = similarity.bucket_counts(docs.join(first, "doc_id", "left_semi"))
    return nearjoin.near_pairs(counts, 0.99).select("a", "b", _r("similarity").alias("similarity"))


@query("WITH k AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, p_partkey::VARCHAR AS name FROM part) SELECT key, count(*) AS n, string_agg(name, '; ' ORDER BY name) AS names FROM k WHERE length(key) >= 6 GROUP BY key HAVING count(*) > 1")
def possible_dups(spark: SparkSession, sf: str) -> DataFrame:
    return relations.possible_duplicates(_t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_name").alias("title")))


# ---- Links

_BODY = "'See [[' || lang || ']], [[' || source || '|the source]], [[Note ' || doc_id // 7 || ']] and [[' || lang || ']]. ' || text"
_LINKED = f"n AS (SELECT doc_id AS id, lang || '/' || 'note-' || doc_id || '.md' AS path, 'Note ' || doc_id AS title, {_BODY} AS body FROM documents)"
_LINK = r"l AS (SELECT DISTINCT id AS src_document, trim(unnest(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1))) AS dst_target FROM n)"
_RES = """k AS (SELECT id, path, unnest([title, 'note-' || id]) AS key FROM n), f AS (SELECT key, arg_min(id, path) AS dst_document FROM k GROUP BY key),
r AS (SELECT src_document, dst_target, dst_document FROM l LEFT JOIN f ON l.dst_target = f.key)"""


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    title = F.concat(F.lit("Note "), F.col("doc_id").cast("string"))
    to = F.floor(F.col("doc_id") / 7).cast("string")
    body = F.concat(F.lit("See [["), "lang", F.lit("]], [["), "source", F.lit("|the source]], [[Note "), to, F.lit("]] and [["), "lang", F.lit("]]. "), "text")
    return d.select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("/note-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), title.alias("title"), body.alias("body"))


def _resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    notes = _linked(spark, sf)
    return relations.resolve_links(relations.extract_links(notes), notes), notes


@query(f"WITH {_LINKED}, {_LINK} SELECT src_document, dst_target, 'mentions' AS rel FROM l")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return relations.extract_links(_linked(spark, sf))


@query(f"WITH {_LINKED}, {_LINK}, {_RES} SELECT src_document, dst_target, dst_document FROM r")
def link_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf)[0].drop("rel")


@query(f"WITH {_LINKED}, {_LINK}, {_RES} SELECT r.src_document, r.dst_target, n.title AS dst_title, r.dst_document IS NOT NULL AS resolved FROM r LEFT JOIN n ON n.id = r.dst_document")
def outgoing_links(spark: SparkSession, sf: str) -> DataFrame:
    return relations.outgoing(*_resolved(spark, sf)).select("src_document", "dst_target", "dst_title", "resolved")


@query(f"WITH {_LINKED}, {_LINK}, {_RES} SELECT r.dst_document, r.src_document, n.title AS src_title FROM r JOIN n ON n.id = r.src_document WHERE r.dst_document IS NOT NULL")
def backlinks(spark: SparkSession, sf: str) -> DataFrame:
    return relations.backlinks(*_resolved(spark, sf)).select("dst_document", "src_document", "src_title")


@query(f"WITH {_LINKED}, {_LINK}, {_RES} SELECT dst_document, count(*) AS incoming FROM r WHERE dst_document IS NOT NULL GROUP BY ALL")
def incoming_counts(spark: SparkSession, sf: str) -> DataFrame:
    return relations.incoming_counts(_resolved(spark, sf)[0])


@query(f"""WITH {_LINKED}, {_LINK}, {_RES}, o AS (SELECT src_document AS id, count(*) AS o FROM r GROUP BY ALL), b AS (SELECT dst_document AS id, count(*) AS b FROM r WHERE dst_document IS NOT NULL GROUP BY ALL)
SELECT id, coalesce(o, 0) AS n_out, coalesce(b, 0) AS n_back FROM o FULL JOIN b USING (id)""")
def related_counts(spark: SparkSession, sf: str) -> DataFrame:
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    rows = relations.related(*_resolved(spark, sf))
    return rows.select("id", F.when(F.col("outgoing").isNull(), F.lit(0)).otherwise(size("outgoing")).alias("n_out"), F.when(F.col("backlinks").isNull(), F.lit(0)).otherwise(size("backlinks")).alias("n_back"))


@query(f"""WITH {_LINKED}, {_LINK}, {_RES} SELECT n.path, '## ' || n.path || chr(10) || chr(10) || string_agg('- [[' || dst_target || ']]' || CASE WHEN dst_document IS NULL THEN ' (unresolved)' ELSE '' END, chr(10)
ORDER BY '- [[' || dst_target || ']]' || CASE WHEN dst_document IS NULL THEN ' (unresolved)' ELSE '' END) || chr(10) AS block FROM r JOIN n ON n.id = r.src_document GROUP BY n.id, n.path""")
def relations_map(spark: SparkSession, sf: str) -> DataFrame:
    return relations.relations_map(*_resolved(spark, sf))


# ---- Concept graph


def _chunked(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "source", F.concat_ws(" > ", "lang", "source").alias("heading_path"), F.concat(F.lit("about "), F.concat(F.lit("src"), F.pmod("doc_id", F.lit(23)).cast("string")), F.lit(". "), "text").alias("text"))


_CH = "ch AS (SELECT 'c' || doc_id AS chunk_id, source, lang, lang || ' > ' || source AS hp, 'about src' || doc_id % 23 || '. ' || text AS text FROM documents)"
_NODES = """nodes AS (SELECT lang AS id, 'concept' AS kind, lang AS title, arg_min(source, chunk_id) AS source FROM ch GROUP BY lang UNION ALL
SELECT hp, 'concept', source, source FROM ch GROUP BY ALL UNION ALL SELECT chunk_id, 'chunk', NULL, source FROM ch)"""
_CONT = "cont AS (SELECT DISTINCT lang AS src, hp AS dst FROM ch UNION SELECT hp, chunk_id FROM ch)"
_MENT = r"""ment AS (SELECT DISTINCT c.chunk_id AS src, n.id AS dst FROM ch c JOIN nodes n ON n.kind = 'concept' AND length(n.title) >= 4 AND lower(n.title) NOT IN (lower(c.lang), lower(c.source))
AND regexp_matches(lower(c.text), '\b' || lower(n.title) || '\b'))"""


@query(f"WITH {_CH}, {_NODES} SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return relations.graph_nodes(_chunked(spark, sf)).select("id", "kind", "title", "source")


@query(f"WITH {_CH}, {_CONT} SELECT src, dst FROM cont")
def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return relations.graph_contains(_chunked(spark, sf)).select("src", "dst")


@query(f"WITH {_CH}, {_NODES}, {_MENT} SELECT src, dst FROM ment")
def graph_xref(spark: SparkSession, sf: str) -> DataFrame:
    return relations.graph_mentions(_chunked(spark, sf)).select("src", "dst")


@query(f"""WITH {_CH}, {_NODES}, {_CONT}, {_MENT},
d AS (SELECT src AS id, count(*) FILTER (WHERE kind = 'concept') AS s, count(*) FILTER (WHERE kind = 'chunk') AS c FROM cont JOIN nodes ON nodes.id = cont.dst GROUP BY src),
u AS (SELECT dst AS id, min(src) AS parent FROM cont GROUP BY dst), m AS (SELECT ment.dst AS id, count(*) AS m, string_agg(DISTINCT hp, '; ' ORDER BY hp) AS topics FROM ment JOIN ch ON chunk_id = ment.src GROUP BY ment.dst),
z AS (SELECT src AS id, string_agg(dst, '; ' ORDER BY dst) AS subs FROM cont JOIN nodes ON nodes.id = cont.dst AND kind = 'concept' GROUP BY src)
SELECT id, parent, coalesce(subs, '') AS subs, coalesce(s, 0) AS sub_concepts, coalesce(c, 0) AS direct_chunks, coalesce(m, 0) AS mentioned_by, coalesce(topics, '') AS topics FROM nodes LEFT JOIN z USING (id) LEFT JOIN d USING (id) LEFT JOIN u USING (id) LEFT JOIN m USING (id) WHERE kind = 'concept'""")
def related_concept(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chunked(spark, sf)
    of = relations.related_concepts(relations.graph_contains(rows), relations.graph_mentions(rows), relations.graph_nodes(rows))
    return of.select("id", "parent", F.array_join("subs", "; ").alias("subs"), "sub_concepts", "direct_chunks", "mentioned_by", F.array_join("topics", "; ").alias("topics"))


# ---- Retention


def _retained(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents with retention fields, and their scores."""
    labels = _t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    updated = F.timestamp_micros(F.unix_micros(F.lit("2023-06-01 00:00:00").cast("timestamp")) + F.pmod("doc_id", F.lit(300)) * 86_400_000_000)
    docs = d.select(
        F.col("doc_id").alias("id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), updated.alias("updated"), F.coalesce((F.col("quality") * 3).cast("int"), F.lit(2)).alias("importance"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("pinned"), F.when(F.pmod("doc_id", F.lit(5)) == 0, F.timestamp_micros(F.unix_micros(updated) + 100 * 86_400_000_000)).alias("expires"), F.when(F.col("source") == "src3", "archived").otherwise("active").alias("status"),
    )
    signals = _t(spark, sf, "events").groupBy(F.col("user_id").alias("document_id")).agg(F.max("ts").alias("last_access"), F.count("*").cast("int").alias("access_count"))
    incoming = docs.groupBy(F.floor(F.col("id") / 7).alias("dst_document")).agg(F.count("*").alias("incoming"))
    return docs, lifecycle.scored(docs, signals, incoming, NOW)


_SCORED = f"""
lb AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT d.doc_id AS id, lang || '/' || d.doc_id || '.md' AS path, TIMESTAMP '2023-06-01' + (d.doc_id % 300)::INT * INTERVAL 1 DAY AS updated, coalesce(quality * 3, 2) AS importance, coalesce(toxic, 0) = 1 AS pinned,
 CASE WHEN d.doc_id % 5 = 0 THEN TIMESTAMP '2023-06-01' + (d.doc_id % 300 + 100)::INT * INTERVAL 1 DAY END AS expires, CASE WHEN source = 'src3' THEN 'archived' ELSE 'active' END AS status FROM documents d LEFT JOIN lb USING (doc_id)),
sg AS (SELECT user_id AS id, max(ts) AS last_access, count(*) AS access_count FROM events GROUP BY user_id), ic AS (SELECT id // 7 AS id, count(*) AS incoming FROM docs GROUP BY ALL),
b AS (SELECT docs.*, coalesce(access_count, 0) AS n, coalesce(incoming, 0) AS links, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(greatest(updated, coalesce(last_access, updated)))) / 86400000000.0) AS days FROM docs LEFT JOIN sg USING (id) LEFT JOIN ic USING (id)),
sc AS (SELECT *, 2 * pow(0.5, days / 30) AS recency, ln(1 + n) AS usage, 0.5 * links AS linked, CASE WHEN pinned THEN 1000.0 ELSE 0.0 END AS pin, 0.0 - days / 30 AS stale FROM b)"""
_SUM = "recency + usage + importance + linked + pin + stale"


@query(f"WITH {_SCORED} SELECT id, round({_SUM}, 6) AS prune_score FROM sc")
def prune_score(spark: SparkSession, sf: str) -> DataFrame:
    return _retained(spark, sf)[1].select("id", _r("prune_score").alias("prune_score"))


@query(f"WITH {_SCORED} SELECT id, round(recency, 4) AS recency, round(usage, 4) AS usage, round(importance::DOUBLE, 4) AS importance, round(linked::DOUBLE, 4) AS links, round(pin::DOUBLE, 4) AS pinned, round(0.0 + stale, 4) AS staleness FROM sc")
def explain_prune(spark: SparkSession, sf: str) -> DataFrame:
    return _retained(spark, sf)[1].select("id", *[_r(f"part_{c}", 4).alias(c) for c in ("recency", "usage", "importance", "links", "pinned", "staleness")])


@query(f"WITH {_SCORED} SELECT id, path FROM docs WHERE status = 'active' AND NOT pinned AND expires <= TIMESTAMP '{NOW}'")
def ttl_expired(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.expired(_retained(spark, sf)[0], NOW).select("id", "path")


@query(f"WITH {_SCORED} SELECT id, round(days, 6) AS idle_days FROM sc WHERE status = 'active' AND NOT pinned AND {_SUM} <= 2.0 AND days >= 60")
def decay_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.decayed(_retained(spark, sf)[1], 2.0, 60).select("id", _r("idle_days").alias("idle_days"))


@query(f"WITH {_SCORED}, e AS (SELECT id FROM docs WHERE status = 'active' AND NOT pinned AND expires <= TIMESTAMP '{NOW}') SELECT id, CASE WHEN id IN (FROM e) THEN '90-archive/' || path ELSE path END AS path, CASE WHEN id IN (FROM e) THEN 'archived' ELSE status END AS status FROM docs")
def archive_apply(spark: SparkSession, sf: str) -> DataFrame:
    docs, _ = _retained(spark, sf)
    return lifecycle.archive(docs, lifecycle.archive_plan(lifecycle.expired(docs, NOW), "expired", NOW, "b1")).select("id", "path", "status")


@query(f"WITH {_SCORED} SELECT id, path, status FROM docs")
def archive_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Archived and put back: every document as it was."""
    docs, _ = _retained(spark, sf)
    plan = lifecycle.archive_plan(lifecycle.expired(docs, NOW), "expired", NOW, "b1")
    return lifecycle.restore(lifecycle.archive(docs, plan), plan, batch="b1")[0].select("id", "path", "status")


@query(f"""WITH {_SCORED}, e AS (SELECT id, 'expired' AS reason FROM docs WHERE status = 'active' AND NOT pinned AND expires <= TIMESTAMP '{NOW}'),
f AS (SELECT id, 'decayed' AS reason FROM sc WHERE status = 'active' AND NOT pinned AND {_SUM} <= 0 AND days >= 90 AND id NOT IN (SELECT id FROM e)) SELECT id AS document_id, reason FROM e UNION ALL SELECT id, reason FROM f""")
def maintenance_tick(spark: SparkSession, sf: str) -> DataFrame:
    docs, scores = _retained(spark, sf)
    return lifecycle.maintenance(docs, scores.select(*docs.columns, "prune_score", "idle_days"), NOW).select("document_id", "reason")


@query("SELECT user_id AS document_id, max(ts) AS last_access, count(DISTINCT props)::INT AS access_count FROM events GROUP BY user_id")
def record_access(spark: SparkSession, sf: str) -> DataFrame:
    log = _t(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.col("props").alias("call"))
    none = log.select("document_id", F.col("at").alias("last_access"), F.lit(0).alias("access_count")).where("false")
    return lifecycle.record_access(none, log)


@query(f"SELECT event_id AS id, event_type AS title, ts AS start_ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '{NOW}' ORDER BY ts, event_id LIMIT 50")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("title"), F.col("ts").alias("start_ts"))
    return search.timeline(rows, moment("2024-01-05 00:00:00"), moment(NOW))


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY lang")
def vault_status(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("(uncategorized)")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS chunks FROM documents GROUP BY source")
def list_sources(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.list_sources(_t(spark, sf, "documents"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("documents", "embeddings", "events", "labels")))
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return state.counts({t: _t(spark, sf, t) for t in ("documents", "embeddings", "events", "labels")})


@query("SELECT doc_id, lang, n_chars FROM documents WHERE (lang = 'en' OR lower(lang) LIKE 'en/%') AND source = 'src1'")
def scoped_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").withColumn("category", F.col("lang"))
    return search.scope(docs, category="en", source="src1").select("doc_id", "lang", "n_chars")


# ---- Files


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    name = F.concat("p_brand", F.lit("_"), "p_name", F.lit(" "), F.element_at(F.array(*map(F.lit, ("lecture", "Midterm", "lab", "solution", "guide", "x"))), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int")), F.pmod("p_partkey", F.lit(9)).cast("string"))
    rows = p.select(
        F.col("p_partkey").alias("id"), F.concat("p_type", F.lit("/"), name, F.lit(".pdf")).alias("path"), (F.col("p_size").cast("long") * 200_000).alias("size_bytes"), (F.col("p_size") * 5).alias("pages"),
        F.lit(None).cast("string").alias("meta_title"), F.lit(None).cast("string").alias("first_line"), (F.pmod("p_partkey", F.lit(11)) == 0).alias("missing"), F.md5("p_name").alias("content_hash"),
    )
    return files.describe(rows).withColumns({"original_filename": F.element_at(F.split("path", "/"), -1), "current_path": F.col("path"), "extension": F.lit(".pdf")})


_CAT = r"""
c0 AS (SELECT p_partkey AS id, p_type AS course, p_brand || '_' || p_name || ' ' || ['lecture','Midterm','lab','solution','guide','x'][p_partkey % 6 + 1] || p_partkey % 9 AS s, p_size * 200000 AS size_bytes, p_size * 5 AS pages, p_partkey % 11 = 0 AS missing, md5(p_name) AS content_hash FROM part),
c1 AS (SELECT *, trim(regexp_replace(replace(replace(s, '_', ' '), '-', ' '), '\s+', ' ', 'g')) AS base, lower(regexp_replace(regexp_replace(regexp_replace(s || '.pdf ', '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')) AS low FROM c0),
cat AS (SELECT *, CASE WHEN contains(low, 'solution') THEN 'solutions' WHEN regexp_matches(low, '\b(midterm|final|exam|test|quiz)\b') THEN 'exam' WHEN contains(low, 'formula') THEN 'formula-sheet' WHEN regexp_matches(low, '\b(manual|guide|programmers?)\b') THEN 'manual'
 WHEN regexp_matches(low, '\b(homework|assignment|worksheet|workbook|lab|hw)\b') THEN 'assignment' WHEN pages >= 150 AND size_bytes > 5000000 THEN 'textbook' WHEN regexp_matches(low, '\b(lecture|slides?|chapter|ch)\b') THEN 'slides' ELSE 'notes' END AS doc_type FROM c1)"""
_DESC = "course || ' — ' || base || ' [' || doc_type || ']'"


@query(f"WITH {_CAT} SELECT id, course, doc_type, {_DESC} AS descriptive_name FROM cat")
def doc_type(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("id", "course", "doc_type", "descriptive_name")


@query(f"WITH {_CAT} SELECT id, {_DESC} AS descriptive_name FROM cat WHERE NOT missing AND lower({_DESC}) LIKE '%mid%' AND course = 'ECONOMY' ORDER BY course, doc_type, {_DESC}, course || '/' || s || '.pdf' LIMIT 20")
def find_documents(spark: SparkSession, sf: str) -> DataFrame:
    return files.find_documents(_catalog(spark, sf), "Mid", "ECONOMY").select("id", "descriptive_name")


@query(f"WITH {_CAT} SELECT course, count(*) AS documents, count(*) FILTER (WHERE missing) AS missing FROM cat GROUP BY course")
def list_courses(spark: SparkSession, sf: str) -> DataFrame:
    return files.list_courses(_catalog(spark, sf))


@query(f"""WITH {_CAT} SELECT 'total' AS by, '' AS name, count(*) AS n, count(*) FILTER (WHERE missing) AS missing FROM cat UNION ALL SELECT 'type', doc_type, count(*), count(*) FILTER (WHERE missing) FROM cat GROUP BY doc_type UNION ALL SELECT 'course', course, count(*), count(*) FILTER (WHERE missing) FROM cat GROUP BY course""")
def catalog_stats(spark: SparkSession, sf: str) -> DataFrame:
    return files.catalog_stats(_catalog(spark, sf))


@query(f"WITH {_CAT}, f AS (SELECT content_hash, min(id) AS id FROM cat GROUP BY ALL) SELECT cat.id, f.id AS document_id FROM cat JOIN f USING (content_hash) WHERE cat.id <> f.id")
def catalog_dups(spark: SparkSession, sf: str) -> DataFrame:
    rows = _catalog(spark, sf).select("id", "content_hash")
    first = rows.groupBy("content_hash").agg(F.min("id").alias("document_id"))
    return rows.join(first, "content_hash").where("id <> document_id").select("id", "document_id")


@query(f"""WITH {_CAT}, r AS (SELECT id, course || '/' || s || '.pdf' AS old_path, course || '/' || course || '_' || regexp_replace(regexp_replace(base, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '_' || doc_type AS stem FROM cat WHERE NOT missing)
SELECT id, old_path, stem || CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY id) > 1 THEN '-' || id ELSE '' END || '.pdf' AS new_path FROM r""")
def rename_plan(spark: SparkSession, sf: str) -> DataFrame:
    return files.rename_plan(_catalog(spark, sf))


@query("""WITH o AS (SELECT 'p' || p_partkey AS path, p_partkey AS k, md5('h' || CASE WHEN p_partkey % 10 = 3 THEN -1 ELSE p_partkey END) AS h FROM part),
st AS (SELECT path, h FROM o WHERE k % 7 <> 0), sn AS (SELECT CASE WHEN k % 10 = 4 THEN 'moved/' || path ELSE path END AS path, CASE WHEN k % 10 = 5 THEN md5('new' || k) ELSE h END AS h, k % 2 AS odd FROM o WHERE k % 9 <> 0),
r AS (SELECT sn.path, st.h AS oh, st.h IS NOT NULL AND odd = 0 AS skipped, CASE WHEN st.h IS NOT NULL AND odd = 0 THEN st.h ELSE sn.h END AS h FROM sn LEFT JOIN st USING (path)),
lost AS (SELECT DISTINCT h, true AS lost FROM st WHERE path NOT IN (SELECT path FROM sn)),
ow AS (SELECT h, coalesce(bool_or(oh = h), false) AS stays, min(path) FILTER (oh <> h) AS taker, min(path) FILTER (oh IS NULL) AS fresh, coalesce(any_value(lost), false) AS lost FROM r LEFT JOIN lost USING (h) GROUP BY h)
SELECT path, CASE WHEN skipped THEN 'skipped' WHEN oh = h THEN 'refreshed' WHEN stays THEN 'duplicate' WHEN path = taker THEN 'updated' WHEN taker IS NOT NULL OR path <> fresh THEN 'duplicate' WHEN lost THEN 'moved' ELSE 'new' END AS action FROM r JOIN ow USING (h)
UNION ALL SELECT path, 'missing' FROM st WHERE path NOT IN (SELECT path FROM sn) AND h NOT IN (SELECT h FROM ow WHERE lost AND NOT stays AND taker IS NULL)""")
def catalog_cdc(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    own = F.md5(F.concat(F.lit("h"), F.when(F.pmod(k, F.lit(10)) == 3, F.lit(-1)).otherwise(k).cast("string")))
    rows = _t(spark, sf, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), k.alias("k"), own.alias("content_hash"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1.0).alias("mtime"), F.lit(False).alias("missing"))
    k = F.col("k")
    known = rows.where(F.pmod(k, F.lit(7)) != 0).drop("k")
    path = F.when(F.pmod(k, F.lit(10)) == 4, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    hashed = F.when(F.pmod(k, F.lit(10)) == 5, F.md5(F.concat(F.lit("new"), k.cast("string")))).otherwise(F.col("content_hash"))
    seen = rows.where(F.pmod(k, F.lit(9)) != 0).select(path.alias("path"), hashed.alias("content_hash"), "size_bytes", (F.lit(1.0) + F.pmod(k, F.lit(2))).alias("mtime"))
    return files.scan(known, seen)


# ---- Mail, calendar, journals, merges


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    kind, n = F.col("event_type"), F.pmod("event_id", F.lit(13))
    labels = F.array_compact(F.array(F.lit("INBOX"), F.when(kind == "purchase", F.lit("CATEGORY_PROMOTIONS")), F.when(kind == "error", F.lit("CATEGORY_UPDATES")), F.when(kind == "signup", F.lit("IMPORTANT")), F.when(n == 0, F.lit("STARRED")), F.when(n == 1, F.lit("SPAM")), F.when(n == 2, F.lit("CATEGORY_SOCIAL"))))
    return e.select(F.col("event_id").cast("string").alias("id"), "ts", labels.alias("labels"), (n == 3).alias("listed"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("sender"), F.concat(kind, F.lit("  unsubscribe  "), F.col("props")).alias("subject"))


_MAIL = """
m0 AS (SELECT event_id::VARCHAR AS id, event_id, ts, event_type AS k, event_id % 13 AS n, user_id, props FROM events),
m AS (SELECT *, CASE WHEN n = 1 THEN 'excluded' WHEN n = 0 THEN 'starred' WHEN k = 'purchase' THEN 'promotion' WHEN n = 2 THEN 'social' WHEN n = 3 OR k = 'error' THEN 'bulk' WHEN k = 'signup' THEN 'important' ELSE 'personal' END AS klass FROM m0),
t AS (SELECT *, CASE WHEN klass IN ('excluded', 'promotion', 'social') THEN 'skip' WHEN klass = 'bulk' THEN 'digest' ELSE 'keep' END AS action, isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS wk FROM m)"""


@query(f"WITH {_MAIL} SELECT id, klass, action, CASE klass WHEN 'starred' THEN 4 WHEN 'important' THEN 3 WHEN 'personal' THEN 3 WHEN 'bulk' THEN 1 ELSE 0 END AS importance, CASE klass WHEN 'bulk' THEN 30.0 WHEN 'important' THEN 180.0 WHEN 'personal' THEN 90.0 END::DOUBLE AS ttl_days FROM t")
def mail_classify(spark: SparkSession, sf: str) -> DataFrame:
    return mail.triage(_messages(spark, sf)).select("id", "klass", "action", "importance", "ttl_days")


@query(f"WITH {_MAIL} SELECT 'class' AS what, klass AS name, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'action', action, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'week', wk, count(*) FROM t WHERE action = 'digest' GROUP BY ALL")
def mail_plan(spark: SparkSession, sf: str) -> DataFrame:
    return mail.plan(mail.triage(_messages(spark, sf)))


@query(f"WITH {_MAIL} SELECT id, klass FROM t WHERE action = 'keep' ORDER BY ts, id LIMIT 50")
def mail_keepers(spark: SparkSession, sf: str) -> DataFrame:
    return mail.keepers(mail.triage(_messages(spark, sf))).select("id", "klass")


_LINES = r"""l AS (SELECT 'gmail://digest/' || wk AS source_ref, 'Mail digest — ' || isoyear(ts) || ' week ' || lpad(week(ts)::VARCHAR, 2, '0') AS title, '- ' || strftime(ts, '%Y-%m-%d') || ' · user ' || user_id || ' · ' || trim(regexp_replace(replace(k || '  unsubscribe  ' || props, 'unsubscribe', ' '), '\s+', ' ', 'g')) || ' <!-- id:' || id || ' -->' AS line FROM t WHERE action = 'digest')"""


@query(f"WITH {_MAIL}, {_LINES} SELECT source_ref, any_value(title) AS title, count(*) AS n, '# ' || any_value(title) || chr(10) || chr(10) || count(*) || ' message(s) rolled up from bulk/list mail.' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line DESC) || chr(10) || chr(10) || '<!-- source_ref: ' || source_ref || ' -->' || chr(10) AS body FROM l GROUP BY source_ref")
def weekly_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of two halves of the mail, merged, as a later sync would."""
    items = mail.digest_items(mail.triage(_messages(spark, sf)))
    old = items.where("message_id % 2 = 0")
    return mail.render_digests(mail.merge_digests(old, items.where("message_id % 3 <> 0 OR message_id % 2 <> 0")))


@query(f"WITH {_MAIL}, {_LINES} SELECT line, regexp_extract(line, 'id:(\\S+)', 1) AS message_id FROM l")
def digest_parse(spark: SparkSession, sf: str) -> DataFrame:
    notes = mail.render_digests(mail.digest_items(mail.triage(_messages(spark, sf))))
    return notes.select(F.explode(mail.parse_digest(F.col("body"))).alias("i")).select("i.line", "i.message_id")


@query(r"SELECT conv_id, turn, CASE WHEN length(s) > 500 THEN rtrim(left(s, 500)) || '…' ELSE s END AS snippet FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM conversations)")
def clean_snippet(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("​View this email in your browser "), F.col("text"), F.lit("͏ Unsubscribe"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", tx.clean_snippet(padded).alias("snippet"))


@query("SELECT event_id, isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS week, 'Mail digest — ' || isoyear(ts) || ' week ' || lpad(week(ts)::VARCHAR, 2, '0') AS title FROM events")
def iso_weeks(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", week_key(F.col("ts")).alias("week"), digest_title(F.col("ts")).alias("title"))


@query(r"""SELECT event_id::VARCHAR AS id, upper(event_type) AS "group", '# ' || upper(event_type) || ': note ' || event_id || chr(10) || chr(10) || '- **When:** ' || strftime(ts, '%Y-%m-%d') || chr(10) || chr(10) || '<!-- source_ref: gcal://event/' || event_id || ' -->' || chr(10) AS body FROM events WHERE event_type <> 'error'""")
def calendar_notes(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    day = F.struct(F.lit(None).cast("string").alias("dateTime"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    none = F.struct(F.lit(None).cast("string").alias("dateTime"), F.lit(None).cast("string").alias("date"))
    ident = F.col("event_id").cast("string")
    raw = e.select(ident.alias("id"), F.concat(F.upper("event_type"), F.lit(": note "), ident).alias("summary"), F.lit(None).cast("string").alias("description"), F.lit("").alias("location"), day.alias("start"), none.alias("end"), F.lit(None).cast("string").alias("htmlLink"), F.when(F.col("event_type") == "error", "cancelled").otherwise("confirmed").alias("status"))
    return mail.event_notes(raw).select("id", "group", "body")


@query("WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0), w AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '+' ELSE text END AS text FROM documents WHERE doc_id % 4 <> 0) SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN w.doc_id IS NULL THEN 'kept' WHEN o.text = w.text THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN w USING (doc_id)")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select("doc_id", "text")
    new = d.where("doc_id % 4 <> 0").withColumn("text", F.when(F.pmod("doc_id", F.lit(5)) == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")))
    return state.merge(d.where("doc_id % 3 <> 0"), new, "doc_id", ["text"])


@query("WITH o AS (SELECT doc_id AS key, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), w AS (SELECT doc_id AS key, md5(CASE WHEN doc_id % 5 = 0 THEN text || '+' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) SELECT key, CASE WHEN w.h IS NULL THEN 'removed' WHEN o.h IS NULL THEN 'new' WHEN o.h = w.h THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN w USING (key)")
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    now = F.when(F.pmod("key", F.lit(5)) == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text"))
    return state.manifest_diff(d.where("key % 3 <> 0").select("key", F.md5("text").alias("hash")), d.where("key % 4 <> 0").select("key", F.md5(now).alias("hash")))


@query("SELECT conv_id AS id, '# Journal ' || conv_id || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id")
def journal_append(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "conversations")
    pages = c.select(F.col("conv_id").alias("id")).distinct().withColumn("body", F.concat(F.lit("# Journal "), F.col("id").cast("string")))
    return state.append_texts(pages, c.select(F.col("conv_id").alias("id"), F.col("turn").alias("at"), "text"))


@query("""WITH o AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0), s AS (SELECT sha256(trim(coalesce(text, ''))) AS h, min(doc_id)::VARCHAR AS same FROM o GROUP BY ALL)
SELECT doc_id AS id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN same IS NOT NULL OR doc_id <> fst THEN 'duplicate' ELSE 'create' END AS decision, CASE WHEN same IS NOT NULL THEN same WHEN doc_id <> fst AND trim(coalesce(text, '')) <> '' THEN fst::VARCHAR END AS target
FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256(trim(coalesce(text, '')))) AS fst FROM documents WHERE doc_id % 2 = 1) d LEFT JOIN s ON s.h = sha256(trim(coalesce(d.text, '')))""")
def capture_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the documents captured into a vault of the other half."""
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    olds = d.where("id % 2 = 0").groupBy(tx.body_hash(F.col("body")).alias("h"), "body").agg(F.min("id").cast("string").alias("id")).drop("h")
    none = spark.createDataFrame([], "new_id long, id string, score double")
    return state.capture_plan(d.where("id % 2 = 1"), olds, none)


@query("SELECT 'staging/' || event_id AS path, CASE WHEN event_type = 'error' THEN 'skipped' WHEN row_number() OVER (PARTITION BY CASE WHEN event_type <> 'error' THEN user_id || event_type END ORDER BY 'staging/' || event_id) = 1 THEN 'imported' ELSE 'repeated' END AS status FROM events")
def import_staging(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    ref = F.when(F.col("event_type") != "error", F.concat(F.col("user_id").cast("string"), "event_type"))
    return state.import_staging(e.select(F.concat(F.lit("staging/"), F.col("event_id").cast("string")).alias("path"), ref.alias("source_ref")))


# ---- Chunks, sections, streams


@query("SELECT doc_id::VARCHAR || '#0' AS chunk_id, 0 AS ordinal, '' AS heading_path, text, greatest(1, round_even(length(text) / 4, 0))::INT AS token_count FROM documents WHERE trim(text) <> ''")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_t(spark, sf, "documents"), "doc_id").select("chunk_id", "ordinal", "heading_path", "text", "token_count")


_PARTS = [("'T' || doc_id", "'# T' || doc_id || chr(10) || chr(10) || 'intro'", 0, "NULL"), ("'T' || doc_id || ' > Body'", "'## Body' || chr(10) || chr(10) || trim(text)", 1, "7"),
          ("'T' || doc_id || ' > Body > Deep'", "'### Deep' || chr(10) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || chr(10) || 'x' || chr(10) || '```'", 2, "7"), ("'Z'", "'# Z' || chr(10) || chr(10) || 'end'", 3, "7")]


@query(" UNION ALL ".join(f"SELECT doc_id::VARCHAR || '#{n}' AS chunk_id, {n} AS ordinal, {path} AS heading_path, {page}::INT AS page, {text} AS text FROM documents WHERE trim(text) <> ''" for path, text, n, page in _PARTS))
def chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Four sections of each document, one with a page and one with a fence; the whole text is the second's."""
    whole = F.concat(F.lit("# T"), F.col("doc_id").cast("string"), F.lit("\n\nintro\n\n<!-- page: 7 -->\n\n## Body\n\n"), "text", F.lit("\n\n### Deep\n\n```\n# no heading\n\nx\n```\n\n# Z\n\nend"))
    docs = _t(spark, sf, "documents").where(F.trim("text") != "").select("doc_id", whole.alias("text"))
    return chunking.chunk(docs, "doc_id", target=10**9).select("chunk_id", "ordinal", "heading_path", "page", "text")


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as Markdown: titles as headings, paragraphs apart, other tags gone."""
    h = F.regexp_replace(F.col("html"), r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->", "")
    h = F.regexp_replace(F.regexp_replace(h, r"(?is)<h1[^>]*>(.*?)</h1>", "\n\n# $1\n\n"), r"(?is)<p[^>]*>", "\n\n")
    h = F.regexp_replace(F.regexp_replace(h, r"(?s)<[^>]+>", " "), "&amp;", "&")
    return _t(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source"), F.trim(F.regexp_replace(h, r"\n{3,}", "\n\n")).alias("text"))


@query()
def chunk_pages(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk(_markdown(spark, sf), target=200)


@query(r"SELECT doc_id::VARCHAR AS source, regexp_replace('## Body' || chr(10) || chr(10) || text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL")
def get_section(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("# Top\n\nIntro\n\n## Body\n\n"), "text", F.lit("\n\n## Notes\n\nend")).alias("text"))
    return search.get_section(rows, "Top > Body")


def _stream(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Events as a stream of files, and a checkpoint folder: the shared one, where there is one."""
    schema = _t(spark, sf, "events").schema
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet" + ("*" if not _is_folder(spark, f"{sf}/events.parquet") else "")), where


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("SELECT user_id AS document_id, count(*) AS access_count, max(ts) AS last_access FROM events GROUP BY user_id")
def stream_access_counts(spark: SparkSession, sf: str) -> DataFrame:
    stream, where = _stream(spark, sf)
    return jobs.drain(jobs.access_counts(stream.select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"))), where)


@query("SELECT isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS week, count(*) AS n FROM events GROUP BY ALL")
def stream_weekly_digest(spark: SparkSession, sf: str) -> DataFrame:
    stream, where = _stream(spark, sf)
    return jobs.drain(jobs.weekly_counts(stream), where)
