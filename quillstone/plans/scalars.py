"""Queries of the expressions: strings, times and numbers by themselves, and lookups over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..functions.frontmatter import dumped, parsed
from ..operators import lifecycle, mail, relations, search, similarity, state, syncing
from ..sources.files import inbox
from .catalog import _CH, _CONT, _MENT, _NODES, NOW, _bm25_sql, _chunked, _t, query

_SLUG = "coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), lambda x: x <> '')[1:8], '-'), ''), 'note')"


@query(f"SELECT doc_id, {_SLUG.format(c='text')} AS slug FROM documents")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", tx.slugify(F.col("text")).alias("slug"))


_PATH = "p_brand || '/' || replace(p_name, ' ', '-') || '.md'"


@query(f"""WITH p AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') AS stem, p_name AS title FROM part), k AS (SELECT id, unnest([stem, {_SLUG.format(c='stem')}, title, {_SLUG.format(c='title')}]) AS key FROM p)
SELECT DISTINCT id, key FROM k WHERE key <> ''""")
def link_target_keys(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".md"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(tx.link_keys(path, F.col("p_name"))).alias("key"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, arg_min(trim(line), n) AS line FROM l WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') GROUP BY doc_id)
SELECT doc_id, left(coalesce(line, ''), 160) AS summary, greatest(1, round_even(length(coalesce(text, '')) / 4, 0))::INT AS tokens FROM documents LEFT JOIN f USING (doc_id)""")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    body = tx.or_empty(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", tx.first_line(body).alias("summary"), tx.est_tokens(body).alias("tokens"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'About ' || p_name WHEN p_partkey % 3 = 1 THEN replace(replace(p_name, ' ', '-'), '-', ' ') ELSE 'Untitled' END AS title,
CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || '/x.md' END AS label FROM part""")
def titles(spark: SparkSession, sf: str) -> DataFrame:
    """A note's title from its first heading, its file's name, or none; and what it is called in reports."""
    k = F.pmod("p_partkey", F.lit(3))
    body = F.when(k == 0, F.concat(F.lit("text\n## About "), F.col("p_name"), F.lit(" \n# other"))).otherwise(F.lit("text"))
    path = F.when(k == 2, F.lit("a/")).otherwise(F.concat(F.lit("a/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".md")))
    called = tx.label(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.lit("  ")), F.concat("p_brand", F.lit("/x.md")), F.lit("?"))
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.fallback_title(body, path).alias("title"), called.alias("label"))


@query(f"SELECT p_partkey AS id, '90-archive/' || {_PATH} AS archived, {_PATH} AS corpus, '# ' || p_name || chr(10) || chr(10) || p_type AS body, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm FROM part")
def paths(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".md"))
    pdf = F.regexp_replace(path, "md$", "pdf")
    return _t(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), tx.archive_path(path).alias("archived"), tx.corpus_path(pdf).alias("corpus"), tx.with_title(F.col("p_name"), F.col("p_type")).alias("body"), tx.normal_title(F.col("p_name")).alias("norm")
    )


@query(r"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS at, date_trunc('second', ts) AS mailed, TIMESTAMP '2024-02-01' + INTERVAL 90 DAY AS expires FROM events")
def times(spark: SparkSession, sf: str) -> DataFrame:
    """ISO texts with and without time and zone, and ones that are none; a message's time from its header; a time to live."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.pmod("event_id", F.lit(4))
    text = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM"))
    sent = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return _t(spark, sf, "events").select("event_id", tm.parse_iso(text).alias("at"), tm.message_time(F.lit("none"), sent, NOW).alias("mailed"), tm.expires(NOW, F.lit(90)).alias("expires"))


@query("SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length, CASE WHEN list_dot_product(v, v) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS self FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.vector import dot, norm, unit

    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(norm(v), 6).alias("length"), F.round(dot(unit(v), unit(v)), 6).alias("self"))


@query("SELECT doc_id, lang, source, n_chars::VARCHAR AS n_chars, sha256(trim(text)) AS body FROM documents")
def note_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Notes written from fields and body, and read again."""
    fields = F.to_json(F.struct("lang", "source", "n_chars", F.lit("a: b, #c").alias("title"), F.array("lang", "source").alias("tags")))
    rows = _t(spark, sf, "documents").select("doc_id", parsed(dumped(fields, F.col("text"))).alias("p")).select("doc_id", "p.*")
    get = lambda x: F.get_json_object("frontmatter", f"$.{x}")
    return rows.where((get("title") == "a: b, #c") & F.col("error").isNull()).select("doc_id", get("lang").alias("lang"), get("source").alias("source"), get("n_chars").alias("n_chars"), tx.body_hash(F.col("body")).alias("body"))


# ---- Lookups, children, logs


@query("SELECT doc_id::VARCHAR AS id, left(text, 40) AS body, length(text) > 40 AS truncated FROM documents WHERE doc_id = 7")
def get_note(spark: SparkSession, sf: str) -> DataFrame:
    """By path, as neither an id nor a source_ref is meant."""
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("ref/"), F.col("doc_id").cast("string")).alias("source_ref"), F.concat(F.lit("n/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("body"))
    return search.get_note(docs, "n/7.md", 40).select("id", "body", "truncated")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0")
def list_inbox(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.when(F.pmod("doc_id", F.lit(4)) == 0, "00-inbox/").when(F.pmod("doc_id", F.lit(4)) == 1, "00-inbox/deep/").otherwise("20-notes/")
    rows = _t(spark, sf, "documents").select("doc_id", F.concat(folder, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return inbox(rows).select("doc_id")


@query("SELECT o_custkey AS document_id, count(*) AS n FROM orders WHERE o_custkey % 3 <> 0 GROUP BY ALL UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey")
def replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Children of changed parents are replaced by one each; others stay."""
    old = _t(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("chunk"))
    changed = old.where("document_id % 3 = 0").select("document_id").distinct()
    rows = state.replace_by(old, changed.withColumn("chunk", F.lit(0).cast("long")), "document_id", changed)
    return rows.groupBy("document_id").agg(F.count("*").alias("n"))


@query("SELECT 'documents' AS name, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT 'chunks', count(*) FROM orders WHERE o_custkey % 5 <> 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def delete_documents(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"documents": _t(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "chunks": _t(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"))}
    return state.counts(state.delete_document(tables, tables["documents"].where("id % 5 = 0")))


@query("SELECT s_suppkey AS id, 's-' || s_suppkey AS source_ref, CASE WHEN s_suppkey % 3 = 0 THEN 'created' WHEN s_suppkey % 3 = 1 THEN 'updated' ELSE 'unchanged' END AS action FROM supplier")
def upsert_by_ref(spark: SparkSession, sf: str) -> DataFrame:
    new = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("source_ref"), F.col("s_name").alias("title"))
    old = new.where("id % 3 <> 0").withColumn("title", F.when(F.col("id") % 3 == 1, F.lit("old")).otherwise(F.col("title")))
    acts = state.merge(old.select("source_ref", "title"), new.select("source_ref", "title"), "source_ref", ["title"])
    return new.join(acts, "source_ref").select("id", "source_ref", "action")


@query(f"SELECT '- ' || strftime(TIMESTAMP '{NOW}', '%Y-%m-%dT%H:%M:%S') || ' `' || lang || '/' || doc_id || '` archive (expired)' AS line FROM documents")
def tombstones_map(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return lifecycle.tombstones_map(lifecycle.archive_plan(docs, "expired", NOW, "b"))


@query("WITH v AS (SELECT label::VARCHAR AS id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT id, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM v), m AS (SELECT id, p, avg(x) AS w FROM u GROUP BY ALL), n AS (SELECT id, p, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM m) SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS similarity FROM n a JOIN n b ON a.p = b.p AND a.id < b.id GROUP BY ALL HAVING sum(a.w * b.w) >= 0")
def near_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with several chunks are compared by their mean vectors; ids may be texts."""
    rows = similarity.centroids(_t(spark, sf, "embeddings").select(F.col("label").cast("string").alias("id"), "embedding"), "id", "embedding")
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("p")).select("id", F.transform("p", lambda p: p["w"]).alias("v"))
    return similarity.near_pairs(whole, 0.0, id_type="string").select("a", "b", F.round("similarity", 6).alias("similarity"))


# ---- Mail, graph, search in its modes


@query("SELECT event_id, 'user ' || user_id AS sender, '' AS none FROM events")
def mail_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The first header of a name whatever its case, and an empty text where there is none."""
    who = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    heads = F.array(pair("Subject", F.col("event_type")), pair("FROM", who), pair("from", F.lit("later")))
    return _t(spark, sf, "events").select("event_id", mail.header(heads, "From").alias("sender"), mail.header(heads, "List-Id").alias("none"))


@query("SELECT isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS wk, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 1 OR event_id % 3 = 0) AS replaced FROM events GROUP BY ALL")
def digest_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Late messages are added to their week's digest, ones that are there already replaced."""
    rows = _t(spark, sf, "events").select(tm.digest_key(F.col("ts")).alias("source_ref"), tm.digest_title(F.col("ts")).alias("title"), F.col("event_id").cast("string").alias("message_id"), "event_id")
    line = lambda mark: F.concat(F.lit(mark), "message_id").alias("line")
    cut = lambda df, mark: df.select("source_ref", "title", "message_id", line(mark))
    both = mail.merge_digests(cut(rows.where("event_id % 3 <> 0"), "old "), cut(rows.where("event_id % 2 = 1 OR event_id % 3 = 0"), "new "))
    return both.groupBy(F.regexp_replace("source_ref", "^.*/", "").alias("wk")).agg(F.count("*").alias("n"), F.count_if(F.startswith("line", F.lit("new"))).alias("replaced"))


@query(f"""WITH {_CH}, {_NODES}, {_CONT}, {_MENT} SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'concepts', count(*) FROM nodes WHERE kind = 'concept'
UNION ALL SELECT 'edges', (SELECT count(*) FROM cont) + (SELECT count(*) FROM ment) UNION ALL SELECT 'cross_references', count(*) FROM ment""")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chunked(spark, sf)
    return relations.graph_stats(relations.graph_nodes(rows), relations.graph_contains(rows), relations.graph_mentions(rows))


@query("SELECT DISTINCT lower(lang) AS term, lang AS id FROM documents UNION SELECT DISTINCT lower(source), lang || ' > ' || source FROM documents")
def glossary(spark: SparkSession, sf: str) -> DataFrame:
    return relations.glossary(relations.graph_nodes(_chunked(spark, sf)))


@query("SELECT s AS concept FROM (SELECT DISTINCT lang AS s FROM documents UNION SELECT DISTINCT lang || ' > ' || source FROM documents) ORDER BY s LIMIT 20")
def sample_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty by name: the limit is the feature."""
    return relations.sample_concepts(relations.graph_nodes(_chunked(spark, sf)))


def _by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks under a heading in letters beyond ASCII, whose texts name the heading of another language as whole words, and longer words that only hold one."""
    d = _t(spark, sf, "documents")
    other = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    text = F.concat(F.lit("Siehe ÜBERSICHT: "), other, F.lit(", 概要説明 und ÉTUDESX. "), F.coalesce("text", F.lit("")))
    return d.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), "source", F.concat(F.lit("Übersicht: "), "lang", F.lit(" > "), F.when(F.pmod("doc_id", F.lit(3)) == 0, "概要説明").otherwise("Études")).alias("heading_path"), text.alias("text"))


@query(r"""WITH ch AS (SELECT 'c' || doc_id AS chunk_id, 'Übersicht: ' || lang AS one, CASE WHEN doc_id % 3 = 0 THEN '概要説明' ELSE 'Études' END AS two,
lower('Siehe ÜBERSICHT: ' || ['en', 'de', 'fr', 'es'][doc_id % 4 + 1] || ', 概要説明 und ÉTUDESX. ' || coalesce(text, '')) AS text FROM documents),
nodes AS (SELECT DISTINCT one AS id, one AS title FROM ch UNION SELECT DISTINCT one || ' > ' || two, two FROM ch)
SELECT chunk_id AS src, id AS dst FROM ch JOIN nodes ON lower(title) NOT IN (lower(one), lower(two)) AND regexp_matches(text, '(^|[^\p{L}\p{N}\p{M}_])' || lower(title) || '($|[^\p{L}\p{N}\p{M}_])')""")
def graph_xref_unicode(spark: SparkSession, sf: str) -> DataFrame:
    return relations.graph_mentions(_by_language(spark, sf)).select("src", "dst")


@query(f"""WITH {_CH}, {_NODES}, {_CONT}, {_MENT} SELECT 'en > src1' AS id, 'en' AS parent, count(*) FILTER (WHERE lang = 'en' AND source = 'src1') AS direct_chunks,
(SELECT count(*) FROM ment WHERE dst = 'en > src1') AS mentioned_by FROM ch""")
def concept_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Looked up by a part of its path, whatever the case."""
    rows = _chunked(spark, sf)
    found = relations.related_concept(" EN > Src1 ", relations.graph_contains(rows), relations.graph_mentions(rows), relations.graph_nodes(rows))
    return found.select("id", "parent", "direct_chunks", "mentioned_by")


@query("SELECT source, sum(n)::BIGINT AS n, sum(pages)::BIGINT AS pages FROM (SELECT source, lang, count(*) AS n, 1 AS pages FROM documents GROUP BY ALL) GROUP BY source")
def sync_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of pages summed by source, the breakdown kept."""
    page = _t(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return syncing.accumulate(page, "source")


def _notes_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = _t(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    chunks = d.select(
        F.lpad(key, 12, "0").alias("chunk_id"), key.alias("document_id"), F.concat("lang", F.lit("/"), key).alias("path"), F.concat(F.lit("Note "), key).alias("title"), F.lit("").alias("heading_path"),
        F.lit(None).cast("int").alias("page"), "source", F.when(F.col("lang") == "fr", "archived").otherwise("active").alias("status"), "text", F.col("lang").alias("category"),
    )
    return chunks, _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""WITH {_bm25_sql("(SELECT * FROM documents WHERE lang = 'fr' OR lang = 'en')", "(SELECT item_id AS query_id, text FROM benchmark)")},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM bm), p AS (SELECT * FROM r WHERE rank <= 32),
f AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (lang = 'fr')::INT, rank) AS k, round(1.0 / (60 + rank), 6)::DOUBLE AS score FROM p JOIN documents ON doc_id = id)
SELECT query_id, id::VARCHAR AS document_id, k AS rank, score FROM f WHERE k <= 8""")
def search_lexical_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All items of the benchmark asked at once, in two categories, archived documents last; the budget is wide enough for all hits."""
    chunks, asks = _notes_of(spark, sf)
    hits = search.search(chunks.where("category IN ('en', 'fr')"), asks, mode="lexical", max_chars=10**6)
    return hits.select("query_id", F.col("citation.document_id").alias("document_id"), F.col("rank").cast("long").alias("rank"), "score")


@query()
def search_full(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid hits with their texts, under the usual budget."""
    chunks, asks = _notes_of(spark, sf)
    return search.search(chunks, asks, detail="full").select("query_id", "rank", "score", "snippet", "text", "used", "has_more", "citation.document_id")
