"""Queries of whole workflows: syncs, captures, the catalog's state, ingest and the knowledge store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as tx
from ..functions.time import moment
from ..operators import capturing, filing, knowledge, mail, relations, similarity, syncing
from ..session import kept, shared_dir
from ..streaming import jobs
from .catalog import _CH, _CONT, _HASHED, _MENT, _NODES, _TOK, ASK, NOW, _chunked, _r, _t, query

# ---- Names


@query(r"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, sha256(event_id::VARCHAR) AS h, '0123456789ABCDEFGHJKMNPQRSTVWXYZ' AS d FROM events)
SELECT event_id, array_to_string(list_transform(range(10), lambda i: substr(d, ((ms >> (45 - 5 * i)) & 31)::INT + 1, 1)), '') ||
array_to_string(list_transform(range(16), lambda i: substr(d, (('0x' || substr(h, (2 * i + 1)::INT, 2))::INT & 31) + 1, 1)), '') AS id FROM e""")
def new_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").select("event_id", identity.new_id(F.col("ts"), F.col("event_id").cast("string")).alias("id"))


@query("SELECT doc_id, 'note:' || lang || '/n' || doc_id || '.md' AS key FROM documents")
def note_keys(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/vault\\"), "lang", F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _t(spark, sf, "documents").select("doc_id", identity.note_key(identity.relative_path(path, "/vault")).alias("key"))


@query("""SELECT p_partkey, 'Scheduler tick (' || CASE WHEN p_partkey % 2 = 0 THEN 'apply' ELSE 'dry-run' END || '): reindexed ' || p_size || ' note(s), removed ' || p_partkey % 3 || '; TTL ' ||
CASE WHEN p_partkey % 2 = 0 THEN 'archived ' ELSE 'would archive ' END || p_partkey % 5 || '; decay ' || CASE WHEN p_partkey % 2 = 0 THEN 'archived ' ELSE 'would archive ' END || p_partkey % 7 || '; backup commit ' ||
CASE WHEN p_partkey % 4 = 0 THEN 'no changes' ELSE left(md5(p_name), 10) END || '; db snapshot ' || CASE WHEN p_partkey % 6 = 0 THEN 'none' ELSE p_type END || '.' AS line FROM part""")
def tick_lines(spark: SparkSession, sf: str) -> DataFrame:
    mod = lambda n: F.pmod("p_partkey", F.lit(n))
    line = identity.tick_line(mod(2) == 0, F.col("p_size"), mod(3), mod(5), mod(7), F.when(mod(4) != 0, F.md5("p_name")), F.when(mod(6) != 0, F.col("p_type")))
    return _t(spark, sf, "part").select("p_partkey", line.alias("line"))


@query("""WITH e AS (SELECT strftime(ts, '10-journal/%Y/%Y-%m-%d.md') AS path, strftime(ts, '%Y-%m-%d') AS day, string_agg(chr(10) || chr(10) || '## ' || strftime(ts, '%H:%M') || chr(10) || chr(10) || event_type || ' ' || event_id, '' ORDER BY ts, event_id) AS more FROM events GROUP BY ALL)
SELECT path, day AS title, CASE WHEN day::DATE < DATE '2024-01-10' THEN '# ' || day || chr(10) || 'kept' ELSE '# ' || day END || more || chr(10) AS body FROM e""")
def journal_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of all events; pages of the first days are there already."""
    e = _t(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    pages = e.where("ts < '2024-01-10'").select(identity.journal_path(F.col("ts")).alias("path"), day.alias("title"), F.concat(F.lit("# "), day, F.lit("\nkept\n\n\n")).alias("body")).distinct()
    return capturing.journal(pages, e.select(F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.concat(F.lit(" "), "event_type", F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")).alias("text")))


@query("SELECT '2024-01-02T00:00:00Z' AS since, '2025-01-31T00:00:00Z' AS until")
def first_sync_window(spark: SparkSession, sf: str) -> DataFrame:
    since, until = syncing.first_window(NOW)
    return spark.range(1).select(since.alias("since"), until.alias("until"))


@query("SELECT event_id, nullif(concat_ws(' ', CASE WHEN event_id % 2 = 0 THEN 'in:' || event_type END, CASE WHEN event_id % 3 = 0 THEN 'after:' || user_id END), '') AS q FROM events")
def mail_queries(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" in:"), "event_type", F.lit(" ")))
    return _t(spark, sf, "events").select("event_id", syncing.mail_query(asked, F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string"))).alias("q"))


# ---- Mail and calendar

_CLASS = "CASE event_type WHEN 'error' THEN 'excluded' WHEN 'signup' THEN 'starred' WHEN 'view' THEN 'bulk' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'bulk' ELSE 'important' END ELSE 'personal' END"
_MAIL = f"""m AS (SELECT event_id, ts, {_CLASS} AS klass FROM events WHERE event_id % 50 <> 0),
wk AS (SELECT isoyear(ts) || '-W' || lpad(week(ts)::VARCHAR, 2, '0') AS w, count(*) FILTER (WHERE event_id % 4 = 1) AS old, count(*) AS n FROM m WHERE klass = 'bulk' GROUP BY ALL)"""


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw messages; some have no id, every other click has a list header."""
    e = _t(spark, sf, "events")
    kind = F.col("event_type")
    labels = F.when(kind == "error", F.array(F.lit("SPAM"), F.lit("CHAT"), F.lit("INBOX"))).when(kind == "signup", F.array(F.lit("STARRED"))).when(kind == "view", F.array(F.lit("CATEGORY_UPDATES"))).when(kind == "click", F.array(F.lit("IMPORTANT"), F.lit("INBOX")))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    who = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    heads = F.array(pair("From", who), pair("subject", kind), pair("List-Id", F.when((kind == "click") & (F.col("event_id") % 2 == 0), F.lit("<l>"))))
    ident = F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("m"), F.col("event_id").cast("string")))
    return e.select("event_id", ident.alias("id"), labels.alias("labelIds"), F.col("props").alias("snippet"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("internalDate"), F.struct(heads.alias("headers")).alias("payload"))


def _no_notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], syncing.NOTES)


@query(f"""WITH {_MAIL} SELECT what, n FROM (SELECT 'count' AS what, (SELECT count(*) + 2 * count(*) FILTER (event_id % 10 = 3) FROM events) AS n UNION ALL SELECT 'repeated', (SELECT 2 * count(*) FILTER (event_id % 10 = 3) FROM events) UNION ALL SELECT 'kept', count(*) FROM m WHERE klass IN ('starred', 'important', 'personal') UNION ALL SELECT 'digested', count(*) FROM m WHERE klass = 'bulk'
UNION ALL SELECT 'skipped', (SELECT count(*) FROM events) - (SELECT count(*) FROM m WHERE klass <> 'excluded')
UNION ALL SELECT 'unchanged', (SELECT count(*) FROM m WHERE klass IN ('starred', 'important', 'personal') AND event_id % 4 = 1) + (SELECT count(*) FROM wk WHERE old = n)
UNION ALL SELECT 'created', (SELECT count(*) FROM m WHERE klass IN ('starred', 'important', 'personal') AND event_id % 4 <> 1) + (SELECT count(*) FROM wk WHERE old = 0)
UNION ALL SELECT 'updated', (SELECT count(*) FROM wk WHERE old > 0 AND old < n) UNION ALL SELECT 'class:' || klass, count(*) FROM m GROUP BY klass) WHERE n > 0""")
def sync_mail(spark: SparkSession, sf: str) -> DataFrame:
    """All messages, after a quarter of them were synced before; some are delivered three times."""
    rows = _messages(spark, sf)
    twice = rows.where("event_id % 10 = 3")
    rows = rows.unionByName(twice).unionByName(twice)
    before = kept(syncing.sync_messages(_no_notes(spark), rows.where("event_id % 4 = 1"), NOW)[0], "notes")
    return syncing.sync_messages(before, rows, NOW)[1].where("n > 0")


@query(f"WITH {_MAIL} SELECT 'gmail://digest/' || w AS source_ref, n FROM wk UNION ALL SELECT 'gmail://msg/m' || event_id, 0 FROM m WHERE klass IN ('starred', 'important', 'personal')")
def synced_mail_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The notes that are there then, and how many messages a digest holds."""
    rows = _messages(spark, sf)
    before = kept(syncing.sync_messages(_no_notes(spark), rows.where("event_id % 4 = 1"), NOW)[0], "notes")
    after, _ = syncing.sync_messages(before, rows, NOW)
    return after.select("source_ref", F.when(F.col("importance") == 1, F.size(mail.parse_digest(F.col("body")))).otherwise(0).cast("long").alias("n"))


@query(f"SELECT event_id, {_CLASS} AS klass, CASE {_CLASS} WHEN 'excluded' THEN 'not inbox mail (CHAT, SPAM)' WHEN 'starred' THEN 'starred by you (keeper, never auto-archives)' WHEN 'bulk' THEN 'bulk/list mail (newsletter or automated alert) -> weekly digest' WHEN 'important' THEN 'Gmail marked important' ELSE 'primary/personal mail' END AS reason FROM events WHERE event_id % 50 <> 0")
def triage_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return mail.triage(syncing.prepared(_messages(spark, sf), NOW)).select("event_id", "klass", "reason")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'error')")
def labelled_mail(spark: SparkSession, sf: str) -> DataFrame:
    return syncing.with_label(_messages(spark, sf), "INBOX").select("event_id")


def _calendar(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    text = lambda c: c.cast("string")
    when = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), F.lit(None).cast("string").alias("date"))
    start = F.when(F.col("event_id") % 11 != 0, when)
    title = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("CS 101: "), "event_type")).otherwise(F.col("event_type"))
    status = F.when(F.col("event_type") == "error", "cancelled").otherwise("confirmed")
    return e.select("event_id", text(F.col("event_id")).alias("id"), title.alias("summary"), start.alias("start"), start.alias("end"), F.lit("room").alias("location"), text(F.col("value")).alias("description"), F.lit("").alias("htmlLink"), status.alias("status"))


@query("""WITH c AS (SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 11 <> 0) SELECT 'count' AS what, count(*) + count(*) FILTER (event_id % 7 = 0) AS n FROM events UNION ALL SELECT 'repeated', count(*) FILTER (event_id % 7 = 0) FROM events UNION ALL SELECT 'skipped', (SELECT count(*) FROM events) - (SELECT count(*) FROM c)
UNION ALL SELECT 'created', count(*) FROM c WHERE event_id % 5 <> 0 UNION ALL SELECT 'updated', count(*) FROM c WHERE event_id % 10 = 0 UNION ALL SELECT 'unchanged', count(*) FROM c WHERE event_id % 10 = 5""")
def sync_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """All events, after a fifth of them were synced before, half of those under another title; some are delivered twice."""
    rows = _calendar(spark, sf)
    rows = rows.unionByName(rows.where("event_id % 7 = 0"))
    old = rows.where("event_id % 5 = 0").withColumn("summary", F.when(F.col("event_id") % 10 == 0, "before").otherwise(F.col("summary")))
    before = kept(syncing.sync_events(_no_notes(spark), old)[0], "notes")
    return syncing.sync_events(before, rows)[1]


@query("SELECT 'events' AS source, 'e9' AS cursor, TIMESTAMP '2024-02-01' AS last_sync, 5::INT AS items UNION ALL SELECT 'mail', 'm1', TIMESTAMP '2024-02-01', 0 UNION ALL SELECT 'old', 'o1', TIMESTAMP '2024-01-01', 3")
def sync_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """Of two sources that ran one had no new cursor; a third did not run."""
    at = "2024-01-01 00:00:00"
    old = spark.sql(f"SELECT * FROM VALUES ('mail', 'm1', TIMESTAMP '{at}', 7), ('old', 'o1', TIMESTAMP '{at}', 3) AS t(source, cursor, last_sync, items)")
    ran = spark.sql("SELECT * FROM VALUES ('events', 'e9', 5), ('mail', NULL, 0) AS t(source, cursor, items)")
    return syncing.advance(old, ran, NOW)


@query("""WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id || event_type END AS ref, event_id % 13 = 0 AS bad, 's/' || lpad(event_id::VARCHAR, 9, '0') AS path FROM events),
g AS (SELECT * FROM s WHERE NOT bad AND ref IS NOT NULL), f AS (SELECT ref, arg_min(event_id, path) AS e FROM g GROUP BY ref), o AS (SELECT ref, arg_min(event_id, path) AS e FROM g WHERE event_id % 3 = 0 GROUP BY ref)
SELECT 'error' AS status, count(*) FILTER (WHERE bad) AS n FROM s UNION ALL SELECT 'skipped', count(*) FILTER (WHERE NOT bad AND ref IS NULL) FROM s UNION ALL SELECT 'repeated', (SELECT count(*) FROM g) - (SELECT count(*) FROM f)
UNION ALL SELECT 'created', count(*) FILTER (WHERE o.ref IS NULL) FROM f LEFT JOIN o USING (ref) UNION ALL SELECT 'unchanged', count(*) FILTER (WHERE o.e = f.e) FROM f JOIN o USING (ref) UNION ALL SELECT 'updated', count(*) FILTER (WHERE o.e <> f.e) FROM f JOIN o USING (ref)""")
def staging_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A staging area imported after a third of it was."""
    e = _t(spark, sf, "events")
    ref = F.when(F.col("event_type") != "error", F.concat(F.col("user_id").cast("string"), "event_type"))
    key = F.col("event_id").cast("string")
    null = lambda t: F.lit(None).cast(t)
    staged = e.select(
        "event_id", F.concat(F.lit("s/"), F.lpad(key, 9, "0")).alias("path"), ref.alias("source_ref"), F.concat(F.lit("Note "), key).alias("title"), F.lit("body").alias("body"), F.when(F.col("event_id") % 13 == 0, "malformed").alias("error"),
        null("int").alias("importance"), null("timestamp").alias("expires"),
    )
    before = kept(syncing.stage(_no_notes(spark), staged.where("event_id % 3 = 0"))[0], "notes")
    return syncing.staging_counts(syncing.stage(before, staged)[1])


@query("SELECT event_id FROM events WHERE date_diff('second', ts, TIMESTAMP '2024-02-01') <= 864000 - 1 OR event_id % 10 = 0")
def fresh_state(spark: SparkSession, sf: str) -> DataFrame:
    """State of the last ten days, and what has no time."""
    rows = _t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("at"))
    return jobs.fresh(rows, NOW, 10).select("event_id")


# ---- Capture


@query(f"""WITH {_HASHED}, f AS (SELECT min(doc_id) AS id, sha256(trim(coalesce(text, ''))) AS hash FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL),
s AS (SELECT x.id AS new_id, y.id, sum(x.w * y.w) AS score FROM h x JOIN h y USING (bucket) WHERE x.id % 2 = 1 AND y.id % 2 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(score, 12) DESC, id) AS k FROM s),
b AS (SELECT new_id, id FROM r WHERE k = 1 AND score >= 0.97)
SELECT doc_id AS id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN f.id IS NOT NULL THEN 'duplicate' WHEN b.id IS NOT NULL THEN 'append' WHEN doc_id <> fst THEN 'duplicate' ELSE 'create' END AS decision,
CASE WHEN coalesce(f.id, b.id) IS NOT NULL THEN coalesce(f.id, b.id)::VARCHAR WHEN trim(coalesce(text, '')) <> '' AND doc_id <> fst THEN fst::VARCHAR END AS target
FROM (SELECT *, min(doc_id) OVER (PARTITION BY sha256(trim(coalesce(text, '')))) AS fst FROM documents WHERE doc_id % 2 = 1) d LEFT JOIN f ON f.hash = sha256(trim(coalesce(d.text, ''))) LEFT JOIN b ON b.new_id = doc_id""")
def capture_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the documents captured into a vault of the other half: exact copies refused, near ones appended to the nearest."""
    d = _t(spark, sf, "documents")
    v = kept(similarity.bucket_counts(d), "counts")
    near = capturing.best_similar(v.where("id % 2 = 1"), v.where("id % 2 = 0"), 0.97)
    docs = d.where("doc_id % 2 = 0").groupBy(tx.body_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id")).join(d.select("doc_id", "text"), "doc_id")
    docs = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), F.lit("x").alias("path"))
    new = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("lang").alias("category"), F.col("text").alias("body"))
    return capturing.capture(new, docs, near.withColumn("id", F.col("id").cast("string")), NOW, "append")[0]


@query("""WITH n AS (SELECT CASE WHEN lang = 'de' THEN '00-inbox' ELSE lang END AS category, 'note-' || doc_id % 40 AS slug FROM documents WHERE doc_id % 2 = 1), t AS (SELECT DISTINCT '00-inbox' AS category, 'note-' || doc_id % 40 AS slug FROM documents WHERE doc_id % 3 = 0)
SELECT category || '/' || slug AS stem, count(*) AS n, CASE WHEN any_value(t.slug) IS NULL THEN 1 ELSE 0 END::BIGINT AS plain, count(*) AS paths FROM n LEFT JOIN t USING (category, slug) GROUP BY n.category, n.slug""")
def capture_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with few titles: the first of a free path gets it, all others the end of their id."""
    d = _t(spark, sf, "documents")
    title = F.concat(F.lit(" Note "), F.pmod("doc_id", F.lit(40)).cast("string"))
    new = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("id"), title.alias("title"), F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("category"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("body"))
    docs = d.where("doc_id % 3 = 0").select(F.lit("d").alias("id"), F.lit("other").alias("body"), F.concat(F.lit("00-inbox/note-"), F.pmod("doc_id", F.lit(40)).cast("string"), F.lit(".md")).alias("path"))
    none = spark.createDataFrame([], "new_id long, id string, score double")
    notes = capturing.capture(new, docs, none, NOW)[1]
    stem = F.regexp_replace("path", r"^(.*/note-\d+)(-[0-9a-z]{6}|-[0-9a-z]{26})?\.md$", "$1")
    return notes.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.count_if(F.col("path").rlike(r"/note-\d+\.md$")).alias("plain"), F.count_distinct("path").alias("paths"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'empty title' ELSE 'create' END AS decision FROM documents""")
def quick_notes(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit("T "), F.col("doc_id").cast("string"))).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("body"))
    docs = spark.createDataFrame([], "id string, body string, path string")
    return capturing.quick_notes(d, docs, NOW)[0].select("id", "decision")


# ---- Catalog


def _files(rows: DataFrame, folder: Column, hash_of: Column, mtime: Column) -> DataFrame:
    path = F.concat(folder, F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    return rows.select(path.alias("path"), F.md5(hash_of).alias("content_hash"), F.lit(10).cast("long").alias("size_bytes"), mtime.cast("double").alias("mtime"), F.lit(3).alias("pages"), F.lit(None).cast("string").alias("meta_title"), F.lit(None).cast("string").alias("first_line"))


def _no_catalog(spark: SparkSession) -> DataFrame:
    from ..schema import CATALOG

    return spark.createDataFrame([], CATALOG)


@query("""WITH a AS (SELECT p_partkey AS k, p_brand || '/f' || p_partkey || '.pdf' AS path, md5(p_partkey::VARCHAR) AS h FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE p_brand END || '/f' || p_partkey || '.pdf' AS path, md5(p_partkey::VARCHAR || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END) AS h FROM part WHERE p_partkey % 4 <> 0),
i AS (SELECT *, row_number() OVER (ORDER BY path) AS id FROM a), nw AS (SELECT b.* FROM b LEFT JOIN i p ON p.path = b.path LEFT JOIN i q ON q.h = b.h WHERE p.path IS NULL AND q.h IS NULL)
SELECT i.id, coalesce(m.path, i.path) AS current_path, coalesce(s.h, i.h) AS content_hash, s.path IS NULL AND m.path IS NULL AS missing FROM i LEFT JOIN b s ON s.path = i.path LEFT JOIN b m ON m.h = i.h AND m.path <> i.path
UNION ALL SELECT (SELECT max(id) FROM i) + row_number() OVER (ORDER BY path), path, h, false FROM nw""")
def catalog_state(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog after two scans, between which files came, went, moved and changed."""
    p, key = _t(spark, sf, "part"), F.col("p_partkey")
    first, _, _ = filing.scanned(_no_catalog(spark), _files(p.where("p_partkey % 3 <> 0"), F.col("p_brand"), key.cast("string"), F.lit(1)), NOW)
    changed = F.concat(key.cast("string"), F.when(key % 5 == 0, "x").otherwise(""))
    later = _files(p.where("p_partkey % 4 <> 0"), F.when(key % 7 == 0, "moved").otherwise(F.col("p_brand")), changed, F.when(key % 5 == 0, 2).otherwise(1))
    return filing.scanned(first, later, NOW)[0].select("id", "current_path", "content_hash", "missing")


@query("""WITH a AS (SELECT p_brand || '/f' || p_partkey || '.pdf' AS path, md5((p_partkey % 50)::VARCHAR) AS h FROM part), f AS (SELECT h, min(path) AS first FROM a GROUP BY h) SELECT path, first AS current_path, 10::BIGINT AS size_bytes FROM a JOIN f USING (h) WHERE path <> first""")
def catalog_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate paths of a first scan, with the documents they copy."""
    p = _t(spark, sf, "part")
    after, copies, _ = filing.scanned(_no_catalog(spark), _files(p, F.col("p_brand"), F.pmod("p_partkey", F.lit(50)).cast("string"), F.lit(1)), NOW)
    known = copies.limit(0)
    return filing.named_duplicates(filing.merged_duplicates(known, copies), after).select("path", "current_path", "size_bytes")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 10 AS r, row_number() OVER (ORDER BY lpad(p_partkey::VARCHAR, 9, '0')) AS id FROM part), h AS (SELECT *, 'd/' || lpad(k::VARCHAR, 9, '0') AS path FROM p)
SELECT id, CASE WHEN r = 6 THEN 'm/' || lpad(k::VARCHAR, 9, '0') ELSE path END AS current_path, md5(CASE r WHEN 1 THEN (k + 1)::VARCHAR WHEN 2 THEN (k - 1)::VARCHAR WHEN 4 THEN (k - 1)::VARCHAR WHEN 5 THEN 'x' || k ELSE k::VARCHAR END) AS content_hash, r IN (3, 9) AS missing FROM h WHERE r <> 7
UNION ALL SELECT (SELECT max(id) FROM p) + row_number() OVER (ORDER BY k), 'n/' || lpad(k::VARCHAR, 9, '0'), md5(k::VARCHAR), false FROM p WHERE r = 5""")
def catalog_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog after files swapped contents, were overwritten by a move, changed while their old content turned up elsewhere, moved, became copies or went."""
    p = _t(spark, sf, "part").select("p_partkey")
    k, r = F.col("p_partkey"), F.pmod("p_partkey", F.lit(10))
    at = lambda rows, folder, content, mtime: _files(rows, F.lit("d"), content.cast("string"), F.lit(mtime)).withColumn("path", F.concat(F.lit(folder), F.lpad(F.regexp_extract("path", r"(\d+)", 1), 9, "0")))
    first, _, _ = filing.scanned(_no_catalog(spark), at(p, "d/", k, 1), NOW)
    content = F.when(r == 1, k + 1).when((r == 2) | (r == 4), k - 1).when(r == 7, k + 1).otherwise(k).cast("string")
    changed = F.when(r == 5, F.concat(F.lit("x"), k.cast("string"))).otherwise(content)
    later = at(p.where(~r.isin(3, 6, 9)), "d/", changed, 2).unionByName(at(p.where(r == 6), "m/", k, 2)).unionByName(at(p.where(r == 5), "n/", k, 2))
    return filing.scanned(first, later, NOW)[0].select("id", "current_path", "content_hash", "missing")


# ---- Knowledge


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"), "source", F.lit("").alias("heading_path"), F.lit(None).cast("int").alias("page"), "text")


_NEAR = f"""q AS (SELECT CAST('0x' || right(md5(t), 2) AS INT) AS bucket, count(*) AS n FROM (SELECT unnest({_TOK.format(c=f"'{ASK}'")}) AS t) GROUP BY ALL),
v AS (SELECT id, sum(w * n) / (SELECT sqrt(sum(n * n)) FROM q) AS score FROM h JOIN q USING (bucket) GROUP BY id)"""


@query(f"WITH {_HASHED}, {_NEAR}, r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM v) SELECT rank, lpad(id::VARCHAR, 12, '0') AS chunk_id, round(score, 4) AS score FROM r WHERE rank <= 8")
def knowledge_search(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.search(_notes(spark, sf), ASK).select(F.col("rank").cast("long").alias("rank"), "citation.chunk_id", "score")


@query("SELECT DISTINCT source FROM documents")
def knowledge_sources(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.sources(_notes(spark, sf))


_ABOUT = f"""hw AS (SELECT chunk_id AS id, unnest({_TOK.format(c="text")}) AS t FROM ch), hn AS (SELECT id, CAST('0x' || right(md5(t), 2) AS INT) AS bucket, count(*) AS n FROM hw GROUP BY ALL),
h AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM hn), {_NEAR},
seed AS (SELECT * FROM (SELECT id AS chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM v) WHERE rank <= 3)"""


@query(f"""WITH {_CH}, {_NODES}, {_CONT}, {_MENT}, {_ABOUT},
g AS (SELECT chunk_id, 'vector match' AS why, rank AS seed, 0 AS level FROM seed UNION ALL
SELECT c.dst, 'related concept', rank, 1 FROM seed JOIN ment ON ment.src = chunk_id JOIN cont c ON c.src = ment.dst UNION ALL
SELECT c.dst, 'same section', rank, 2 FROM seed JOIN cont p ON p.dst = chunk_id JOIN cont c ON c.src = p.src),
b AS (SELECT chunk_id, min((seed, level, why)) AS b FROM g WHERE chunk_id IN (SELECT id FROM nodes WHERE kind = 'chunk') GROUP BY chunk_id),
i AS (SELECT chunk_id, b[3] AS why, row_number() OVER (ORDER BY b[1], b[2], chunk_id) AS rank FROM b) SELECT rank, chunk_id, why FROM i WHERE rank <= 12""")
def synthesize(spark: SparkSession, sf: str) -> DataFrame:
    """Around the three chunks nearest to a question; the three and the twelve results are the feature's own limits."""
    rows = _chunked(spark, sf).withColumn("page", F.lit(None).cast("int"))
    out = knowledge.synthesize(ASK, rows, relations.graph_contains(rows), relations.graph_mentions(rows), relations.graph_nodes(rows), k=3)
    return out.select(F.col("rank").cast("long").alias("rank"), "chunk_id", "why")


@query("""WITH n AS (SELECT count(*) FILTER (WHERE doc_id % 3 = 0 OR doc_id % 2 = 0) AS fresh, count(*) AS n FROM documents) SELECT 'converted' AS what, fresh AS n FROM n UNION ALL SELECT 'indexed', fresh FROM n UNION ALL SELECT 'skipped', n - fresh FROM n
UNION ALL SELECT 'removed', 1 UNION ALL SELECT 'error', 1""")
def ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A second ingest: a third of the files is new, half of the others changed, one is of a kind that cannot be read, and a corpus text is gone."""
    store = knowledge.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    d = _t(spark, sf, "documents")
    raw = d.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    old = raw.where("doc_id % 3 <> 0").withColumn("content", F.when(F.col("doc_id") % 2 == 0, F.encode(F.concat(F.decode("content", "UTF-8"), F.lit("!")), "UTF-8")).otherwise(F.col("content"))).drop("doc_id")
    other = spark.sql("SELECT 'gone.md' AS path, CAST('# gone' AS BINARY) AS content")
    knowledge.ingest(store, old.unionByName(other), rebuild_graph=False)
    knowledge.remove_source(store, "gone.md")
    odd = spark.sql("SELECT 'table.xls' AS path, CAST('x' AS BINARY) AS content")
    return knowledge.ingest(store, raw.drop("doc_id").unionByName(odd), rebuild_graph=False).groupBy("what").agg(F.count("*").alias("n"))
