"""Whole syncs: pages of mail and calendar into notes by source, with digests, cursors and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..functions.time import expires, message_time, moment
from ..session import kept
from . import mail, state

#: Columns of the notes that syncs keep, one row a ``source_ref``.
NOTES = "source_ref string, title string, body string, importance int, expires timestamp, tags array<string>, start string, end string"
_COLUMNS = [c.split()[0] for c in NOTES.split(", ")]


def with_label(messages: DataFrame, label: str | None) -> DataFrame:
    """Messages that bear a label; all without one."""
    return messages if not label else messages.where(F.array_contains(F.coalesce("labelIds", F.array().cast("array<string>")), label))


def first_window(now: str, back: int = 30, ahead: int = 365) -> tuple[Column, Column]:
    """From when to when a first sync of a calendar looks, as ISO text in UTC."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return iso(F.date_sub(moment(now), back) + (moment(now) - F.date_trunc("day", moment(now)))), iso(F.date_add(moment(now), ahead) + (moment(now) - F.date_trunc("day", moment(now))))


def mail_query(query: Column, cursor: Column) -> Column:
    """What a mailbox is asked for: the query, and what came after the cursor, seconds since 1970; null if neither is there."""
    after = F.when(or_empty(cursor) != "", F.concat(F.lit("after:"), cursor))
    return F.nullif(F.concat_ws(" ", F.nullif(F.trim(or_empty(query)), F.lit("")), after), F.lit(""))


def accumulate(pages: DataFrame, key: str) -> DataFrame:
    """Totals of all whole-number columns of page summaries, by ``key``, and how many pages there were."""
    whole = [f.name for f in pages.schema if f.name != key and f.dataType.typeName() in ("integer", "long", "short", "byte")]
    return pages.groupBy(key).agg(*(F.sum(c).alias(c) for c in whole), F.count("*").alias("pages"))


def advance(cursors: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """Cursors (source, cursor, last_sync, items) after runs (source, cursor, items): a run without a new cursor keeps the old."""
    both = cursors.select("source", F.col("cursor").alias("_old"), F.col("last_sync").alias("_at"), F.col("items").alias("_n")).join(runs.select("source", F.col("cursor").alias("_new"), F.col("items").alias("_m"), F.lit(True).alias("_ran")), "source", "full")
    ran = F.coalesce("_ran", F.lit(False))
    return both.select("source", F.coalesce("_new", "_old").alias("cursor"), F.when(ran, moment(now)).otherwise(F.col("_at")).alias("last_sync"), F.when(ran, F.col("_m")).otherwise(F.col("_n")).cast("int").alias("items"))


def upsert(notes: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes after an upsert by ``source_ref``, and (source_ref, action) of what came in, one row a ``source_ref``.  Notes that only differ in when they expire are unchanged."""
    incoming = kept(state.newest(incoming.select(_COLUMNS), "source_ref"), "incoming")
    actions = state.merge(notes, incoming, "source_ref", [c for c in _COLUMNS if c not in ("source_ref", "expires")]).where("action <> 'kept'")
    moved = incoming.join(actions.where("action <> 'unchanged'").select("source_ref"), "source_ref", "left_semi")
    return state.apply_merge(notes, moved.select(_COLUMNS), "source_ref"), actions


def repeats(items: DataFrame, key: str = "id") -> DataFrame:
    """One row: how many of ``items`` repeat another's key."""
    return items.where(F.col(key).isNotNull()).agg((F.count("*") - F.count_distinct(key)).alias("repeated"))


def prepared(messages: DataFrame, now: str) -> DataFrame:
    """Raw messages (id, labelIds, snippet, internalDate, payload.headers) with what triage and digests read."""
    heads = F.col("payload.headers")
    listed = (mail.header(heads, "List-Unsubscribe") != "") | (mail.header(heads, "List-Id") != "")
    made = {
        "labels": F.col("labelIds"), "listed": listed, "sender": F.trim(mail.header(heads, "From")), "subject": F.trim(mail.header(heads, "Subject")),
        "ts": message_time(F.col("internalDate"), mail.header(heads, "Date"), now),
    }
    return messages.withColumns(made)


def _empty(tags: Column, **given: Column) -> list[Column]:
    null = {"start": F.lit(None).cast("string"), "end": F.lit(None).cast("string"), "importance": F.lit(None).cast("int"), "expires": F.lit(None).cast("timestamp")}
    return [((null | {"tags": tags} | given).get(c, F.col(c))).alias(c) for c in _COLUMNS]


def sync_messages(notes: DataFrame, messages: DataFrame, now: str, label: str | None = None, digest: bool = True, ttl_days: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Notes after a batch of raw messages, and its summary (what, n).

    Kept messages are a note each, bulk mail goes into its week's digest, added to what the digest has; a digest that gains nothing
    stays as it is.  The summary counts all messages, what was skipped, kept, digested and repeated, what became of notes, and classes.

    Deliveries may repeat: of messages of one id the newest by internal date counts, the others are ``repeated`` and looked at no further.
    """
    once = state.newest(with_label(messages, label), "id", F.col("internalDate").try_cast("long"))
    rows = kept(mail.triage(prepared(once, now)), "triaged")  # read by each branch below
    if not digest:
        rows = rows.withColumn("action", F.when(F.col("action") == "digest", "skip").otherwise(F.col("action")))
    life = lambda days: expires(now, F.lit(ttl_days).cast("double") if ttl_days is not None else days)
    keep = rows.where("action = 'keep'")
    policy = keep.select("id", F.col("importance").alias("_importance"), "klass", life(F.col("ttl_days")).alias("_expires"))
    single = mail.message_notes(keep.drop("importance")).join(policy, "id")
    single = single.select(*_empty(F.array(F.lit("mail"), F.col("klass")), importance=F.col("_importance"), expires=F.col("_expires")))
    new = mail.digest_items(rows)
    touched = notes.join(new.select("source_ref").distinct(), "source_ref", "left_semi")
    old = touched.select("source_ref", "title", F.explode(mail.parse_digest(F.col("body"))).alias("i")).select("source_ref", "title", F.col("i.message_id").alias("message_id"), F.col("i.line").alias("line"))
    weekly = mail.render_digests(mail.merge_digests(old, new)).select(*_empty(F.array(F.lit("mail"), F.lit("digest")), importance=F.lit(1), expires=life(F.lit(mail.POLICY["bulk"][2]))))
    after, actions = upsert(notes, single.unionByName(weekly))
    seen = messages.agg(F.count("*").alias("count")).join(repeats(with_label(messages, label)), F.lit(True))
    done = rows.agg(F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "digest").alias("digested"))
    totals = seen.join(done, F.lit(True)).select(F.explode(F.create_map(F.lit("count"), "count", F.lit("kept"), "kept", F.lit("digested"), "digested", F.lit("repeated"), "repeated", F.lit("skipped"), F.col("count") - F.col("repeated") - F.col("kept") - F.col("digested"))).alias("what", "n"))
    classes = rows.groupBy(F.concat(F.lit("class:"), F.col("klass")).alias("what")).agg(F.count("*").alias("n"))
    return after, totals.unionByName(actions.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n"))).unionByName(classes)


def sync_events(notes: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after a batch of raw calendar events, and its summary (what, n); events without id or start and cancelled ones are skipped, repeats of an id counted and left out."""
    once = state.newest(events, "id", *([F.col("updated")] if "updated" in events.columns else []))
    made = mail.event_notes(once)
    tags = F.when(F.col("group").isNotNull(), F.array(F.lit("calendar"), F.lower("group"))).otherwise(F.array(F.lit("calendar")))
    incoming = made.select(*_empty(tags, start=F.col("start"), end=F.col("end")))
    after, actions = upsert(notes, incoming)
    skipped = events.agg(F.count("*").alias("count")).join(made.agg(F.count("*").alias("made")), F.lit(True)).join(repeats(events), F.lit(True))
    totals = skipped.select(F.explode(F.create_map(F.lit("count"), "count", F.lit("repeated"), "repeated", F.lit("skipped"), F.col("count") - F.col("repeated") - F.col("made"))).alias("what", "n"))
    return after, totals.unionByName(actions.groupBy(F.col("action").alias("what")).agg(F.count("*").alias("n")))


def stage(notes: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after staged files (path, source_ref, title, body, error) are imported, and (path, status).

    A malformed file is an error, one without a ``source_ref`` is skipped; of several with one the first by path counts, the others are repeated.
    """
    sound = staged.where("error IS NULL")
    status = state.import_staging(sound)
    first = sound.join(status.where("status = 'imported'").select("path"), "path", "left_semi").select(*_empty(F.array().cast("array<string>")))
    after, actions = upsert(notes, first)
    named = sound.select("path", "source_ref").join(actions, "source_ref", "left")
    found = status.join(named.select("path", "action"), "path").select("path", F.when(F.col("status") == "imported", F.col("action")).otherwise(F.col("status")).alias("status"))
    return after, found.unionByName(staged.where("error IS NOT NULL").select("path", F.lit("error").alias("status")))


def staging_counts(statuses: DataFrame) -> DataFrame:
    """(status, n) for each status that a staging report names, 0 where no file has it."""
    every = statuses.sparkSession.createDataFrame([(s,) for s in ("created", "updated", "unchanged", "skipped", "repeated", "error")], "status string")
    return every.join(statuses.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


