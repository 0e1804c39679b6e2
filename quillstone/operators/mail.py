"""Mail and calendar: triage, digests, and notes made of messages and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_snippet, or_empty
from ..functions.time import digest_key, digest_title, week_key

# Labels by what they mean, and for each class its action, importance and days to live (None: for good).
EXCLUDED = ("CHAT", "DRAFT", "SENT", "SPAM", "TRASH")
LIST_TABS = ("CATEGORY_UPDATES", "CATEGORY_FORUMS")
POLICY = {
    "excluded": ("skip", 0, None),
    "starred": ("keep", 4, None),
    "promotion": ("skip", 0, None),
    "social": ("skip", 0, None),
    "bulk": ("digest", 1, 30.0),
    "important": ("keep", 3, 180.0),
    "personal": ("keep", 3, 90.0),
}
#: Why a message is of a class.
REASONS = {
    "excluded": "not inbox mail",
    "starred": "starred by you (keeper, never auto-archives)",
    "promotion": "Gmail Promotions (marketing)",
    "social": "Gmail Social (social-network notification)",
    "bulk": "bulk/list mail (newsletter or automated alert) -> weekly digest",
    "important": "Gmail marked important",
    "personal": "primary/personal mail",
}
KEEPERS = 50


def header(headers: Column, name: str) -> Column:
    """The first header of a name, whatever its case; empty if there is none."""
    return or_empty(F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"])


def classify(labels: Column, listed: Column) -> Column:
    """The class of a message by labels and by whether it has a list header; the first rule that fits holds."""
    has = lambda *x: F.arrays_overlap(labels, F.array(*map(F.lit, x)))
    rules = (
        ("excluded", has(*EXCLUDED)),
        ("starred", has("STARRED")),
        ("promotion", has("CATEGORY_PROMOTIONS")),
        ("social", has("CATEGORY_SOCIAL")),
        ("bulk", listed | has(*LIST_TABS)),
        ("important", has("IMPORTANT")),
    )
    return F.coalesce(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(kind)) for kind, rule in rules], F.lit("personal"))


def _by_class(kind: Column, at: int, to: str) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v[at]).cast(to)) for k, v in POLICY.items()])


def triage(messages: DataFrame) -> DataFrame:
    """Adds klass, action, importance, ttl_days and reason to messages (id, labels, listed, ...); those without an id go."""
    why = F.coalesce(*[F.when(F.col("klass") == k, F.lit(v)) for k, v in REASONS.items()])
    which = F.array_join(F.sort_array(F.array_intersect("labels", F.array(*map(F.lit, EXCLUDED)))), ", ")
    reason = F.when(F.col("klass") == "excluded", F.concat(why, F.lit(" ("), which, F.lit(")"))).otherwise(why)
    out = messages.where(F.coalesce("id", F.lit("")) != "").withColumn("klass", classify(F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("listed", F.lit(False))))
    return out.withColumns({"action": _by_class(F.col("klass"), 0, "string"), "importance": _by_class(F.col("klass"), 1, "int"), "ttl_days": _by_class(F.col("klass"), 2, "double"), "reason": reason})


def plan(triaged: DataFrame) -> DataFrame:
    """(what, name, n): counts by class, by action, and of digests by week."""
    one = lambda rows, what, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "name", "n")
    weeks = one(triaged.where("action = 'digest'"), "week", week_key(F.col("ts")))
    return one(triaged, "class", F.col("klass")).unionByName(one(triaged, "action", F.col("action"))).unionByName(weeks)


def keepers(triaged: DataFrame, cap: int = KEEPERS) -> DataFrame:
    """The first ``cap`` messages to keep, by arrival; the preview's own limit."""
    return triaged.where("action = 'keep'").orderBy("ts", "id").limit(cap)


def digest_line(ts: Column, sender: Column, subject: Column, ident: Column) -> Column:
    name = lambda c, other: F.coalesce(F.nullif(clean_snippet(c), F.lit("")), F.lit(other))
    return F.concat(F.lit("- "), F.date_format(ts, "yyyy-MM-dd"), F.lit(" · "), name(sender, "(unknown sender)"), F.lit(" · "), name(subject, "(no subject)"), F.lit(" <!-- id:"), ident, F.lit(" -->"))


def digest_items(triaged: DataFrame) -> DataFrame:
    """(source_ref, title, message_id, line) of the messages that go into weekly digests."""
    rows = triaged.where("action = 'digest'")
    return rows.select(digest_key(F.col("ts")).alias("source_ref"), digest_title(F.col("ts")).alias("title"), F.col("id").alias("message_id"), digest_line(F.col("ts"), F.col("sender"), F.col("subject"), F.col("id")).alias("line"))


def merge_digests(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items of both, the new line where both have a message."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    return both.groupBy("source_ref", "message_id").agg(F.max_by("title", "_at").alias("title"), F.max_by("line", "_at").alias("line"))


def render_digests(items: DataFrame) -> DataFrame:
    """(source_ref, title, n, body): the weekly notes, newest lines first."""
    rows = items.groupBy("source_ref").agg(F.max("title").alias("title"), F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("line"), asc=False), "\n").alias("lines"))
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" message(s) rolled up from bulk/list mail.\n\n"), F.col("lines"), F.lit("\n\n<!-- source_ref: "), F.col("source_ref"), F.lit(" -->\n"))
    return rows.select("source_ref", "title", "n", body.alias("body"))


def parse_digest(body: Column) -> Column:
    """Array of (message_id, line) in a digest's body."""
    lines = F.filter(F.split(or_empty(body), "\n"), lambda x: F.ltrim(x).startswith("-") & x.rlike(r"<!--\s*id:\S+?\s*-->"))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"<!--\s*id:(\S+?)\s*-->", 1).alias("message_id"), F.rtrim(x).alias("line")))


def _lines(*parts: Column) -> Column:
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), "\n"), F.lit("\n"))


def message_notes(messages: DataFrame) -> DataFrame:
    """Raw messages (id, labelIds, snippet, payload.headers) to note fields and body."""
    heads = F.col("payload.headers")
    subject = F.coalesce(F.nullif(F.trim(header(heads, "Subject")), F.lit("")), F.lit("(no subject)"))
    rows = messages.select("id", subject.alias("title"), F.trim(header(heads, "From")).alias("sender"), F.trim(header(heads, "Date")).alias("date"), F.col("labelIds").alias("labels"), clean_snippet(F.col("snippet")).alias("content"), F.concat(F.lit("gmail://msg/"), F.col("id")).alias("source_ref"))
    part = lambda c, text: F.when(c != "", text)
    tags = F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ", ")
    body = _lines(
        F.concat(F.lit("# "), F.col("title")), F.lit(""), part(F.col("sender"), F.concat(F.lit("- **From:** "), F.col("sender"))), part(F.col("date"), F.concat(F.lit("- **Date:** "), F.col("date"))),
        part(tags, F.concat(F.lit("- **Labels:** "), tags)), F.lit(""), part(F.col("content"), F.concat(F.col("content"), F.lit("\n"))), F.concat(F.lit("<!-- source_ref: "), F.col("source_ref"), F.lit(" -->")),
    )
    return rows.withColumn("body", body)


def group_of(summary: Column) -> Column:
    """The capitals before a colon that an event's title begins with, or null."""
    return F.nullif(F.trim(F.regexp_extract(or_empty(summary), r"^\s*([A-Z][A-Z0-9 &/]{1,23}):\s*\S", 1)), F.lit(""))


def event_notes(events: DataFrame) -> DataFrame:
    """Raw calendar events to note fields and body; those without id or start and cancelled ones go."""
    when = lambda c: F.coalesce(F.col(f"{c}.dateTime"), F.col(f"{c}.date"))
    text = lambda c: F.trim(or_empty(F.col(c)))
    title = F.coalesce(F.nullif(text("summary"), F.lit("")), F.lit("(untitled event)"))
    rows = events.select("id", title.alias("title"), when("start").alias("start"), when("end").alias("end"), text("location").alias("location"), text("description").alias("description"), or_empty(F.col("htmlLink")).alias("link"), "status", group_of(F.col("summary")).alias("group"), F.concat(F.lit("gcal://event/"), F.col("id")).alias("source_ref"))
    rows = rows.where((F.coalesce("id", F.lit("")) != "") & F.col("start").isNotNull() & (F.coalesce("status", F.lit("")) != "cancelled"))
    part = lambda c, shown: F.when(F.col(c) != "", shown)
    span = F.concat(F.lit("- **When:** "), F.col("start"), F.coalesce(F.concat(F.lit(" → "), F.col("end")), F.lit("")))
    body = _lines(
        F.concat(F.lit("# "), F.col("title")), F.lit(""), span, part("location", F.concat(F.lit("- **Where:** "), F.col("location"))), F.lit(""), part("description", F.concat(F.col("description"), F.lit("\n"))),
        part("link", F.concat(F.lit("[Open in Google Calendar]("), F.col("link"), F.lit(")\n"))), F.concat(F.lit("<!-- source_ref: "), F.col("source_ref"), F.lit(" -->")),
    )
    return rows.withColumn("body", body)


def unique_paths(notes: DataFrame, folder: str) -> DataFrame:
    """Paths by slug in a folder; of notes with one slug the later get the end of their id."""
    again = F.row_number().over(Window.partitionBy("slug").orderBy("id")) > 1
    name = F.when(again, F.concat("slug", F.lit("-"), F.lower(F.right("id", F.lit(6))))).otherwise(F.col("slug"))
    return notes.withColumn("path", F.concat(F.lit(folder + "/"), name, F.lit(".md")))
