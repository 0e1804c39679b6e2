"""One vault: tables made of its notes, and what can be asked of them and done to them.

State follows from the notes' files, the log of tombstones and the access signals, so a rebuild and an incremental
index give the same tables.  Every change is a new version of a table; what only plans is returned, not written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import frontmatter
from .functions import text as tx
from .functions.identity import journal_path
from .functions.time import moment, parse_iso
from .operators import capturing, chunking, lifecycle, mail, nearjoin, relations, search, similarity, state
from .session import kept
from .sources import files
from .sources.notes import save as write_notes
from .sources.tables import Tables

NOTES = (
    "id string, path string, title string, category string, source string, source_ref string, content_hash string, body_hash string, frontmatter string, tags array<string>, "
    "created timestamp, updated timestamp, status string, importance int, pinned boolean, expires timestamp, body string, error string"
)
CHUNKS = "chunk_id string, document_id string, ordinal int, heading_path string, headings array<string>, page int, text string, token_count int, body_hash string"
BACKUPS = "at timestamp, name string, version string"
CELLS = "id string, bucket int, w double"
SCHEMAS = {
    "notes": NOTES, "chunks": CHUNKS, "cells": CELLS, "links": schema.LINKS, "events": schema.EVENTS, "duplicates": schema.DUPLICATES,
    "tombstones": schema.TOMBSTONES, "signals": schema.SIGNALS, "cursors": schema.CURSORS,
}


def columns(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def note_rows(scanned: DataFrame, now: str) -> DataFrame:
    """Rows of NOTES from files (path, text, hash).

    What the metadata leaves out has a default: an id from the path, the first heading or the file's name as title, the top
    folder as category.  A malformed note has an error and no other fields but path and hash.
    """
    rows = scanned.select("path", F.col("hash").alias("content_hash"), frontmatter.parsed(F.col("text")).alias("p")).select("path", "content_hash", "p.*")
    field = lambda name: F.get_json_object("frontmatter", f"$.{name}")
    good = lambda c: F.when(F.col("error").isNull(), c)
    when = lambda name: F.coalesce(parse_iso(field(name)), moment(now))
    body = F.col("body")
    made: dict[str, Column] = {
        "id": F.coalesce(field("id"), F.upper(F.left(F.sha2("path", 256), F.lit(26)))),
        "title": F.coalesce(F.nullif(field("title"), F.lit("")), tx.fallback_title(body, F.col("path"))),
        "category": F.coalesce(F.nullif(field("category"), F.lit("")), F.split("path", "/")[0]),
        "source": F.col("path"),
        "source_ref": field("source_ref"),
        "body_hash": tx.body_hash(body),
        "tags": F.from_json(field("tags"), "array<string>"),
        "created": when("created"),
        "updated": when("updated"),
        "status": F.coalesce(field("status"), F.lit("active")),
        "importance": F.coalesce(field("importance").try_cast("int"), F.lit(2)),
        "pinned": F.coalesce(field("pinned").try_cast("boolean"), F.lit(False)),
        "expires": parse_iso(field("expires")),
    }
    return rows.withColumns({name: good(c) for name, c in made.items()}).select(*columns(NOTES))


class Vault:
    """``notes`` is the folder of the files, ``root`` that of the tables; ``now`` is the moment that all methods take as the present."""

    def __init__(self, spark: SparkSession, notes: str, root: str, now: str, weights: lifecycle.Weights | None = None):
        self.spark, self.folder, self.now = spark, notes, now
        self.tables, self.weights = Tables(spark, root), weights or lifecycle.Weights()

    def table(self, name: str) -> DataFrame:
        return self.tables.read(name, SCHEMAS[name])

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        self.tables.write(name, df.select(*columns(SCHEMAS[name])))
        return self.table(name)

    # ---- Index

    def index(self, incremental: bool = True) -> DataFrame:
        """Brings the tables up to the files; (key, change) says what each note was.  Only new and changed files are parsed and chunked."""
        scanned = files.notes(self.spark, self.folder)
        old = self.table("notes")
        before = old if incremental else old.limit(0)
        seen = before.select("path", F.col("content_hash").alias("hash"))
        stay = before.join(scanned.select("path", F.col("hash").alias("content_hash")), ["path", "content_hash"], "left_semi")
        notes = self._put("notes", stay.unionByName(note_rows(scanned.join(seen, ["path", "hash"], "left_anti"), self.now)))
        docs = self.documents(scores=False)
        had = self.table("chunks") if incremental else self.table("chunks").limit(0)
        same = had.join(docs.select(F.col("id").alias("document_id"), "body_hash"), ["document_id", "body_hash"], "left_semi")
        fresh = docs.join(had.select(F.col("document_id").alias("id"), "body_hash").distinct(), ["id", "body_hash"], "left_anti")
        cut = chunking.chunk(fresh, "id", "body").withColumnRenamed("source", "document_id").join(fresh.select(F.col("id").alias("document_id"), "body_hash"), "document_id")
        cut = kept(cut.select(*columns(CHUNKS)), "cut")  # the chunker runs once
        self._put("chunks", same.unionByName(cut))
        cells = self.table("cells").join(same.select(F.col("chunk_id").alias("id")), "id", "left_semi")
        self._put("cells", cells.unionByName(similarity.hash_embedding(cut, "chunk_id")))
        self._put("duplicates", relations.exact_duplicates(notes.where("error IS NULL")))
        self._put("links", relations.resolve_links(relations.extract_links(docs), docs))
        start, end = (F.get_json_object("frontmatter", f"$.{x}") for x in ("start", "end"))
        events = docs.where(start.isNotNull()).select("id", F.col("id").alias("document_id"), "title", start.alias("start_at"), parse_iso(start).alias("start_ts"), end.alias("end_at"), parse_iso(end).alias("end_ts"), "source")
        self._put("events", events)
        return state.manifest_diff(old.select(F.col("path").alias("key"), F.col("content_hash").alias("hash")), notes.select(F.col("path").alias("key"), F.col("content_hash").alias("hash")))

    def rebuild(self) -> DataFrame:
        return self.index(incremental=False)

    def documents(self, scores: bool = True) -> DataFrame:
        """The first note of each body, archived where a tombstone says so, with signals and scores."""
        notes = self.table("notes").where("error IS NULL")
        first = notes.groupBy("body_hash").agg(F.min("path").alias("path"))
        gone = self.table("tombstones").where("action = 'archive'").select("document_id").distinct()
        docs = lifecycle.archive(notes.join(first, ["body_hash", "path"]), gone)
        if not scores:
            return docs
        return lifecycle.scored(docs, self.table("signals"), relations.incoming_counts(self.table("links").where("dst_document IS NOT NULL")), self.now, self.weights)

    # ---- Reading

    def search(self, query: str, k: int = search.HITS, category: str | None = None, source: str | None = None, status: str | None = None, mode: str = "hybrid", detail: str = "compact", max_chars: int = search.BUDGET) -> DataFrame:
        """Ranked hits with citations.  Nothing is counted as read: ``record`` does that with what was found."""
        if not query.strip():
            raise ValueError("the query is empty")
        docs = search.scope(self.documents(scores=False), category, source, status)
        chunks = self.table("chunks").drop("body_hash").join(docs.select(F.col("id").alias("document_id"), "path", "title", "source", "status"), "document_id")
        asked = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("text"))
        return search.search(chunks, asked, k, mode, detail, max_chars, self.table("cells"))

    def record(self, hits: DataFrame) -> DataFrame:
        return self._put("signals", lifecycle.record_access(self.table("signals"), search.access_log(hits, moment(self.now))))

    def get_note(self, ref: str, max_chars: int = 25_000) -> DataFrame:
        return search.get_note(self.documents(), ref, max_chars)

    def timeline(self, start: str | None = None, end: str | None = None, limit: int = 50) -> DataFrame:
        bound = lambda x: None if x is None else parse_iso(F.lit(x))
        return search.timeline(self.table("events"), bound(start), bound(end), limit)

    def status(self) -> DataFrame:
        """(category, n) of the documents."""
        return self.documents(scores=False).groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("(uncategorized)")).alias("category")).agg(F.count("*").alias("n"))

    def counts(self) -> DataFrame:
        return state.counts({name: self.table(name) for name in SCHEMAS})

    def inbox(self) -> DataFrame:
        return files.inbox(self.documents(scores=False)).select("id", "title", "path", "created", tx.first_line(F.col("body")).alias("summary"))

    def related(self, note_id: str) -> DataFrame:
        return relations.related(self.table("links"), self.documents(scores=False)).where(F.col("id") == note_id)

    def duplicates(self) -> DataFrame:
        return relations.named_duplicates(self.table("duplicates"), self.documents(scores=False))

    def near_duplicates(self, threshold: float = 0.9) -> DataFrame:
        """(a, b, similarity) of documents whose mean chunk embeddings are that near."""
        of = self.table("chunks").select(F.col("chunk_id").alias("id"), "document_id")
        mean = self.table("cells").join(of, "id").groupBy(F.col("document_id").alias("id"), "bucket").agg(F.sum("w").alias("w"))
        return nearjoin.near_pairs(similarity.dense(mean).select("id", "v"), threshold)

    def relations_map(self) -> DataFrame:
        return relations.relations_map(self.table("links"), self.documents(scores=False))

    def versions(self) -> dict[str, list[str]]:
        """All versions of every table; each is a backup that can be read."""
        return {name: self.tables.versions(name) for name in SCHEMAS}

    def sync_status(self) -> DataFrame:
        return self.table("cursors").orderBy("source")

    # ---- Retention

    def explain_prune(self, note_id: str) -> DataFrame:
        rows = self.documents().where(F.col("id") == note_id)
        return rows.select("id", *[F.round(c, 4).alias(c.removeprefix("part_")) for c in rows.columns if c.startswith("part_")], F.round("prune_score", 4).alias("total"))

    def scores(self) -> DataFrame:
        return self.documents().select("id", "prune_score")

    def _archive(self, plan: DataFrame, dry_run: bool) -> DataFrame:
        if dry_run:
            return plan
        had = self.table("tombstones")
        return self._put("tombstones", had.unionByName(plan.join(had.select("id"), "id", "left_anti").select(had.columns)))

    def prune_expired(self, dry_run: bool = True) -> DataFrame:
        return self._archive(lifecycle.archive_plan(lifecycle.expired(self.documents(scores=False), self.now), "expired", self.now, f"ttl-{self.now[:10]}"), dry_run)

    def prune_decayed(self, dry_run: bool = True) -> DataFrame:
        faded = lifecycle.decayed(self.documents(), self.weights.decay_score_threshold, self.weights.decay_min_idle_days)
        return self._archive(lifecycle.archive_plan(faded, "decayed", self.now, f"decay-{self.now[:10]}"), dry_run)

    def maintenance(self, apply: bool = False) -> DataFrame:
        """Indexes, then plans or does what has expired or decayed."""
        self.index()
        return self._archive(lifecycle.maintenance(self.documents(scores=False), self.documents(), self.now, self.weights), not apply)

    def restore(self, note_id: str | None = None, batch: str | None = None) -> DataFrame:
        if (note_id is None) == (batch is None):
            raise ValueError("either note_id or batch")
        _, left = lifecycle.restore(self.documents(scores=False), self.table("tombstones"), batch, note_id)
        return self._put("tombstones", left)

    def tombstones(self) -> DataFrame:
        return self.table("tombstones").orderBy("at", "id")

    # ---- Writing: what is to be written comes back as (path, text)

    def capture(self, new: DataFrame, similar: DataFrame | None = None, on_similar: str = "warn", force_new: bool = False) -> DataFrame:
        """(id, decision, target) for texts (id, body); similar documents are looked for where none are given."""
        similar = self.similar(new) if similar is None else similar
        return state.capture_plan(new, self.documents(scores=False).select("id", "body"), similar, on_similar, force_new)

    def similar(self, new: DataFrame, threshold: float = 0.9) -> DataFrame:
        """(new_id, id, score): for each text (id, body) the document whose mean chunk embedding is nearest, where that reaches ``threshold``."""
        of = self.table("chunks").select(F.col("chunk_id").alias("id"), "document_id")
        mean = self.table("cells").join(of, "id").groupBy("document_id", "bucket").agg(F.sum("w").alias("w"))
        length = mean.groupBy("document_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
        asked = similarity.hash_embedding(new, "id", "body").select(F.col("id").alias("new_id"), "bucket", F.col("w").alias("qw"))
        score = mean.join(asked, "bucket").groupBy("new_id", "document_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot")).join(length, "document_id")
        best = score.groupBy("new_id").agg(F.min(F.struct((-F.round(F.col("dot") / F.col("len"), 12)).alias("s"), F.col("document_id").alias("id"))).alias("b"))
        return best.select("new_id", "b.id", (-F.col("b.s")).alias("score")).where(F.col("score") >= threshold)

    def save(self, notes: DataFrame) -> None:
        """Writes notes (path, frontmatter, body) into the folder, all or none, and indexes them."""
        write_notes(notes, self.folder, self.now)
        self.index()

    def tick(self, apply: bool = False) -> DataFrame:
        """One round of upkeep: notes the tables' versions as a backup, indexes, plans or does what has expired or decayed, and writes a line
        for it into the day's journal page; the tombstones of what is or would be archived.  The versions are in the table ``backups``."""
        before = [(self.now, name, v[-1]) for name, v in self.versions().items() if v]
        had = self.tables.read("backups", BACKUPS)
        self.tables.write("backups", had.unionByName(self.spark.createDataFrame(before, "at string, name string, version string").select(F.col("at").cast("timestamp").alias("at"), "name", "version")))
        self.index()
        plan = kept(lifecycle.maintenance(self.documents(scores=False), self.documents(), self.now, self.weights), "tick")
        self._archive(plan, not apply)
        said = plan.agg(F.count("*").alias("n")).select(moment(self.now).alias("at"), F.concat(F.lit("tick: "), F.col("n").cast("string"), F.lit(" archived" if apply else " to archive")).alias("text"))
        notes = self.table("notes").where("error IS NULL")
        pages = capturing.journal(notes.select("path", "title", "body"), said).join(said.select(journal_path(F.col("at")).alias("path")), "path", "left_semi")
        pages = pages.join(notes.select("path", "frontmatter"), "path", "left").select("path", F.coalesce("frontmatter", F.to_json(F.struct("title"))).alias("frontmatter"), "body")
        self.save(kept(pages, "pages"))
        return plan

    def append(self, entries: DataFrame) -> DataFrame:
        """Notes to write, (path, text), after entries (id, at, text) for notes that are there."""
        docs = self.documents(scores=False).join(entries.select("id").distinct(), "id", "left_semi")
        bodies = state.append_texts(docs.select("id", "body"), entries.join(docs.select("id"), "id", "left_semi"))
        return docs.drop("body").join(bodies, "id").select("path", frontmatter.dumped(F.col("frontmatter"), F.col("body")).alias("text"))

    def preview_mail(self, messages: DataFrame) -> DataFrame:
        return mail.plan(mail.triage(messages))

    def import_staging(self, folder: str, area: str | None = None) -> DataFrame:
        """(path, status) of the notes staged in a folder."""
        return state.import_staging(note_rows(files.staged(self.spark, folder, area), self.now).where("error IS NULL"))
