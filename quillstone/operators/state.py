"""State transitions as joins of snapshots: merges, incremental index, capture and append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import body_hash, or_empty, strip


def newest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the last by ``order``, ties by a hash of the whole row, so that repeats of a delivery count once.  Rows without a key all stay.

    A struct of the row is reduced map-side, so a key of many rows is no hot group.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns])
    last = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), F.xxhash64(F.to_json(whole)).alias("_h"))).alias("_row"))
    return last.select("_row.*").unionByName(rows.where(F.col(key).isNull()))


def merge(state: DataFrame, incoming: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, action) of an upsert: created, updated or unchanged; and kept for rows that no new one meets.  Both have one row a key (see ``newest``)."""
    new = incoming.select(F.col(key), F.struct(*[F.col(c) for c in compare]).alias("_new"))
    old = state.select(F.col(key), F.struct(*[F.col(c) for c in compare]).alias("_old"))
    both = old.join(new, key, "full")
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    return both.select(key, action.alias("action"))


def apply_merge(state: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The state after an upsert."""
    return state.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def replace_by(state: DataFrame, new: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """Child rows after those of ``changed`` parents are replaced."""
    return state.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_document(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Documents, chunks, links and events without those of ``ids``; links from others to them stay."""
    keys = {"documents": "id", "chunks": "document_id", "links": "src_document", "events": "document_id"}
    return {name: df.join(ids.select(F.col("id").alias(keys[name])), keys[name], "left_anti") if name in keys else df for name, df in tables.items()}


def manifest_diff(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """(key, change) between a manifest (key, hash) and what is there: new, changed, same or removed."""
    both = manifest.select("key", F.col("hash").alias("old")).join(present.select("key", "hash"), "key", "full")
    change = F.when(F.col("hash").isNull(), "removed").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("hash"), "same").otherwise("changed")
    return both.select("key", change.alias("change"))


def index(notes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Documents (id, path, body, body_hash) of which the first path with a body stays.

    With the last ``state``, rows whose path and body hash it has are taken from it and only others come from ``notes``;
    which path is first is always decided over all notes, so an incremental run equals a rebuild.
    """
    rows = notes.select("id", "path", "body", body_hash(F.col("body")).alias("body_hash"))
    if state is not None:
        same = state.select("path", "body_hash")
        kept = state.join(rows.select("path", "body_hash"), ["path", "body_hash"], "left_semi")
        rows = rows.join(same, ["path", "body_hash"], "left_anti").unionByName(kept.select(rows.columns))
    first = rows.groupBy("body_hash").agg(F.min("path").alias("path"))
    return rows.join(first, ["body_hash", "path"]).select("id", "path", "body", "body_hash")


def capture_plan(new: DataFrame, docs: DataFrame, similar: DataFrame, on_similar: str = "warn", force_new: bool = False) -> DataFrame:
    """(id, decision, target) for texts (id, body) to be captured.

    Texts that some document (id, body) has are refused; ones with a similar document (new_id, id, score) are created with
    a warning, skipped or appended to it, as ``on_similar`` says; others are created.  Of equal texts that would be created the one with the
    smallest id is, and the others are refused as its duplicates, as if they had come one after the other.
    """
    if on_similar not in ("warn", "skip", "append"):
        raise ValueError("on_similar is warn, skip or append")
    had = docs.groupBy(body_hash(F.col("body")).alias("hash")).agg(F.min("id").alias("same"))
    rows = new.withColumn("hash", body_hash(F.col("body"))).join(had, "hash", "left")
    best = similar.groupBy(F.col("new_id").alias("id")).agg(F.max_by(F.col("id"), F.struct("score", F.col("id"))).alias("near"))
    rows = rows.join(best, "id", "left") if not force_new else rows.withColumn("near", F.lit(None).cast("string"))
    empty = strip(or_empty(F.col("body"))) == ""
    decision = F.when(empty, "empty").when(F.col("same").isNotNull(), "duplicate").when(F.col("near").isNotNull(), {"warn": "create_similar", "skip": "skip", "append": "append"}[on_similar]).otherwise("create")
    rows = rows.withColumn("decision", decision)
    made = F.startswith("decision", F.lit("create"))
    first = rows.where(made).groupBy("hash").agg(F.min("id").alias("_first"))
    rows = rows.join(first, "hash", "left")
    again = made & (F.col("id") != F.col("_first"))
    target = F.when(again, F.col("_first").cast("string")).otherwise(F.coalesce("same", "near"))
    return rows.select("id", F.when(again, "duplicate").otherwise(F.col("decision")).alias("decision"), target.alias("target"))


def append_texts(bodies: DataFrame, entries: DataFrame) -> DataFrame:
    """Bodies (id, body) with entries (id, at, text) after them, in order of time."""
    more = entries.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda e: e["text"]), "\n").alias("more"))
    return bodies.join(more, "id", "full").select("id", F.concat_ws("\n\n", F.nullif(F.rtrim(or_empty(F.col("body"))), F.lit("")), "more").alias("body"))


def import_staging(staged: DataFrame) -> DataFrame:
    """(path, status): files without a source_ref are skipped, of several with one the first by path is imported."""
    first = staged.groupBy("source_ref").agg(F.min("path").alias("_first"))
    rows = staged.join(first, "source_ref", "left")
    none = F.coalesce("source_ref", F.lit("")) == ""
    return rows.select("path", F.when(none, "skipped").when(F.col("path") == F.col("_first"), "imported").otherwise("repeated").alias("status"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
