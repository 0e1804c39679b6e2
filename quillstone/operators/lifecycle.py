"""Retention: scores, time to live, decay, archiving and restoring, all as plans that can be looked at first."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import archive_path
from ..functions.time import days_since, moment


@dataclass(frozen=True)
class Weights:
    """What each part of the score counts, and when a document has decayed."""

    # The defaults of a configuration file, by its keys.
    w_recency: float = 2.0
    w_usage: float = 1.0
    w_importance: float = 1.0
    w_links: float = 0.5
    w_pin: float = 1000.0
    w_age: float = 1.0
    half_life_days: float = 30.0
    staleness_days: float = 30.0
    decay_score_threshold: float = 0.0
    decay_min_idle_days: float = 90.0
    prune_apply: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Weights:
        """From lines ``key: number``; comments and unknown keys are passed over, a bad number is an error."""
        known, found = {f.name for f in fields(cls)}, {}
        for line in text.splitlines():
            key, colon, value = line.partition("#")[0].partition(":")
            if colon and key.strip() in known:
                found[key.strip()] = float(value)
        return replace(cls(), **found)

    def dump(self) -> str:
        return "".join(f"{f.name}: {getattr(self, f.name)}\n" for f in fields(self))


def parts(w: Weights, now: str) -> dict[str, Column]:
    """The six terms; rows have updated, last_access, access_count, importance, incoming and pinned."""
    days = days_since(now, F.col("updated"), F.col("last_access"))
    half = max(w.half_life_days, 1e-9)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return {
        "recency": F.lit(w.w_recency) * F.pow(F.lit(0.5), days / half),
        "usage": F.lit(w.w_usage) * F.log1p(zero("access_count")),
        "importance": F.lit(w.w_importance) * zero("importance"),
        "links": F.lit(w.w_links) * zero("incoming"),
        "pinned": F.when(F.coalesce(F.col("pinned").cast("boolean"), F.lit(False)), F.lit(w.w_pin)).otherwise(F.lit(0.0)),
        "staleness": F.lit(0.0) - F.lit(w.w_age) * days / max(w.staleness_days, 1e-9),
    }


def scored(docs: DataFrame, signals: DataFrame, incoming: DataFrame, now: str, w: Weights | None = None) -> DataFrame:
    """Documents with their signals, incoming links, the terms as ``part_*`` and their sum, prune_score."""
    terms = parts(w or Weights(), now)
    base = docs.drop("last_access", "access_count", "prune_score").join(signals.withColumnRenamed("document_id", "id"), "id", "left")
    base = base.join(incoming.withColumnRenamed("dst_document", "id"), "id", "left")
    base = base.withColumns({f"part_{k}": v for k, v in terms.items()} | {"idle_days": days_since(now, F.col("updated"), F.col("last_access"))})
    return base.withColumn("prune_score", sum((F.col(f"part_{k}") for k in terms), F.lit(0.0)))


def expired(docs: DataFrame, now: str) -> DataFrame:
    return docs.where((F.col("status") == "active") & ~F.coalesce("pinned", F.lit(False)) & (F.col("expires") <= moment(now)))


def decayed(scores: DataFrame, threshold: float, idle: float) -> DataFrame:
    return scores.where((F.col("status") == "active") & ~F.coalesce("pinned", F.lit(False)) & (F.col("prune_score") <= threshold) & (F.col("idle_days") >= idle))


def record_access(signals: DataFrame, access: DataFrame) -> DataFrame:
    """Adds to the counts a log (document_id, at, call): an id counts once a call."""
    once = access.groupBy("document_id", "call").agg(F.max("at").alias("at"))
    new = once.groupBy("document_id").agg(F.count("*").alias("more"), F.max("at").alias("at"))
    both = signals.join(new, "document_id", "full")
    return both.select("document_id", F.greatest("last_access", "at").alias("last_access"), (F.coalesce("access_count", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("int").alias("access_count"))


def archive_plan(docs: DataFrame, reason: str, now: str, batch: str) -> DataFrame:
    """Tombstones for documents about to be archived."""
    return docs.select(
        F.concat(F.lit(batch), F.lit("/"), F.col("id")).alias("id"),
        F.col("id").alias("document_id"),
        F.lit("archive").alias("action"),
        F.lit(reason).alias("reason"),
        F.col("path").alias("prev_path"),
        F.to_json(F.struct(archive_path(F.col("path")).alias("path"), F.lit("archived").alias("status"))).alias("payload"),
        moment(now).alias("at"),
        F.lit(batch).alias("batch"),
    )


def archive(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents after the plan: planned ones archived and moved."""
    marked = docs.join(plan.select(F.col("document_id").alias("id"), F.lit(True).alias("_go")), "id", "left")
    return marked.withColumn("path", F.when(F.col("_go"), archive_path(F.col("path"))).otherwise(F.col("path"))).withColumn("status", F.when(F.col("_go"), F.lit("archived")).otherwise(F.col("status"))).drop("_go").select(docs.columns)


def restore(docs: DataFrame, tombstones: DataFrame, batch: str | None = None, document_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and tombstones after a batch, or one document, is put back where it was."""
    hit = F.lit(True) if batch is None else F.col("batch") == batch
    hit = hit if document_id is None else hit & (F.col("document_id") == document_id)
    back = tombstones.where(hit).groupBy(F.col("document_id").alias("id")).agg(F.max_by("prev_path", "at").alias("_back"))
    both = docs.join(back, "id", "left")
    put = both.withColumn("status", F.when(F.col("_back").isNotNull(), F.lit("active")).otherwise(F.col("status"))).withColumn("path", F.coalesce("_back", "path"))
    return put.select(docs.columns), tombstones.where(~F.coalesce(hit, F.lit(False)))


def tombstones_map(tombstones: DataFrame) -> DataFrame:
    """One Markdown line for each tombstone, oldest first."""
    return tombstones.orderBy("at", "id").select(F.format_string("- %s `%s` %s (%s)", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), "prev_path", "action", "reason").alias("line"))


def maintenance(docs: DataFrame, scores: DataFrame, now: str, w: Weights | None = None) -> DataFrame:
    """What a maintenance tick would archive and why; a document that has expired is not counted as decayed too."""
    w = w or Weights()
    old = expired(docs, now)
    faded = decayed(scores, w.decay_score_threshold, w.decay_min_idle_days).join(old.select("id"), "id", "left_anti")
    return archive_plan(old, "expired", now, f"ttl-{now[:10]}").unionByName(archive_plan(faded, "decayed", now, f"decay-{now[:10]}"))
