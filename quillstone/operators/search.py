"""Hybrid search: two rankings, reciprocal-rank fusion, and an answer that fits a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..session import kept
from . import lexical, postings, similarity

RRF_K = 60
MODES = ("hybrid", "vector", "lexical")
#: Characters that an answer may have, and hits it has, if nothing else is asked for.
BUDGET, HITS = 6000, 8
#: Most hits that are sent to the tasks, to be joined to their texts there.
SENT = 100_000


def pool(k: int) -> int:
    """How many rows each ranking brings to the fusion."""
    return max(4 * k, 20)


def scope(docs: DataFrame, category: str | None = None, source: str | None = None, status: str | None = None) -> DataFrame:
    """Rows of a category or below it, a source and a status; None does not filter."""
    if category is not None:
        below = F.lower(F.lit(category.rstrip("/") + "/"))
        docs = docs.where((F.col("category") == category) | F.startswith(F.lower("category"), below))
    if source is not None:
        docs = docs.where(F.col("source") == source)
    return docs if status is None else docs.where(F.col("status") == status)


def fuse(rankings: list[DataFrame], archived: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) from lists (query_id, id, rank from 1); ids of ``archived`` come after all others."""
    union = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select("query_id", "id", "rank"))
    total = union.groupBy("query_id", "id").agg(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("score"))
    last: Column = F.lit(0)
    if archived is not None:
        total = total.join(archived.select("id", F.lit(1).alias("_late")).distinct(), "id", "left")
        last = F.coalesce("_late", F.lit(0))
    order = Window.partitionBy("query_id").orderBy(last, F.desc(F.round("score", 12)), "id")
    return total.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", "rank")


def within_budget(hits: DataFrame, max_chars: int, full: bool = False, text_col: str = "text") -> DataFrame:
    """Hits in rank order while snippet (and text, if ``full``) and 160 characters each fit; the first always does."""
    cut = snippet(F.col(text_col))
    size = F.length(cut) + F.lit(160) + (F.length(text_col) if full else F.lit(0))
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = hits.withColumn("snippet", cut).withColumn("used", F.sum(size).over(running))
    return sized.where((F.col("used") <= max_chars) | (F.col("rank") == 1))


def search(chunks: DataFrame, queries: DataFrame, k: int = HITS, mode: str = "hybrid", detail: str = "compact", max_chars: int = BUDGET, cells: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, score, snippet, [text,] used, has_more, citation) for a table of queries (query_id, text).

    ``chunks`` has chunk_id and text, and what a citation names, with status; filter it first (``scope``).  Either ranking brings
    ``pool(k)`` rows; ``cells``, the chunks' embeddings in long form, saves making them anew.  An unknown mode is hybrid, an
    unknown detail compact.  A query without tokens finds nothing, nor does the vector side find chunks that share no
    bucket with it.  Without ``cells`` both sides send the queries to the texts, block by block, and each task keeps its best; with
    them the vector side makes a row of each bucket that a chunk and a query share.  ``has_more`` says that the budget left hits out.
    """
    if k < 1:
        raise ValueError(f"k must be 1 or more, not {k}")
    mode = mode if mode in MODES else "hybrid"
    n, rankings = pool(k), []
    late = F.col("status") == "archived"
    if mode != "lexical" and cells is None:
        rankings.append(similarity.hash_top(chunks, queries, n, "chunk_id", late=late))
    elif mode != "lexical":
        asked = similarity.hash_embedding(queries, "query_id").select(F.col("id").alias("query_id"), "bucket", F.col("w").alias("qw"))
        cells = cells.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")
        near = cells.join(asked, "bucket").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
        near = near.join(chunks.select(F.col("chunk_id").alias("id"), late.alias("late")), "id")
        rankings.append(near.withColumn("score", F.col("score") - F.when(F.col("late"), F.lit(2.0)).otherwise(F.lit(0.0))))
    if mode != "vector":
        rankings.append(lexical.bm25_top(chunks, queries, n))
    best = [lexical.ranked(r, n) for r in rankings]
    hits = kept(fuse(best, chunks.where(late).select(F.col("chunk_id").alias("id"))).where(F.col("rank") <= k), "hits")
    few = hits.count() <= SENT
    hits = chunks.withColumn("citation", citation()).select(F.col("chunk_id").alias("id"), "text", "citation").join(F.broadcast(hits) if few else hits, "id")
    hits = kept(hits, "texts")
    full = detail == "full"
    found = hits.groupBy("query_id").agg(F.count("*").alias("_all"))
    within = within_budget(hits, max_chars, full)
    more = within.groupBy("query_id").agg(F.count("*").alias("_kept")).join(found, "query_id").select("query_id", (F.col("_kept") < F.col("_all")).alias("has_more"))
    return within.join(more, "query_id").select("query_id", "rank", F.round("score", 6).alias("score"), "snippet", *(["text"] if full else []), "used", "has_more", "citation")


def stored(words: postings.Lexical, cells: postings.Cells, text: str, k: int = HITS, mode: str = "hybrid", archived: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank) of one question over stored postings and cells: what does not hold its terms or buckets is not read.

    The result of ``search`` over all that was indexed; statistics are those of the index.
    """
    mode = mode if mode in MODES else "hybrid"
    sides = ([cells] if mode != "lexical" else []) + ([words] if mode != "vector" else [])
    best = [side.ask(text, pool(k)).withColumn("query_id", F.lit(0).cast("long")) for side in sides]
    return fuse(best, archived).where(F.col("rank") <= k)


def access_log(hits: DataFrame, at: Column) -> DataFrame:
    """(document_id, at, call) of the documents that a search brought up, each once a query."""
    return hits.select(F.col("citation.document_id").alias("document_id"), at.alias("at"), F.col("query_id").cast("string").alias("call")).distinct()


def citation() -> Column:
    return F.struct("document_id", "chunk_id", "path", "title", "heading_path", "page", "source")


def get_note(docs: DataFrame, ref: str, max_chars: int = 25_000) -> DataFrame:
    """The row that ``ref`` means, by id before source_ref before path, its body cut to ``max_chars``."""
    level = F.when(F.col("id") == ref, 0).when(F.col("source_ref") == ref, 1).when(F.col("path") == ref, 2)
    hit = docs.withColumn("_level", level).where("_level IS NOT NULL").orderBy("_level", "path").limit(1).drop("_level")
    return hit.withColumn("truncated", F.length("body") > max_chars).withColumn("body", F.left("body", F.lit(max_chars)))


def timeline(events: DataFrame, start: Column | None = None, end: Column | None = None, limit: int = 50) -> DataFrame:
    """Events by start within inclusive bounds; rows whose start cannot be read are left out."""
    rows = events.where("start_ts IS NOT NULL")
    rows = rows if start is None else rows.where(F.col("start_ts") >= start)
    rows = rows if end is None else rows.where(F.col("start_ts") <= end)
    return rows.orderBy("start_ts", "id").limit(max(1, limit))


def get_section(lines_of: DataFrame, heading: str) -> DataFrame:
    """Per source the lines from the first heading that reads ``heading`` to the next of its level or above, as text.

    ``lines_of`` has source and text.  Fences are not looked at: a ``# line`` in code counts as a heading.
    """
    pattern = r"^(#{1,6})\s+(.*\S)\s*$"
    rows = lines_of.select("source", F.split("text", "\n").alias("lines"))
    at = F.transform(F.col("lines"), lambda x: F.length(F.regexp_extract(x, pattern, 1)))
    names = F.transform(F.col("lines"), lambda x: F.lower(F.trim(F.regexp_extract(x, pattern, 2))))
    target = heading.split(">")[-1].strip().lower()
    rows = rows.withColumn("level", at).withColumn("start", F.array_position(names, target).cast("int")).where("start > 0")
    rows = rows.withColumn("own", F.element_at("level", F.col("start")))
    after = F.slice("level", F.col("start") + 1, F.size("level"))
    stop = F.array_position(F.transform(after, lambda v: (v > 0) & (v <= F.col("own"))), True).cast("int")
    size = F.when(stop > 0, stop).otherwise(F.size("lines") - F.col("start") + 1)
    return rows.select("source", F.regexp_replace(F.array_join(F.slice("lines", F.col("start"), size), "\n"), r"(?U)^\s+|\s+$", "").alias("text"))
