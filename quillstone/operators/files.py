"""The file catalog: names, classes, change detection, queries and rename plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, stem, strip

# What is dropped from names, and the words that tell a file's class, first match first.
JUNK = (r"_?oceanofpdf\.com_?", r"drive-download[-0-9tz]*", r"_?shortdoi_?\w*")
CLASSES = (
    ("solutions", r"solution"),
    ("exam", r"\b(midterm|final|exam|test|quiz)\b"),
    ("formula-sheet", r"formula"),
    ("manual", r"\b(manual|guide|programmers?)\b"),
    ("assignment", r"\b(homework|assignment|worksheet|workbook|lab|hw)\b"),
)
SLIDES = (r"^\s*\d+[.\-_]?\d*\s+\S", r"\b(lecture|slides?|chapter|ch)\b")
BOOK_PAGES, BOOK_BYTES = 150, 5_000_000
UNFILED = "_UNFILED"


def clean(name: Column) -> Column:
    """A file's stem as a label."""
    out = name
    for junk in JUNK:
        out = F.regexp_replace(out, f"(?i){junk}", " ")
    out = F.trim(F.regexp_replace(F.translate(out, "_-", "  "), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(out, F.lit("")), name)


def is_descriptive(s: Column) -> Column:
    words = F.filter(F.split(s, r"(?U)\s+"), lambda x: x.rlike(r"\p{L}"))
    letters, solid = F.regexp_count(s, F.lit(r"\p{L}")), F.regexp_count(s, F.lit(r"(?U)\S"))
    return (F.length(s) >= 8) & (F.size(words) >= 2) & (solid > 0) & (letters >= 0.5 * solid)


def good_title(t: Column) -> Column:
    s = strip(or_empty(t))
    low = F.lower(s)
    return F.length(s).between(4, 140) & ~low.isin("untitled", "title") & ~low.startswith("microsoft word") & s.rlike(r"\p{L}")


def first_text_line(text: Column) -> Column:
    lines = F.transform(F.split(or_empty(text), "\r?\n"), strip)
    fit = F.filter(lines, lambda x: F.length(x).between(4, 140) & (F.size(F.split(x, r"(?U)\s+")) >= 2) & x.rlike(r"\p{L}"))
    return F.try_element_at(fit, F.lit(1))


def needs_ocr(chars: Column, pages: Column) -> Column:
    return chars < F.greatest(F.lit(100), F.lit(20) * pages)


def doc_type(name: Column, size: Column, pages: Column) -> Column:
    """One of eight classes, by words of the name, then pages and size."""
    apart = F.regexp_replace(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", " "), r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    low = F.lower(apart)
    (first, pattern), *more = CLASSES
    found = F.when(low.rlike(pattern), first)
    for kind, pattern in more:
        found = found.when(low.rlike(pattern), kind)
    found = found.when((pages >= BOOK_PAGES) & (size > BOOK_BYTES), "textbook")
    return found.when(name.rlike(SLIDES[0]) | low.rlike(SLIDES[1]), "slides").otherwise("notes")


def course_subpath(path: Column) -> tuple[Column, Column]:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise(F.lit(UNFILED)), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "/")


def describe(files: DataFrame) -> DataFrame:
    """Adds title, course, subpath, doc_type and descriptive_name to files (path, size_bytes, pages, meta_title, first_line)."""
    label = clean(stem(F.col("path")))
    meta, first = F.when(good_title(F.col("meta_title")), strip(F.col("meta_title"))), F.col("first_line")
    base = F.when(is_descriptive(label), label).otherwise(F.coalesce(meta, F.when(good_title(first), first), label))
    course, subpath = course_subpath(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    title = F.coalesce(meta, first)
    kind = doc_type(F.concat(name, F.lit(" "), or_empty(title)), F.col("size_bytes"), F.col("pages"))
    return files.withColumns({"title": title, "course": course, "subpath": subpath, "doc_type": kind}).withColumn("descriptive_name", F.concat("course", F.lit(" — "), base, F.lit(" ["), F.col("doc_type"), F.lit("]")))


def base_name(course: Column, kind: Column, descriptive: Column) -> Column:
    """The title's part of a descriptive name."""
    head, tail = F.concat(course, F.lit(" — ")), F.concat(F.lit(" ["), kind, F.lit("]"))
    cut = F.when(F.startswith(descriptive, head), F.substring(descriptive, F.length(head) + 1, F.length(descriptive))).otherwise(descriptive)
    return F.when(F.endswith(cut, tail), F.left(cut, F.length(cut) - F.length(tail))).otherwise(cut)


def safe_filename(course: Column, base: Column, kind: Column, extension: Column) -> Column:
    slug = F.left(F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), F.lit(80))
    return F.concat(course, F.lit("_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled")), F.lit("_"), kind, extension)


def rename_plan(catalog: DataFrame) -> DataFrame:
    """(id, old_path, new_path) where a file's name is not its safe one; of files that would share a name the later get their id."""
    name = safe_filename(F.col("course"), base_name(F.col("course"), F.col("doc_type"), F.col("descriptive_name")), F.col("doc_type"), F.col("extension"))
    folder = F.regexp_replace("current_path", "[^/]*$", "")
    rows = catalog.where("NOT missing").select("id", F.col("current_path").alias("old_path"), F.concat(folder, name).alias("new_path"), "extension")
    again = F.row_number().over(Window.partitionBy("new_path").orderBy("id")) > 1
    suffixed = F.concat(F.regexp_replace("new_path", r"\.[^./]*$", ""), F.lit("-"), F.col("id").cast("string"), F.col("extension"))
    return rows.withColumn("new_path", F.when(again, suffixed).otherwise(F.col("new_path"))).where("old_path <> new_path").drop("extension")


def scan(state: DataFrame, snapshot: DataFrame, rehash: bool = False) -> DataFrame:
    """(path, action) of every file seen or known.

    ``state`` has path, content_hash, size_bytes, mtime, missing; ``snapshot`` path, content_hash, size_bytes, mtime.  A known file
    whose size and time are as they were is skipped, its content taken as known; one of the same content is refreshed.  Content that such a file
    has is a duplicate anywhere else.  Other content belongs to one path, the others with it are duplicates: to the first known file that
    changed to it, which is updated, whatever else had it before; else to the first new path, which is moved if a file with that content is gone
    and new if none is.  What is known, not seen, not moved and not missing already is missing.
    """
    known = state.select("path", F.col("content_hash").alias("old_hash"), F.col("size_bytes").alias("old_size"), F.col("mtime").alias("old_mtime"), "missing")
    same = (F.col("old_size") == F.col("size_bytes")) & (F.abs(F.col("old_mtime") - F.col("mtime")) < 1e-6) & ~F.col("missing") & F.lit(not rehash)
    rows = snapshot.join(known, "path", "left").withColumn("skipped", F.col("old_hash").isNotNull() & F.coalesce(same, F.lit(False)))
    rows = rows.select("path", "old_hash", "skipped", F.when(F.col("skipped"), F.col("old_hash")).otherwise(F.col("content_hash")).alias("hash"))
    stays, fresh = F.col("old_hash") == F.col("hash"), F.col("old_hash").isNull()
    owners = rows.groupBy("hash").agg(F.coalesce(F.max(stays), F.lit(False)).alias("stays"), F.min(F.when(~fresh & ~stays, F.col("path"))).alias("taker"), F.min(F.when(fresh, F.col("path"))).alias("first"))
    gone = known.join(snapshot.select("path"), "path", "left_anti")
    owners = owners.join(gone.select(F.col("old_hash").alias("hash"), F.lit(True).alias("lost")).distinct(), "hash", "left")
    rows = rows.join(owners, "hash")
    action = (
        F.when(F.col("skipped"), "skipped")
        .when(F.col("old_hash") == F.col("hash"), "refreshed")
        .when(F.col("stays"), "duplicate")
        .when(F.col("path") == F.col("taker"), "updated")
        .when(F.col("taker").isNotNull() | (F.col("path") != F.col("first")), "duplicate")
        .when(F.coalesce("lost", F.lit(False)), "moved")
        .otherwise("new")
    )
    moved = owners.where("lost AND NOT stays AND taker IS NULL").select(F.col("hash").alias("old_hash"))
    missing = gone.where("NOT missing").join(moved, "old_hash", "left_anti")
    return rows.select("path", action.alias("action")).unionByName(missing.select("path", F.lit("missing").alias("action")))


def find_documents(catalog: DataFrame, query: str, course: str | None = None, limit: int = 20) -> DataFrame:
    """Files of which a name, title or course holds ``query``; % and _ in it are wildcards.  Equal names and paths come by id."""
    like = F.lit(f"%{query}%")
    hit = F.lit(False)
    for c in ("descriptive_name", "title", "original_filename", "course"):
        hit = hit | F.coalesce(F.ilike(F.col(c), like), F.lit(False))
    rows = catalog.where(~F.col("missing") & hit)
    rows = rows if course is None else rows.where(F.col("course") == course)
    return rows.orderBy("course", "doc_type", "descriptive_name", "current_path", "id").limit(limit)


def list_courses(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("course").agg(F.count("*").alias("documents"), F.count_if("missing").alias("missing"))


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Totals, by class and by course, in one pass."""
    cubed = catalog.groupingSets([[], ["doc_type"], ["course"]], "doc_type", "course")
    out = cubed.agg(F.grouping_id("doc_type", "course").alias("g"), F.count("*").alias("n"), F.count_if("missing").alias("missing"))
    kind = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "type").otherwise("course")
    return out.select(kind.alias("by"), F.coalesce(F.when(F.col("g") == 1, F.col("doc_type")), F.when(F.col("g") == 2, F.col("course")), F.lit("")).alias("name"), "n", "missing")
