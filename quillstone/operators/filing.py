"""The file catalog as state: a scan's outcome, duplicate paths, and renames that can be undone."""

from __future__ import annotations

import contextlib
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import moment
from ..session import kept
from ..sources.tables import Tables
from . import files


def scanned(catalog: DataFrame, snapshot: DataFrame, now: str, rehash: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, duplicates, actions) after a scan.

    ``catalog`` has the columns of ``schema.CATALOG``; ``snapshot`` path, content_hash, size_bytes, mtime, pages, meta_title, first_line.  New files get
    the next ids by path; changed ones are described anew under their id, moved ones keep id and description, missing ones are marked.
    ``duplicates`` (document_id, path, size_bytes, found_at) are the copies this scan found; a file that became a copy leaves the catalog.
    Of several missing files of one content the first by id moves, the others stay missing.
    """
    known = catalog.select(F.col("current_path").alias("path"), "content_hash", "size_bytes", "mtime", "missing")
    actions = kept(files.scan(known, snapshot.select("path", "content_hash", "size_bytes", "mtime"), rehash), "actions")
    seen = files.describe(snapshot).join(actions, "path").withColumn("original_filename", F.element_at(F.split("path", "/"), -1)).withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    last = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    fresh = seen.where("action = 'new'")
    # Ids go by path over what is new; ranks come from counts of ranges, not from one sorted partition.
    numbered = _numbered(fresh, "path").join(F.broadcast(last), F.lit(True))
    made = numbered.select(
        (F.col("last") + F.col("number")).alias("id"), "content_hash", "course", "subpath", "original_filename", F.col("path").alias("current_path"), "descriptive_name", "doc_type", "title", "extension", "size_bytes",
        F.col("pages").cast("int").alias("pages"), "mtime", moment(now).alias("cataloged_at"), F.lit(False).alias("renamed"), F.lit(False).alias("missing"),
    )
    columns = made.columns
    own = seen.where("action IN ('updated', 'refreshed', 'duplicate')").select(F.col("path").alias("current_path"), "action", *(F.col(c).alias(f"_{c}") for c in ("content_hash", "descriptive_name", "doc_type", "title", "size_bytes", "pages", "mtime")))
    away = catalog.join(snapshot.select(F.col("path").alias("current_path")), "current_path", "left_anti").groupBy("content_hash").agg(F.min_by("current_path", "id").alias("current_path"))
    to = seen.where("action = 'moved'").select("content_hash", F.struct("path", "mtime").alias("_to")).join(away, "content_hash").select("current_path", "_to")
    gone = actions.where("action = 'missing'").select(F.col("path").alias("current_path"), F.lit(True).alias("_gone"))
    old = catalog.join(own, "current_path", "left").join(to, "current_path", "left").join(gone, "current_path", "left")
    old = old.where(F.coalesce(F.col("action") != "duplicate", F.lit(True)))
    again = (F.col("action") == "updated") | ((F.col("action") == "refreshed") & F.lit(rehash))
    back = F.col("action").isNotNull() | F.col("_to").isNotNull()
    pick = lambda c, when: F.when(when, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    changed = {c: pick(c, again) for c in ("content_hash", "descriptive_name", "doc_type", "title", "pages")} | {"size_bytes": pick("size_bytes", F.col("action").isNotNull())}
    changed["mtime"] = F.coalesce(F.col("_to.mtime"), F.col("_mtime"), F.col("mtime")).alias("mtime")
    changed["current_path"] = F.coalesce(F.col("_to.path"), F.col("current_path")).alias("current_path")
    changed["missing"] = F.when(back, False).when(F.coalesce("_gone", F.lit(False)), True).otherwise(F.col("missing")).alias("missing")
    after = old.select(*(changed.get(c, F.col(c)) for c in columns)).unionByName(made)
    holder = after.where("NOT missing").groupBy("content_hash").agg(F.min("id").alias("document_id"))
    copies = seen.where("action = 'duplicate'").join(holder, "content_hash").select("document_id", "path", "size_bytes", moment(now).alias("found_at"))
    return after, copies, actions


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``number`` from 1 on, in the order of ``by``, without a sort in one task: places within sorted ranges, and counts of the ranges before."""
    placed = kept(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")


def merged_duplicates(known: DataFrame, found: DataFrame) -> DataFrame:
    """Duplicate paths of both; a path that is known stays as it was found first."""
    return known.unionByName(found.join(known.select("path"), "path", "left_anti").select(known.columns))


def named_duplicates(duplicates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, size_bytes, descriptive_name, current_path) of duplicate paths, with the document they copy, by its name."""
    named = catalog.select(F.col("id").alias("document_id"), "descriptive_name", "current_path")
    return duplicates.join(named, "document_id").select("path", "size_bytes", "descriptive_name", "current_path").orderBy("descriptive_name", "path")


def list_documents(catalog: DataFrame, course: str | None = None) -> DataFrame:
    """The catalog's documents that are there, by course, class and name."""
    rows = catalog.where("NOT missing")
    rows = rows if course is None else rows.where(F.col("course") == course)
    return rows.orderBy("course", "doc_type", "descriptive_name", "id")


# ---- Effects on a local folder.  Tables say what is to be done and what was; the driver only carries the moves out.

#: What renames were done: the batches' log.
RENAMES = "batch int, id long, from_path string, to_path string"


def present(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a local folder; none is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.select(F.substring_index("path", f"{root.rstrip('/')}/", -1).alias("path"))


def free_names(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, old_path, new_path) of a plan whose old paths are there (``taken``, path), each with a name that is free: the one planned, or that with a number.

    Of a target's candidates, as many as could be taken and are asked for, those that no file has go to the rows by id.
    """
    stem, end = r"^(.*?)(?:-\d+)?(\.[^./]*)?$", r"(\.[^./]*)$"
    rows = plan.join(taken.select(F.col("path").alias("old_path")), "old_path", "left_semi").where("old_path <> new_path")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("new_path").orderBy("id")))
    like = taken.groupBy(F.regexp_replace("path", stem, "$1$2").alias("_like")).agg(F.count("*").alias("_taken"))
    asked = rows.groupBy("new_path").agg(F.count("*").alias("_asked")).withColumn("_like", F.regexp_replace("new_path", stem, "$1$2")).join(like, "_like", "left")
    asked = asked.withColumn("_n", F.explode(F.sequence(F.lit(0), (F.col("_asked") + F.coalesce("_taken", F.lit(0))).cast("int"))))
    ending = F.regexp_extract("new_path", end, 1)
    name = F.when(F.col("_n") == 0, F.col("new_path")).otherwise(F.concat(F.expr("left(new_path, length(new_path) - length(_end))"), F.lit("-"), F.col("_n").cast("string"), "_end"))
    free = asked.withColumn("_end", ending).select("new_path", "_n", name.alias("path")).join(taken, "path", "left_anti")
    free = free.withColumn("_place", F.row_number().over(Window.partitionBy("new_path").orderBy("_n")))
    return rows.join(free, ["new_path", "_place"]).select("id", "old_path", F.col("path").alias("new_path"))


def _move(moves: DataFrame, root: str) -> DataFrame:
    """Carries out (id, from_path, to_path); what fails is left out of the rows that come back."""
    done = []
    for r in moves.toLocalIterator():
        Path(root, r.to_path).parent.mkdir(parents=True, exist_ok=True)
        with contextlib.suppress(FileNotFoundError):
            os.rename(Path(root, r.from_path), Path(root, r.to_path))
            done.append((r.id, r.from_path, r.to_path))
    return moves.sparkSession.createDataFrame(done, "id long, from_path string, to_path string")


def apply_renames(plan: DataFrame, root: str, tables: Tables) -> DataFrame:
    """Renames the files of a plan (id, old_path, new_path) below ``root`` and adds them to the table ``renames`` as a batch; (id, from_path, to_path)."""
    moves = kept(free_names(plan, present(plan.sparkSession, root)).withColumnsRenamed({"old_path": "from_path", "new_path": "to_path"}), "moves")
    done = _move(moves, root)
    log = tables.read("renames", RENAMES)
    batch = log.agg((F.coalesce(F.max("batch"), F.lit(0)) + 1).cast("int").alias("batch"))
    if done.limit(1).count():
        tables.write("renames", log.unionByName(done.join(batch, F.lit(True)).select(log.columns)))
    return done


def undo_renames(root: str, tables: Tables) -> DataFrame:
    """Takes the last batch back; files that are gone, or whose old name is taken by now, stay.  The batch leaves the log."""
    log = tables.read("renames", RENAMES)
    last = kept(log.join(log.agg(F.max("batch").alias("batch")), "batch", "left_semi"), "last")
    there = kept(present(log.sparkSession, root), "present")
    back = last.select("id", F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"))
    back = back.join(there.select(F.col("path").alias("from_path")), "from_path", "left_semi").join(there.select(F.col("path").alias("to_path")), "to_path", "left_anti").select("id", "from_path", "to_path")
    done = _move(back, root)
    if last.limit(1).count():
        tables.write("renames", kept(log.join(last.select("batch"), "batch", "left_anti").select(log.columns), "log"))
    return done


def renamed(catalog: DataFrame, done: DataFrame, flag: bool = True) -> DataFrame:
    """The catalog after renames (id, from_path, to_path) were applied (or, with ``flag`` false, undone)."""
    both = catalog.join(done.select("id", F.col("to_path").alias("_to")), "id", "left")
    moved = F.col("_to").isNotNull()
    return both.withColumn("current_path", F.coalesce("_to", "current_path")).withColumn("renamed", F.when(moved, F.lit(flag)).otherwise(F.col("renamed"))).select(catalog.columns)


def delete_duplicate_files(duplicates: DataFrame, root: str, sure: bool = False) -> list[str]:
    """Deletes the copies (never the document they copy) and says which; nothing without ``sure``."""
    gone = []
    for row in duplicates.select("path").distinct().orderBy("path").toLocalIterator():
        if sure:
            Path(root, row.path).unlink(missing_ok=True)
        gone.append(row.path)
    return gone
