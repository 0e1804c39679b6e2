"""Scans of folders of notes and documents.

Spark's listing passes over files and folders whose names begin with a dot or an underscore, so those are never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

# Extensions that are read, and folders that never hold documents.
TEXT = ("pdf", "md", "markdown", "txt")
EXCLUDED = (
    ".venv", "venv", "env", ".git", "__pycache__", "node_modules", ".vscode",
    ".cursor", ".idea", ".ipynb_checkpoints", ".pytest_cache", ".mypy_cache",
    "site-packages", ".DS_Store",
)


def _read(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root), "^[a-z]+:/*(?=/)|/+$", "")
    tail = F.expr("substring_index(path, concat(b, '/'), -1)")
    rows = rows.withColumn("at", F.col("path")).withColumn("b", base).withColumn("path", tail).drop("b")
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def raw(spark: SparkSession, root: str) -> DataFrame:
    """Documents to convert, at any depth, but for README.md."""
    return _read(spark, root, TEXT).where(_name() != "README.md")


def notes(spark: SparkSession, root: str) -> DataFrame:
    """Markdown notes outside of .vault folders: path, text, hash, mtime."""
    rows = _read(spark, root, ("md",)).where(~F.array_contains(F.split("path", "/"), ".vault"))
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("mtime"))


def _catalogued(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    odd = F.exists(F.split("path", "/"), lambda s: s.startswith(".") | s.isin(*EXCLUDED))
    rows = _read(spark, root, extensions).where(~odd)
    return rows.select("at", "path", F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = (*TEXT, "docx", "pptx")) -> DataFrame:
    """(at, path, size_bytes, mtime) of files for the catalog, without excluded and hidden folders and hidden files; no file is opened."""
    return _catalogued(spark, root, extensions).drop("content")


def documents(spark: SparkSession, root: str, extensions: tuple[str, ...] = (*TEXT, "docx", "pptx"), known: DataFrame | None = None) -> DataFrame:
    """(path, content_hash, size_bytes, mtime) of files for the catalog.

    Files of ``known`` (path, content_hash, size_bytes, mtime[, missing]) whose size and time are as they were keep their hash unread; only new and changed ones
    are opened.  Their names pass through the driver, as those of all files do when Spark lists a folder.
    """
    rows = listing(spark, root, extensions)
    read = lambda df: df.withColumn("content_hash", F.sha2("content", 256)).drop("content")
    columns = ("path", "content_hash", "size_bytes", "mtime")
    opened = lambda paths: read(spark.read.format("binaryFile").load(paths).select(F.col("path").alias("at"), "content"))
    if known is None:
        return read(_catalogued(spark, root, extensions)).select(*columns)
    old = known.select("path", "content_hash", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"), (F.col("missing") if "missing" in known.columns else F.lit(False)).alias("_missing"))
    both = rows.join(old, "path", "left")
    same = F.coalesce((F.col("_size") == F.col("size_bytes")) & (F.abs(F.col("_mtime") - F.col("mtime")) < 1e-6) & ~F.col("_missing"), F.lit(False))
    both = kept(both.withColumn("_same", same), "listing")
    changed = both.where("NOT _same")
    # Spark reads glob characters in the names it is given.
    paths = [r.at for r in changed.select(F.regexp_replace("at", r"([\\*?\[\]{}])", r"\\$1").alias("at")).toLocalIterator()]
    out = both.where("_same").select(*columns)
    return out.unionByName(changed.drop("content_hash").join(opened(paths), "at").select(*columns)) if paths else out


def staged(spark: SparkSession, root: str, area: str | None = None) -> DataFrame:
    """Markdown to import, but for README and names that begin with _ or a dot."""
    rows = notes(spark, root).where((F.upper(_name()) != "README.MD") & ~_name().rlike("^[_.]"))
    return rows if area is None else rows.where(F.startswith("path", F.lit(f"{area}/")))


def inbox(documents: DataFrame) -> DataFrame:
    """Notes right in the inbox folder."""
    return documents.where(F.col("path").rlike("^00-inbox/[^/]+$"))

