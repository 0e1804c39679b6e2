"""From raw documents to packed sequences: quality, exact dedup, near dedup, repeated passages, packing.

All stages take null and empty texts as empty documents, texts of any length whole, and an empty table to an empty table.  Decisions
are about rows, not ids: null ids and ids that repeat lose or keep no other row's text.  Columns beside
those of ``documents`` come along, whatever their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import exact, minhash, packing, quality, suffix
from quillstone.llm import common
from quillstone.llm.common import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, does not reject.

    Rows are scored one by one, so copies share their fate.  Empty texts get a score as any other.  Without labels all rows score alike and stay.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


#: Most rows' keys that are sent to every task; more are met by a join.
SENT_IDS = 500_000


def _without(docs: DataFrame, found: DataFrame, **by: Column) -> DataFrame:
    """The rows of ``docs`` that ``found`` keeps, matched by its columns named in ``by`` to the values there, null to null.

    Texts stay where they are unless what goes is too much to send around.
    """
    gone = written(found.where("NOT kept").select(*(F.col(c).alias(f"_gone_{c}") for c in by)), "gone")
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, [v.eqNullSafe(F.col(f"_gone_{c}")) for c, v in by.items()], "left_anti").select(docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``_near_key`` in the order of the ids, nulls last, that is another one for each text of an id."""
    rows = docs.withColumn("_near_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    keys = rows.select("doc_id", "_near_text").distinct().orderBy(F.asc_nulls_last("doc_id"), "_near_text")
    keys = written(keys.select(F.col("doc_id").alias("_near_id"), F.col("_near_text").alias("_near_of"), F.monotonically_increasing_id().alias("_near_key")), "keys")
    same = [F.col("doc_id").eqNullSafe(F.col("_near_id")), F.col("_near_text") == F.col("_near_of")]
    return written(rows.join(keys, same).select(*docs.columns, "_near_key"), "keyed")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one with the smallest id; null ids come last.

    Null and empty texts equal each other.  Rows that repeat an id and its text share their fate.
    """
    found = exact.exact_dedup(docs.withColumn("_exact_text", F.xxhash64("text")), carry=("_exact_text",))
    return _without(docs, found, doc_id=F.col("doc_id"), _exact_text=F.xxhash64("text"))


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at a similarity of 0.8.

    The one with the smallest id stays; null ids come last.  Empty texts are like none and stay, as do rows that repeat an id and
    its text.  The operator leaves null ids alone: where ids are null or repeat, rows get keys of their own.
    """
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        return _without(docs, minhash.near_duplicates(docs), doc_id=F.col("doc_id"))
    keyed = _keyed(docs)
    return _without(keyed, minhash.near_duplicates(keyed, id_col="_near_key"), doc_id=F.col("_near_key")).select(docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that lie in 100-byte strings seen before; a document may be left empty.

    "Before" is in a smaller id, null first, or earlier in the text; rows that repeat an id count as one document, each cut by its own text.
    """
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    cut = suffix.repeated_bytes(docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in own.items())), keep_text=True, carry=tuple(own.values()))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")} | {c: F.col(n) for c, n in own.items()}
    return cut.select(*(made[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens; an empty text is one end token, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [("quality", good), ("exact", distinct), ("near", dissimilar), ("suffix", unrepeated), ("pack", packed)]

#: No stage but the second can be written in SQL; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again before the next; what a stage leaves behind is deleted."""
    docs = table(spark, sf_dir, "documents")
    since = len(common.made)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        common.drop(spark, since, but=1)
        common.let_go(spark)
    return docs
