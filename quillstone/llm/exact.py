"""Exact dedup with DataFrame functions alone: frequent digests apart, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: White space that does not count when texts are compared.
_WHITE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """What equal texts have in common; a null text counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), _WHITE, ""), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and the columns of ``docs`` named in ``carry``.

    Misra-Gries counters (``freqItems``) give at most ``1 / support`` digests that may make up that share
    of the rows.  One aggregation verifies them; the verified winners, never more than ``1 / support`` rows,
    are broadcast, so rows of a frequent digest are decided where they are read.  The other digests are counted with map-side
    sums and met by their rows through an ordinary shuffle, where a digest of many rows can be split.

    Null texts count as empty, empty texts equal each other.  A null id loses every tie.  An id that repeats with texts that are equal but for
    white space keeps the longest, of equally long ones that with the smaller hash.  Rows that repeat an id and its very text
    share their fate.  An empty table gives no rows; further columns of ``docs`` play no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"), F.length(text).alias("_len"), F.xxhash64(text).alias("_own"), *carry),
        "digests",
    )
    best = F.min(F.struct((-F.col("_len")).alias("len"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_own")))
    found = lambda df: df.groupBy("text_sha256").agg(best.alias("_best"), F.count("*").alias("group_size"))
    maybe = rows.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    least = max(2, int(rows.count() * support))
    winners = found(rows.join(F.broadcast(maybe), "text_sha256", "left_semi")).where(F.col("group_size") >= least)
    winners = F.broadcast(written(winners, "winners"))
    rest = rows.join(winners, "text_sha256", "left_anti")
    rest = rest.join(found(rest), "text_sha256")
    out = rows.join(winners, "text_sha256").unionByName(rest)
    stays = F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (-F.col("_len") == F.col("_best.len")) & (F.col("_own") == F.col("_best._own"))
    return out.select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256", *carry)


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, count(*) AS group_size FROM n GROUP BY text_sha256),
     r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS k FROM n)
SELECT n.doc_id, r.doc_id AS keep_id, g.group_size, n.doc_id = r.doc_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256) JOIN r ON r.text_sha256 = n.text_sha256 AND r.k = 1
"""
