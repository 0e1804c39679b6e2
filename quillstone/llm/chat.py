"""Preference formatting with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters, ``0x`` not trained on and ``1x`` trained on: what an assistant says and its end mark."""
    head = lambda t: F.length(t["role"]) + F.lit(5)
    body = lambda t: F.length(t["text"]) + F.lit(8)
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.when(t["role"] == "assistant", F.concat(F.lit("0x"), head(t), F.lit(",1x"), body(t))).otherwise(F.concat(F.lit("0x"), head(t) + body(t))),
        ),
        ",",
    )


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Adds prompt, prompt_turns, and text and mask of either completion to rows with two conversations.

    ``chosen`` and ``rejected`` are arrays of structs with role and text.  The turns that both begin with are
    rendered once, as the prompt; what follows in each is its completion.  The masks count characters of the
    completions; nothing of the prompt is trained on.  A null conversation counts as one without turns, null
    roles and texts as empty.  Other columns stay, but for those named as the new ones.
    """
    clean = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = pairs.withColumn("_own_chosen", clean(chosen)).withColumn("_own_rejected", clean(rejected))
    n = F.least(F.size("_own_chosen"), F.size("_own_rejected"))
    equal = F.zip_with(F.slice("_own_chosen", F.lit(1), n), F.slice("_own_rejected", F.lit(1), n), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    rows = rows.withColumn("_own_k", F.coalesce(F.nullif(F.array_position(equal, F.lit(False)), F.lit(0)) - 1, n.cast("long")).cast("int"))
    rest = lambda c: F.slice(c, F.col("_own_k") + 1, F.size(c))
    return (
        rows.withColumn("prompt_turns", F.col("_own_k").cast("long"))
        .withColumn("prompt", _render(F.slice("_own_chosen", F.lit(1), F.col("_own_k"))))
        .withColumn("chosen_text", _render(rest("_own_chosen")))
        .withColumn("chosen_mask", _mask(rest("_own_chosen")))
        .withColumn("rejected_text", _render(rest("_own_rejected")))
        .withColumn("rejected_mask", _mask(rest("_own_rejected")))
        .drop("_own_chosen", "_own_rejected", "_own_k")
    )


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """One row per pair of conversations 2k (chosen) and 2k + 1 (rejected), formatted.

    Turns go by number, those that share a number by role and text; turns without a conversation id belong
    to none.  A conversation whose partner is missing is still returned, with ``paired`` false.  Turns that repeat are kept, an empty table
    has no rows, other columns play no part.  A row holds the two conversations of one pair, nothing wider is gathered: the output is so
    by definition, so a conversation must fit a task.
    """
    turn = F.struct("turn", "role", "text")
    one = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    side = F.pmod("conv_id", F.lit(2))
    pairs = one.groupBy(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id")).agg(F.first(F.when(side == 0, F.col("turns")), True).alias("chosen"), F.first(F.when(side == 1, F.col("turns")), True).alias("rejected"))
    out = format_preferences(pairs.withColumn("paired", F.col("chosen").isNotNull() & F.col("rejected").isNotNull()))
    return out.select("pair_id", "paired", "prompt_turns", "prompt", "chosen_text", "chosen_mask", "rejected_text", "rejected_mask")


SQL = r"""
WITH t AS (SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
     s AS (SELECT pair_id, max(CASE WHEN side = 0 THEN pos END) AS na, max(CASE WHEN side = 1 THEN pos END) AS nb FROM t GROUP BY pair_id),
     d AS (SELECT a.pair_id, min(a.pos) AS bad FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.pos = b.pos
           WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
     k AS (SELECT s.pair_id, na IS NOT NULL AND nb IS NOT NULL AS paired, coalesce(bad - 1, least(coalesce(na, 0), coalesce(nb, 0))) AS k
           FROM s LEFT JOIN d USING (pair_id)),
     r AS (SELECT t.*, k.k, k.paired, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
                  CASE WHEN role = 'assistant' THEN '0x' || (length(role) + 5) || ',1x' || (length(text) + 8)
                       ELSE '0x' || (length(role) + length(text) + 13) END AS mask FROM t JOIN k USING (pair_id))
SELECT pair_id, any_value(paired) AS paired, CAST(any_value(k) AS BIGINT) AS prompt_turns,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos <= k), '') AS prompt,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos > k), '') AS chosen_text,
       coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (WHERE side = 0 AND pos > k), '') AS chosen_mask,
       coalesce(string_agg(line, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > k), '') AS rejected_text,
       coalesce(string_agg(mask, ',' ORDER BY pos) FILTER (WHERE side = 1 AND pos > k), '') AS rejected_mask
FROM r GROUP BY pair_id
"""
