"""Names of things: ids that sort by time, keys and paths of notes, and lines of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 32 digits of ids, without I, L, O and U.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _digit(value: Column) -> Column:
    return F.substring(F.lit(DIGITS), value.cast("int") + 1, F.lit(1))


def new_id(at: Column, seed: Column) -> Column:
    """26 digits: ten of the milliseconds of ``at``, 16 of a hash of ``seed``.  The same moment and seed give the same id, so a task that runs again makes no other."""
    ms, digest = F.unix_millis(at.cast("timestamp")), F.sha2(seed, 256)
    clock = [_digit(F.shiftright(ms, 45 - 5 * i).bitwiseAND(F.lit(31))) for i in range(10)]
    chance = [_digit(F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(31))) for i in range(16)]
    return F.concat(*clock, *chance)


def relative_path(path: Column, root: str) -> Column:
    """The path below ``root``, with forward slashes."""
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.lit(root.rstrip("/") + "/")
    return F.when(F.startswith(whole, base), F.substring(whole, F.length(base) + 1, F.length(whole))).otherwise(whole)


def note_key(path: Column) -> Column:
    """The key of a note in a manifest."""
    return F.concat(F.lit("note:"), path)


def journal_path(at: Column) -> Column:
    return F.concat(F.lit("10-journal/"), F.date_format(at, "yyyy"), F.lit("/"), F.date_format(at, "yyyy-MM-dd"), F.lit(".md"))


def journal_entry(at: Column, text: Column) -> Column:
    """What an entry adds to its day's page."""
    return F.concat(F.lit("\n\n## "), F.date_format(at, "HH:mm"), F.lit("\n\n"), F.trim(text), F.lit("\n"))


def tick_line(applied: Column, indexed: Column, removed: Column, expired: Column, decayed: Column, commit: Column, snapshot: Column) -> Column:
    """One line for what a maintenance tick did or, as a dry run, would do."""
    verb = F.when(applied, "archived").otherwise("would archive")
    shown = F.coalesce(F.left(commit, F.lit(10)), F.lit("no changes"))
    return F.concat(
        F.lit("Scheduler tick ("), F.when(applied, "apply").otherwise("dry-run"), F.lit("): reindexed "), indexed.cast("string"), F.lit(" note(s), removed "), removed.cast("string"),
        F.lit("; TTL "), verb, F.lit(" "), expired.cast("string"), F.lit("; decay "), verb, F.lit(" "), decayed.cast("string"),
        F.lit("; backup commit "), shown, F.lit("; db snapshot "), F.coalesce(snapshot, F.lit("none")), F.lit("."),
    )
