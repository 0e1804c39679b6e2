"""Time expressions; the session runs in UTC and the current moment is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(c: Column) -> Column:
    """ISO-8601 with a whole date; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(c))


def moment(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def days_since(now: str, *touched: Column) -> Column:
    """Days from the latest of ``touched`` to ``now``, not below 0; 0 where none is known."""
    last = F.greatest(*touched) if len(touched) > 1 else touched[0]
    return F.coalesce(F.greatest(F.lit(0.0), (F.unix_micros(moment(now)) - F.unix_micros(last)) / F.lit(86_400_000_000.0)), F.lit(0.0))


def message_time(internal_ms: Column, date_header: Column, now: str) -> Column:
    mailed = F.try_to_timestamp(F.regexp_replace(date_header, r"^\s*[A-Za-z]{3},\s*|\s*\(.*\)$", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(F.timestamp_millis(internal_ms.try_cast("long")), mailed, moment(now))


def week_key(ts: Column) -> Column:
    """ISO year and week, as 2026-W28."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def digest_key(ts: Column) -> Column:
    return F.concat(F.lit("gmail://digest/"), week_key(ts))


def digest_title(ts: Column) -> Column:
    return F.concat(F.lit("Mail digest — "), F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit(" week "), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def expires(now: str, days: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment(now)) + (days * F.lit(86_400_000_000)).cast("long"))
