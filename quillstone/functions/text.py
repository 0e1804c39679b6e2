"""String expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokenize(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; null counts as empty."""
    return F.regexp_extract_all(F.lower(or_empty(c)), F.lit("[a-z0-9]+"), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(or_empty(c), _SPACE, " "))


def slugify(c: Column, words: int = 8, fallback: str = "note") -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.lower(or_empty(c)), "[^a-z0-9]+", "-"), "-"), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, words), "-"), F.lit("")), F.lit(fallback))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def link_keys(path: Column, title: Column) -> Column:
    """The names by which a link may mean a document."""
    name = stem(path)
    keys = F.array(name, slugify(name), or_empty(title), F.when(or_empty(title) != "", slugify(title)))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def wikilinks(body: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|alias]]``, each once, in order."""
    found = F.regexp_extract_all(or_empty(body), F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda t: t != ""))


def snippet(text: Column, limit: int = 300) -> Column:
    """The text with white space squeezed, cut at the last space before ``limit``, with an ellipsis if cut."""
    flat = collapse(text)
    cut = F.rtrim(F.regexp_replace(F.left(flat, F.lit(limit)), " [^ ]*$", ""))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.coalesce(F.nullif(cut, F.lit("")), F.left(flat, F.lit(limit))), F.lit("…")))


def first_line(body: Column, limit: int = 160) -> Column:
    """The first line that is neither blank nor a heading."""
    lines = F.filter(F.transform(F.split(or_empty(body), "\n"), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.left(or_empty(F.try_element_at(lines, F.lit(1))), F.lit(limit))


def fallback_title(body: Column, path: Column) -> Column:
    heads = F.filter(F.transform(F.split(or_empty(body), "\n"), strip), lambda x: x.startswith("#"))
    head = F.nullif(strip(F.regexp_replace(F.try_element_at(heads, F.lit(1)), "^#+", "")), F.lit(""))
    return F.coalesce(head, F.nullif(F.replace(stem(path), F.lit("-"), F.lit(" ")), F.lit("")), F.lit("Untitled"))


def label(title: Column, path: Column, ident: Column) -> Column:
    return F.coalesce(F.nullif(strip(title), F.lit("")), path, ident, F.lit("(unknown)"))


def segments(heading_path: Column) -> Column:
    return F.filter(F.transform(F.split(or_empty(heading_path), ">"), strip), lambda x: x != "")


def est_tokens(text: Column) -> Column:
    """A quarter of the characters, halves to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int"))


def normal_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(or_empty(title)), "[^a-z0-9]", "")


def body_hash(body: Column) -> Column:
    return F.sha2(strip(or_empty(body)), 256)


def with_title(title: Column, body: Column) -> Column:
    return F.when(or_empty(title) != "", F.concat(F.lit("# "), title, F.lit("\n\n"), or_empty(body))).otherwise(or_empty(body))


def archive_path(path: Column) -> Column:
    return F.concat(F.lit("90-archive/"), path)


def corpus_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", ".md")


# Code points that senders pad previews with, and phrases without content.
ZERO_WIDTH = (
    0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD, 0x034F, 0x061C,
    0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x2028, 0x2029,
    0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069,
)
BOILERPLATE = (
    r"view (this )?(email |message )?in (your )?browser",
    r"trouble (viewing|reading) this email",
    r"can'?t see (this|the) (email|images)",
    r"add us to your address book",
    r"unsubscribe",
    r"manage (your )?preferences",
)


def clean_snippet(text: Column, limit: int = 500) -> Column:
    plain = F.translate(or_empty(text), "".join(map(chr, ZERO_WIDTH)), "")
    flat = collapse(F.regexp_replace(plain, "(?i)" + "|".join(BOILERPLATE), " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("…"))).otherwise(flat)
