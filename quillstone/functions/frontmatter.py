"""The metadata block of a note: a small grammar of scalars and lists, read and written.

A malformed block is reported in a column, never raised, so that one note cannot fail a job.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which known fields are written, and characters that make a string need quotes.
FIELDS = ("id", "title", "category", "created", "updated", "source", "source_ref", "tags", "people", "importance", "pinned", "expires", "status")
QUOTED = ":#[]{},"

_FENCE = "---"
_INT = re.compile(r"[+-]?\d+\Z")
_WORDS: dict[str, Any] = {"": None, "~": None, "null": None, "true": True, "false": False}


class Malformed(ValueError):
    """The block is not closed, or a line of it is no entry."""


def scalar(token: str) -> Any:
    if len(token) >= 1 and token[0] == token[-1] and token[0] in "\"'":
        return token[1:-1]
    if token.lower() in _WORDS:
        return _WORDS[token.lower()]
    return int(token) if _INT.match(token) else token


def read(text: str) -> tuple[dict[str, Any], str]:
    """(fields, body) of a note; a text that does not open with a fence is all body."""
    if not text.startswith(_FENCE):
        return {}, text
    head, *rest = text.splitlines()
    close = next((i for i, line in enumerate(rest) if line.strip() == _FENCE), None)
    if close is None:
        raise Malformed("the metadata block is not closed")
    fields: dict[str, Any] = {}
    open_list: str | None = None  # a key without a value so far, which items may follow
    for line in rest[:close]:
        entry = line.strip()
        if open_list is not None and entry.startswith("- "):
            fields[open_list] = [*(fields[open_list] or []), scalar(entry[2:].strip())]
            continue
        if not entry or entry.startswith("#"):
            open_list = None
            continue
        key, colon, value = (x.strip() for x in line.partition(":"))
        if not colon:
            raise Malformed(f"not an entry: {entry}")
        open_list = None if value else key
        if value[:1] == "[" and value[-1:] == "]":
            inner = value[1:-1].strip()
            fields[key] = [scalar(x.strip()) for x in inner.split(",")] if inner else []
        else:
            fields[key] = scalar(value)
    return fields, "\n".join(rest[close + 1 :])


def _plain(value: Any) -> str:
    if not isinstance(value, str):
        return json.dumps(value) if value is None or isinstance(value, bool) else str(value)
    odd = value != value.strip() or value.lower() in _WORDS or _INT.match(value) or any(c in QUOTED for c in value)
    return '"' + value.replace('"', '\\"') + '"' if odd else value


def write(fields: dict[str, Any], body: str) -> str:
    """The note's text: known fields in their order, others after them as they come."""
    keys = [k for k in FIELDS if k in fields] + [k for k in fields if k not in FIELDS]
    block = "".join(f"{k}: " + (f"[{', '.join(map(_plain, fields[k]))}]" if isinstance(fields[k], list) else _plain(fields[k])) + "\n" for k in keys)
    return f"{_FENCE}\n{block}{_FENCE}\n\n{body}" + ("\n" if body and not body.endswith("\n") else "")


def parsed(text: Column) -> Column:
    """A struct of frontmatter (JSON), body and error."""

    @F.pandas_udf("frontmatter string, body string, error string")
    def run(column: pd.Series) -> pd.DataFrame:
        out = []
        for one in column:
            try:
                fields, body = read(one or "")
                out.append((json.dumps(fields, ensure_ascii=False), body, None))
            except Malformed as why:
                out.append((None, one, str(why)))
        return pd.DataFrame(out, columns=["frontmatter", "body", "error"])

    return run(text)


def dumped(frontmatter: Column, body: Column) -> Column:
    """A note's text from its JSON fields and its body."""

    @F.pandas_udf("string")
    def run(fields: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([write(json.loads(f or "{}"), b or "") for f, b in zip(fields, bodies, strict=True)])

    return run(frontmatter, body)


def bumped(frontmatter: Column, now: str) -> Column:
    """The JSON fields with ``updated`` set to ``now``, in place or at the end."""

    @F.pandas_udf("string")
    def run(fields: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(json.loads(f or "{}") | {"updated": now}, ensure_ascii=False) for f in fields])

    return run(frontmatter)
