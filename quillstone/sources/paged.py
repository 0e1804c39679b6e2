"""A paged remote listing as a Spark data source, for batch and for streams.

The page function is injected: ``(cursor) -> (items, next_cursor)``, items being JSON strings; an expired cursor is
reported by raising ``Expired`` and makes the reader begin anew.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

MAX_PAGES = 1000


class Expired(Exception):
    """The cursor is no longer known to the source."""


def pages(fetch: Callable[[str | None], tuple[list[str], str | None]], cursor: str | None, end: str | None = None) -> tuple[list[str], str | None]:
    """All items from a cursor on: until a page is empty, the cursor stands still or reaches ``end``, or ``MAX_PAGES`` were read."""
    items: list[str] = []
    for _ in range(MAX_PAGES):
        try:
            got, after = fetch(cursor)
        except Expired:
            if cursor is None:
                raise
            items, cursor = [], None
            continue
        items += got
        if not got or after == cursor or (end is not None and after == end):
            return items, after if after is not None else cursor
        cursor = after
    return items, cursor


def _function(name: str) -> Callable[[str | None], tuple[list[str], str | None]]:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class PagedSource(DataSource):
    """``spark.read.format("paged").option("fetch", "module:function")``; rows have ``item`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "item string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        yield from ((x,) for x in pages(_function(self.options["fetch"]), self.options.get("cursor"))[0])


class _Stream(SimpleDataSourceStreamReader):
    """The offset is the cursor: what a batch has read is logged before the next, and a replay reads the same again."""

    def __init__(self, options: dict):
        self.fetch = _function(options["fetch"])

    def initialOffset(self) -> dict:
        return {"cursor": None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        items, cursor = pages(self.fetch, start["cursor"])
        return iter([(x,) for x in items]), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(x,) for x in pages(self.fetch, start["cursor"], end["cursor"])[0]] if start != end else [])


#: Ids that one task gets.
IDS_A_TASK = 100


def changed_ids(changes: Callable[[str | None], tuple[list[str], str | None]], token: str | None, end: str | None) -> list[str]:
    """Ids that changed after ``token`` and up to ``end``, each once, in order.  Where the source no longer knows ``token``, all ids from the beginning."""
    ids: list[str] = []
    while token != end:
        try:
            got, after = changes(token)
        except Expired:
            if token is None:
                raise
            ids, token = [], None
            continue
        ids += got
        if after is None or after == token:
            break
        token = after
    return list(dict.fromkeys(ids))


def newest_token(changes: Callable[[str | None], tuple[list[str], str | None]], token: str | None) -> str | None:
    """The token after all changes that there are now."""
    for _ in range(MAX_PAGES):
        try:
            _, after = changes(token)
        except Expired:
            if token is None:
                raise
            token = None
            continue
        if after is None or after == token:
            break
        token = after
    return token


class _Ids(InputPartition):
    def __init__(self, ids: list[str], token: str | None):
        super().__init__(None)
        self.ids, self.token = ids, token


class ListedSource(DataSource):
    """A remote listing with changes: ``spark.readStream.format("listed")`` gives id, item (JSON) and the batch's token.

    ``changes(token)`` lists ids that changed since a token, a page at a time, and the token after them; ``get(id)`` fetches one item, None if
    it is gone.  They are named by the options ``changes`` and ``get`` ("module:function") or given to ``listed``.  The driver lists ids; tasks get
    ``ids`` (option, ``IDS_A_TASK``) of them each.  ``cursor`` (option) is the token to begin with.
    """

    calls: tuple | None = None

    @classmethod
    def name(cls) -> str:
        return "listed"

    def schema(self) -> str:
        return "id string, item string, token string"

    def _remote(self) -> tuple:
        return type(self).calls or tuple(_function(self.options[k]) for k in ("changes", "get"))

    def reader(self, schema) -> DataSourceReader:
        return _Listed(self.options, self._remote())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ListedStream(self.options, self._remote())


def listed(changes: Callable[[str | None], tuple[list[str], str | None]], get: Callable[[str], str | None], named: str = "listed") -> type[ListedSource]:
    """A source over two functions, to be registered with ``spark.dataSource.register``."""

    class Listed(ListedSource):
        calls = (changes, get)

        @classmethod
        def name(cls) -> str:
            return named

    return Listed


class _Listed(DataSourceReader):
    def __init__(self, options: dict, remote: tuple):
        self.options, (self.changes, self.get) = options, remote

    def planned(self, token: str | None, end: str | None) -> list[_Ids]:
        ids, size = changed_ids(self.changes, token, end), int(self.options.get("ids", IDS_A_TASK))
        return [_Ids(ids[i : i + size], end) for i in range(0, len(ids), size)] or [_Ids([], end)]

    def partitions(self) -> list[_Ids]:
        token = self.options.get("cursor")
        return self.planned(token, newest_token(self.changes, token))

    def read(self, partition: _Ids) -> Iterator[tuple]:
        for i in partition.ids:
            item = self.get(i)
            if item is not None:
                yield i, item, partition.token


class _ListedStream(DataSourceStreamReader):
    """Offsets are tokens: Spark logs a batch's end before it is read, so a restart reads the same changes again.

    The token's row is written with the batch (see ``streaming.jobs.sync_listed``).
    """

    def __init__(self, options: dict, remote: tuple):
        self.batch, self.at = _Listed(options, remote), options.get("cursor")

    def initialOffset(self) -> dict:
        return {"token": self.batch.options.get("cursor")}

    def latestOffset(self) -> dict:
        self.at = newest_token(self.batch.changes, self.at)
        return {"token": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Ids]:
        return self.batch.planned(start["token"], end["token"])

    def read(self, partition: _Ids) -> Iterator[tuple]:
        return self.batch.read(partition)
