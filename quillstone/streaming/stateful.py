"""Streams with keyed state of their own: runs that expire, deliveries seen within a time, and digests that grow line by line."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..ship import ship

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "key string, first timestamp, last timestamp, n long"
DIGEST = "source_ref string, title string, n long, body string"


def _ready(spark: SparkSession) -> None:
    """State of this kind is kept in RocksDB, and checkpoints where the query's do."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    ship(spark)


def _micros(seconds: float) -> int:
    return int(seconds * 1_000_000)


class _Runs(StatefulProcessor):
    """Per key the open runs (first, last, n) in microseconds, joined as rows come in, emitted when the watermark has passed them."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long")

    def _due(self, last: int) -> int:
        """The millisecond, as timers have them, after a run's time to live."""
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            runs += [(t, t, 1) for t in at]
        merged: list[list[int]] = []
        for first, last, n in sorted(runs):
            if merged and first - merged[-1][1] <= self.gap:
                merged[-1][1] = max(merged[-1][1], last)
                merged[-1][2] += n
            else:
                merged.append([first, last, n])
        self.open.put([tuple(r) for r in merged])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        for _, last, _ in merged:
            self.handle.registerTimer(self._due(last))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        runs = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        done = [r for r in runs if self._due(r[1]) <= due]
        left = [r for r in runs if self._due(r[1]) > due]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        stamp = lambda i: pd.to_datetime([r[i] for r in done], unit="us")
        if done:
            yield pd.DataFrame({"key": [key[0]] * len(done), "first": stamp(0), "last": stamp(1), "n": [r[2] for r in done]})

    def close(self) -> None:
        pass


def expiring_counts(events: DataFrame, ttl_seconds: float, late: str = "0 seconds") -> DataFrame:
    """(key, first, last, n) of each run of a key's events (key, at), as a stream: a run ends when the key is quiet for longer than its time to live.

    A key's state is there from its first event until the watermark is past its time to live, then the run is emitted and forgotten.  Events
    up to ``late`` behind the newest join the runs they belong to, in whatever batch they come.
    """
    _ready(events.sparkSession)
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Runs(_micros(ttl_seconds)), outputStructType=RUN, outputMode="Append", timeMode="EventTime")


def counts_until(events: DataFrame, ttl_seconds: float) -> DataFrame:
    """The batch form: all runs of ``events``, open or not."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("at").cast("timestamp")).alias("t"))
    order = Window.partitionBy("key").orderBy("t")
    begins = F.coalesce(F.col("t") - F.lag("t").over(order) > _micros(ttl_seconds), F.lit(True)).cast("int")
    runs = rows.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy("key", "_run").agg(F.timestamp_micros(F.min("t")).alias("first"), F.timestamp_micros(F.max("t")).alias("last"), F.count("*").alias("n")).drop("_run")


class _Seen(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for frame in rows:
            if not known and len(frame):
                yield frame.head(1)
                known = True
        self.seen.update((True,))

    def close(self) -> None:
        pass


def delivered_once(items: DataFrame, key: str, ttl_seconds: float) -> DataFrame:
    """The first row of each key of a stream; a key that has not come for ``ttl_seconds`` of the cluster's clock is forgotten by the state itself."""
    _ready(items.sparkSession)
    return items.groupBy(key).transformWithStateInPandas(_Seen(int(1000 * ttl_seconds)), outputStructType=items.schema, outputMode="Append", timeMode="ProcessingTime")


#: Parts of a digest's lines, by a hash of the message.
PARTS = 1024


class _Digests(StatefulProcessor):
    """Per week the lines of its messages, in parts; a digest is rendered anew when a line was added or changed.

    A batch reads and writes each part that it touches once, however many messages it has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "part int", "ids array<string>, lines array<string>")
        self.title = handle.getValueState("title", "title string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.title.get()
        title, new = held and held[0], {}
        for frame in rows:
            for message, name, line in zip(frame["message_id"].astype(str), frame["title"], frame["line"], strict=True):
                new.setdefault(crc32(message.encode()) % PARTS, {})[message] = line
                title = name if title is None or name > title else title
        changed = held is None or title != held[0]
        if changed:
            self.title.update((title,))
        for part, lines in new.items():
            old = self.lines.getValue((part,)) if held is not None and self.lines.containsKey((part,)) else None
            had = {} if old is None else dict(zip(old[0], old[1], strict=True))
            now = had | lines
            if now != had:
                self.lines.updateValue((part,), (list(now), list(now.values())))
                changed = True
        if changed:
            lines = sorted((line for _, v in self.lines.iterator() for line in v[1]), reverse=True)
            body = f"# {title}\n\n{len(lines)} message(s) rolled up from bulk/list mail.\n\n" + "\n".join(lines) + f"\n\n<!-- source_ref: {key[0]} -->\n"
            yield pd.DataFrame({"source_ref": [key[0]], "title": [title], "n": [len(lines)], "body": [body]})

    def close(self) -> None:
        pass


def digests(items: DataFrame) -> DataFrame:
    """(source_ref, title, n, body) of each weekly digest that a batch of ``items`` (source_ref, title, message_id, line) changed, as a stream.

    Equal to ``mail.render_digests`` of all items so far, however they are split; a late item joins its week, a repeated one changes
    nothing and emits nothing.  A week's state is its lines.
    """
    _ready(items.sparkSession)
    rows = items.select("source_ref", "title", F.col("message_id").cast("string").alias("message_id"), "line")
    return rows.groupBy("source_ref").transformWithStateInPandas(_Digests(), outputStructType=DIGEST, outputMode="Update", timeMode="None")
