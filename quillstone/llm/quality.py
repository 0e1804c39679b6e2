"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, passes, small_batches
from .flat import Words, texts

#: Labelled rows that training reads; of more, about so many are taken, by hash.
MAX_TRAIN = 20_000
#: Boosting: rounds, leaves' depth, step, bins of each feature, least rows and hessian in a leaf, ridge.
ROUNDS, DEPTH, STEP, BINS, LEAST, RIDGE = 120, 4, 0.1, 64, 5, 1.0

NAMES = [
    "bytes", "words", "word_bytes", "word_bytes_sd", "upper", "digit", "punct", "other_bytes", "symbol", "space",
    "lines", "line_bytes", "short_lines", "repeated_lines", "distinct_words", "top_word", "next_same", "two_back_same", "pipes", "sentence_ends",
    "long_words", "one_byte_words", "commas", "symbol_words", "seven_back_same", "repeated_pairs",
]


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each text; of whole texts, in linear time but for a sort of each text's words."""
    n = len(starts) - 1
    size = np.diff(starts)
    kinds = np.zeros(256, np.uint8)
    kinds[48:58] = 1
    kinds[65:91] = 2
    kinds[[*b".,;:!?'\"-()"]] = 3
    kinds[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 4
    kinds[[32, *range(9, 14)]] = 5
    kinds[128:] = 6

    def total(x: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(x, dtype=np.float64)))
        return run[starts[1:]] - run[starts[:-1]]

    kind = kinds[data]
    share = lambda x: total(x) / np.maximum(size, 1)
    w = Words(data, starts)
    h, long = w.hashes(), (w.end - w.begin).astype(np.float64)
    m = np.maximum(w.count, 1)

    def per_word(x: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(x, dtype=np.float64)))
        return run[w.at[1:]] - run[w.at[:-1]]

    def same(back: int) -> np.ndarray:
        hit = np.zeros(len(h), bool)
        if len(h) > back:
            hit[back:] = (h[back:] == h[:-back]) & (w.doc[back:] == w.doc[:-back])
        return per_word(hit) / m

    mean = per_word(long) / m
    sd = np.sqrt(np.maximum(per_word(long * long) / m - mean * mean, 0))
    lines, short, twice, distinct, top, pairs = (np.zeros(n) for _ in range(6))
    breaks = np.flatnonzero(data == 10)
    at = np.searchsorted(breaks, starts)
    two = h[:-1] * np.uint64(3) + h[1:] if len(h) else h
    for d in range(n):
        if own := w.count[d]:
            a = w.at[d]
            x = np.sort(h[a : a + own])
            edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
            distinct[d], top[d] = len(edge) - 1, np.diff(edge).max()
            if own > 1:
                y = np.sort(two[a : a + own - 1])
                pairs[d] = np.count_nonzero(y[1:] == y[:-1]) / (own - 1)
        cuts = np.concatenate(([starts[d] - 1], breaks[at[d] : at[d + 1]], [starts[d + 1]]))
        length = np.diff(cuts) - 1
        lines[d], short[d] = len(length), np.mean(length < 30)
        if len(length) > 1:
            seen = [data[p + 1 : p + 1 + q].tobytes() for p, q in zip(cuts[:-1], length, strict=True)]
            twice[d] = 1 - len(set(seen)) / len(seen)
    odd = np.concatenate(([0], np.cumsum(kind == 4)))
    return np.column_stack([
        np.log1p(size), np.log1p(w.count), mean, sd, share(kind == 2), share(kind == 1), share(kind == 3), share(kind == 6), share(kind == 4), share(kind == 5),
        np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), short, twice, distinct / m, top / m, same(1), same(2), share(data == 124), share(data == 46),
        per_word(long > 15) / m, per_word(long == 1) / m, share(data == 44), per_word((odd[w.end] > odd[w.begin]) if len(h) else np.zeros(0)) / m, same(7), pairs,
    ]).astype(np.float32)


class Trees:
    """Boosted trees for log loss, flattened: arrays of feature, threshold and value, node i's children at 2i + 1 and 2i + 2."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP):
        self.rounds, self.depth, self.step = rounds, depth, step

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.rounds, nodes), np.int32)
        self.cut = np.full((self.rounds, nodes), np.inf, np.float32)
        self.value = np.zeros((self.rounds, nodes), np.float64)
        p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if not n or y.min() == y.max():
            self.rounds = 0
            return self
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(k)]
        binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)])
        flat = binned + np.arange(k) * BINS
        raw = np.full(n, self.base)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth + 1):
                first, wide = 2**level - 1, 2**level
                local = node - first
                live = local >= 0
                sums = [np.bincount(local[live], w[live], wide) for w in (g, h)]
                self.value[t, first : first + wide] = -self.step * sums[0] / (sums[1] + RIDGE)
                if level == self.depth:
                    break
                key = (local[live][:, None] * (k * BINS) + flat[live]).ravel()
                shape = (wide, k, BINS)
                gs, hs, ns = (np.cumsum(np.bincount(key, None if w is None else np.repeat(w[live], k), wide * k * BINS).reshape(shape), 2) for w in (g, h, None))
                tg, th, tn = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
                gain = gs**2 / (hs + RIDGE) + (tg - gs) ** 2 / (th - hs + RIDGE) - tg**2 / (th + RIDGE)
                gain[(ns < LEAST) | (tn - ns < LEAST)] = -1
                best = gain.reshape(wide, -1).argmax(1)
                for i in np.flatnonzero(gain.reshape(wide, -1).max(1) > 1e-6):
                    j, b = divmod(int(best[i]), BINS)
                    if b < len(cuts[j]):
                        self.feature[t, first + i], self.cut[t, first + i] = j, cuts[j][b]
                split = live & np.isfinite(self.cut[t, np.maximum(node, 0)])
                at = node[split]
                right = x[split, self.feature[t, at]] > self.cut[t, at]
                raw_leaf = live & ~split
                raw[raw_leaf] += self.value[t, node[raw_leaf]]
                node[split] = 2 * at + 1 + right
                node[raw_leaf] = -1
            raw[node >= 0] += self.value[t, node[node >= 0]]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                cut = self.cut[t, node]
                node = np.where(np.isfinite(cut), 2 * node + 1 + (x[rows, self.feature[t, node]] > cut), node)
            raw += self.value[t, node]
        return 1 / (1 + np.exp(-raw))


def held_out(id_col: str = "doc_id", parts: int = 5, at: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``at`` by ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts)) == at


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``y`` of the labelled rows that are not held out; of more than ``most``, about so many, picked by hash."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = rows.count()
    take = rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1e6 * most / n)))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(take), "doc_id").select("doc_id", "text", "y")


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in passes(batches, "text"):
        x = statistics(*texts(batch.column(1)))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "y": batch.column(2).cast(pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> Trees:
    """Trees for ``label``; statistics are made where the texts are, and ``most`` rows of them come to the driver."""
    small_batches(docs.sparkSession)
    got = labelled(docs, labels, label, most).select("doc_id", "text", "y").mapInArrow(lean(_features), "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "y"])
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, len(NAMES))
    return Trees().fit(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, trees: Trees, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    The score comes from the text's statistics alone.  Null texts count as empty; empty texts get a score as
    any other.  Repeated rows are scored each; an empty table has no rows; further columns play no part.  Without labels to learn from, or with one class of them, all
    scores are alike.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            p = trees.predict(statistics(*texts(batch.column(1))))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "held_out": batch.column(2), "score": pa.array(p), "predicted": pa.array((p >= cut).astype(np.int32))})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out")).mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = 0.3) -> DataFrame:
    """Train on what is labelled and not held out, then score every row."""
    return score(docs, train(docs, labels, label), cut)


def keep_good(docs: DataFrame, trees: Trees, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``cut`` or more.

    Null texts count as empty and score as any other; rows are judged one by one, so repeated rows share their fate.  An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            yield batch.filter(pa.array(trees.predict(statistics(*texts(batch.column(at)))) >= cut))

    return docs.mapInArrow(lean(run), docs.schema)
