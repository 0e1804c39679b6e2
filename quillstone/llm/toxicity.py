"""Toxicity: a convolutional text classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, passes, small_batches
from .flat import Words, texts
from .quality import held_out, labelled

#: Labelled rows that training reads; of more, about so many are taken, by hash.
MAX_TRAIN = 12_000
#: Hash buckets of the embeddings, their width, filter widths and filters of each.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 8, (1, 2, 3), 8
#: A word's embedding is the sum of those of the word and of its first so many bytes, so inflected forms share it.
PREFIXES = (4, 5)
EPOCHS, BATCH, RATE = 10, 64, 0.01


class Net:
    """Hashed word embeddings, filters of several widths, max pooling over the whole text, a logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.par = {"emb": rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.par[f"f{w}"] = rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32)
            self.par[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        out = self.par["emb"][ids[:, 0]]
        for part in ids.T[1:]:
            out += self.par["emb"][part]
        return out

    def pool(self, emb: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text the pooled filters and where each maximum lies (-1: no filter's output is above zero)."""
        n = len(at) - 1
        out, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1, np.int64)
        for i, w in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            places = len(emb) - w + 1
            if places > 0:
                conv = emb[:places] @ self.par[f"f{w}"][0]
                for j in range(1, w):
                    conv += emb[j : j + places] @ self.par[f"f{w}"][j]
                for d in np.flatnonzero(np.diff(at) >= w):
                    own = conv[at[d] : at[d + 1] - w + 1]
                    best = own.argmax(0)
                    where[d, cols] = best + at[d]
                    out[d, cols] = own[best, np.arange(FILTERS)] + self.par[f"b{w}"]
        return np.maximum(out, 0), np.where(out > 0, where, -1)

    def fit(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Net:
        """Adam on log loss; every fifth row is kept apart to calibrate the score."""
        rng = np.random.default_rng(seed)
        apart = np.arange(len(y)) % 5 == 4
        rows = np.flatnonzero(~apart)
        if not len(rows) or y[rows].min() == y[rows].max():
            self.par["out"][:] = 0
            self.shift = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
            return self
        weight = np.where(y == 1, 0.5 / max(y[rows].mean(), 1e-3), 0.5 / max(1 - y[rows].mean(), 1e-3))
        mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.par.items()}
        step = 0
        for _ in range(EPOCHS):
            for b in np.array_split(rng.permutation(rows), -(-len(rows) // BATCH)):
                step += 1
                grad = self.gradients([docs[i] for i in b], y[b], weight[b] / len(b))
                for k, v in self.par.items():
                    m1, m2 = mom[k]
                    m1 += 0.1 * (grad[k] - m1)
                    m2 += 0.01 * (grad[k] ** 2 - m2)
                    v -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        self.calibrate([docs[i] for i in np.flatnonzero(apart)], y[apart])
        return self

    def gradients(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the texts' log losses, summed with ``weight``, for each parameter."""
        ids, at = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(x) for x in docs])))
        emb = self.embed(ids)
        pooled, where = self.pool(emb, at)
        p = 1 / (1 + np.exp(-(pooled @ self.par["out"] + self.par["bias"][0])))
        g = ((p - y) * weight).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in self.par.items()}
        grad["out"], grad["bias"] = pooled.T @ g, np.array([g.sum()], np.float32)
        back = np.outer(g, self.par["out"]) * (where >= 0)
        for i, w in enumerate(WIDTHS):
            d, f = np.nonzero(where[:, i * FILTERS : (i + 1) * FILTERS] >= 0)
            place, delta = where[d, i * FILTERS + f], back[d, i * FILTERS + f]
            grad[f"b{w}"] = np.bincount(f, delta, FILTERS).astype(np.float32)
            for j in range(w):
                into = delta[:, None] * self.par[f"f{w}"][j][:, f].T
                for part in ids[place + j].T:
                    np.add.at(grad["emb"], part, into)
                np.add.at(grad[f"f{w}"][j].T, f, delta[:, None] * emb[place + j])
        return grad

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        at = np.concatenate(([0], np.cumsum([len(x) for x in docs])))
        return self.pool(self.embed(np.concatenate(docs)), at)[0] @ self.par["out"] + self.par["bias"][0]

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray) -> None:
        """Scale and shift of the output for the classes' true shares, by Newton steps on rows not trained on."""
        if len(y) < 20 or y.min() == y.max():
            return
        z = np.concatenate([self.logits(docs[i : i + BATCH]) for i in range(0, len(docs), BATCH)]).astype(np.float64)
        a, b = 1.0, float(np.log(y.mean() / (1 - y.mean())))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.clip(np.linalg.solve(hess + 1e-6 * np.eye(2), grad), -1, 1)
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = max(a, 0.05), b

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.pool(self.embed(ids), at)[0] @ self.par["out"] + self.par["bias"][0]
        return 1 / (1 + np.exp(-np.clip(self.scale * z.astype(np.float64) + self.shift, -40, 40)))


def word_ids(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word, without punctuation, and of its beginnings; and the texts' bounds."""
    keep = np.ones(256, bool)
    keep[[*b".,;:!?'\"()[]*#%&$|"]] = False
    plain = np.where(keep[data], data, np.uint8(32))
    w = Words(plain, starts)
    return np.column_stack([w.hashes(), *w.prefix_hashes(PREFIXES)]) >> np.uint64(64 - 15), w.at


def _ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in passes(batches, "text"):
        ids, at = word_ids(*texts(batch.column(1)))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "lang": batch.column(3), "y": batch.column(2).cast(pa.int32()), "ids": pa.array([ids[a:b].astype(np.uint16).tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAIN) -> tuple[Net, dict[str, float]]:
    """The net, and for each language the threshold of best F1 on rows kept from training (0.5 where there are few)."""
    small_batches(docs.sparkSession)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    both = docs.select("doc_id", F.struct(F.col("text"), lang.cast("string").alias("lang")).alias("text"))
    rows = labelled(both, labels, label, most).select("doc_id", "text.text", "y", "text.lang")
    got = rows.select("doc_id", "text", "y", "lang").mapInArrow(lean(_ids), "doc_id long, lang string, y int, ids binary").toPandas().sort_values(["doc_id", "y"])
    ids, y, lang = [np.frombuffer(x, np.uint16).reshape(-1, 1 + len(PREFIXES)) for x in got["ids"]], got["y"].to_numpy(np.int64), got["lang"].fillna("").to_numpy()
    net = Net().fit(ids, y)
    apart, cuts = np.arange(len(y)) % 5 == 4, {}
    for x in sorted(set(lang)):
        own = np.flatnonzero(apart & (lang == x))
        if y[own].sum() >= 5:
            z = net.logits([ids[i] for i in own])
            p = 1 / (1 + np.exp(-(net.scale * z + net.shift)))
            tries = np.unique(np.round(p, 3))
            f1 = [2 * ((p >= t) & (y[own] == 1)).sum() / max(1, (p >= t).sum() + y[own].sum()) for t in tries]
            good = tries[np.array(f1) >= max(f1)]
            cuts[x] = float(np.clip((good.min() + good.max()) / 2, 0.05, 0.95))
    return net, cuts


def score(docs: DataFrame, net: Net, cuts: dict[str, float] | None = None, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted, and flagged: score against the language's own threshold.

    The score comes from the whole text alone; the language picks only the threshold behind ``flagged``.
    Null texts count as empty, whose score is that of no word found.  Repeated rows are scored each; an unknown or
    null language takes ``cut``.  An empty table has no rows; further columns play no part.
    """
    small_batches(docs.sparkSession)
    cuts = cuts or {}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            p = net.score(*word_ids(*texts(batch.column(1))))
            own = np.array([cuts.get(x, cut) for x in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "held_out": batch.column(2), "score": pa.array(p), "predicted": pa.array((p >= cut).astype(np.int32)), "flagged": pa.array(p >= own)})

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"), lang.cast("string").alias("lang"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, flagged boolean")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on what is labelled and not held out, then score every row."""
    return score(docs, *train(docs, labels))
