"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_group, passes, small_batches, written
from .flat import Words, arrays, texts
from .quality import held_out

#: Outputs of the net: the commonest words, and classes of all other words by the hash of their last two bytes.
WORDS, CLASSES = 960, 64
#: Words whose counts every task gets as a table; the counts of all others are joined.
TABLE = 1 << 17
#: Embedding width, noise words of a batch, batch, step, and about how many documents the first weights are made on.
DIM, NOISE, BATCH, RATE, START_DOCS, START_EPOCHS = 16, 32, 4096, 0.05, 600, 4
#: What closes a text, as a word's hash.
END = np.uint64(0xE5D0F7E5D0F7E5D0)
OUT = WORDS + CLASSES


class Tokens:
    """Words of a batch of texts, each text closed by one END, as hashes end to end with bounds and classes."""

    def __init__(self, column: pa.Array):
        w = Words(*texts(column))
        n = len(w.count)
        self.at = w.at + np.arange(n + 1)
        self.hash = np.full(int(self.at[-1]), END, np.uint64)
        self.cls = np.zeros(len(self.hash), np.int64)
        inside = np.ones(len(self.hash), bool)
        inside[self.at[1:] - 1] = False
        self.hash[inside] = w.hashes()
        self.cls[inside] = (w.suffix_hashes(2) >> np.uint64(58)).astype(np.int64)


class Net:
    """log p(w | u, v) = (R[u] * C1 + R[v] * C2) . Q[w] + b[w] - log Z, with diagonal matrices for the two places."""

    def __init__(self, noise: np.ndarray):
        rng = np.random.default_rng(17)
        self.noise = noise
        self.par = [rng.normal(0, 0.1, (OUT + 1, DIM)), np.ones((2, DIM)), rng.normal(0, 0.1, (OUT, DIM)), np.log(noise)]
        self.par = [p.astype(np.float32) for p in self.par]
        self.sums = [np.full_like(p, 0.1) for p in self.par]

    def train(self, ids: np.ndarray, before: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of NCE over targets and their contexts; the noise words of a batch are shared by its targets."""
        R, C, Q, b = self.par
        logn = np.log(self.noise * NOISE).astype(np.float32)
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for i in range(0, len(ids), BATCH):
            w, u, v = ids[i : i + BATCH], before[i : i + BATCH], two[i : i + BATCH]
            neg = rng.choice(OUT, NOISE, p=self.noise)
            ru, rv = R[u], R[v]
            r = ru * C[0] + rv * C[1]
            qw, qn = Q[w], Q[neg]
            gp = 1 - sig((r * qw).sum(1) + b[w] - logn[w])
            gn = -sig(r @ qn.T + b[neg] - logn[neg])
            dr = gp[:, None] * qw + gn @ qn
            scatter = lambda at, x, n: np.column_stack([np.bincount(at, c, n) for c in x.T])
            dq = scatter(w, gp[:, None] * r, OUT)
            np.add.at(dq, neg, gn.T @ r)
            db = np.bincount(w, gp, OUT)
            np.add.at(db, neg, gn.sum(0))
            du, dv = dr * C[0], dr * C[1]
            dR = scatter(np.concatenate((u, v)), np.concatenate((du, dv)), OUT + 1)
            dC = np.stack(((dr * ru).sum(0), (dr * rv).sum(0)))
            for p, s, g in zip(self.par, self.sums, (dR, dC, dq, db), strict=True):
                g = (g / 32).astype(np.float32)
                s += g * g
                p += RATE * g / np.sqrt(s)

    def log_z(self) -> np.ndarray:
        """The log normaliser of each of the contexts (u, v), by one matrix product for each u."""
        R, C, Q, b = self.par
        out = np.empty((OUT + 1, OUT + 1), np.float32)
        for u in range(OUT + 1):
            s = (R[u] * C[0] + R * C[1]) @ Q.T + b
            top = s.max(1)
            out[u] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return out

    def log_p(self, ids: np.ndarray, u: np.ndarray, v: np.ndarray, z: np.ndarray) -> np.ndarray:
        R, C, Q, b = self.par
        return ((R[u] * C[0] + R[v] * C[1]) * Q[ids]).sum(1) + b[ids] - z[u, v]


class Vocabulary:
    """The table of common words: sorted hashes, their training counts and which output each is."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, output: np.ndarray):
        self.hashes, self.counts, self.output = hashes, counts, output

    def find(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the output, the training count (-1: not in the table), and whether it is an output of its own."""
        if not len(self.hashes):
            return WORDS + t.cls, np.full(len(t.hash), -1), np.zeros(len(t.hash), bool)
        at = np.minimum(np.searchsorted(self.hashes, t.hash), len(self.hashes) - 1)
        there = self.hashes[at] == t.hash
        out = np.where(there, self.output[at], -1)
        return np.where(out >= 0, out, WORDS + t.cls), np.where(there, self.counts[at], -1), out >= 0

    @staticmethod
    def contexts(out: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The one and the two tokens before; OUT before a text begins."""
        before, two = np.empty_like(out), np.empty_like(out)
        before[1:], two[2:] = out[:-1], out[:-2]
        first = at[:-1]
        before[first], two[first] = OUT, OUT
        two[np.minimum(first + 1, len(out) - 1)[np.diff(at) > 1]] = OUT
        return before, two


def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h, n, m, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, back = np.unique(h, return_index=True, return_inverse=True)
    return keys, np.bincount(back, n).astype(np.int64), np.bincount(back, m).astype(np.int64), c[first]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"h": pa.array(x[0].view(np.int64)), "n": pa.array(x[1]), "m": pa.array(x[2]), "c": pa.array(x[3].astype(np.int32))})

    parts, held = [], 0
    for batch in passes(batches, "text"):
        t = Tokens(batch.column(0))
        train = ~batch.column(1).to_numpy(zero_copy_only=False)
        keys, first, back = np.unique(t.hash, return_index=True, return_inverse=True)
        parts.append((keys, np.bincount(back), np.bincount(back, np.repeat(train, np.diff(t.at))).astype(np.int64), t.cls[first]))
        held += len(keys)
        if held > 1_500_000:
            parts = [_merge(parts)]
            if (held := len(parts[0][0])) > 750_000:
                yield out(parts[0])
                parts, held = [], 0
    if parts:
        yield out(_merge(parts))


def _grade() -> Column:
    """Counts up to 4095 as they are, larger ones by 64 steps a doubling: a few thousand values whatever the corpus."""
    n = F.col("n")
    return F.when(n < 4096, n.cast("int")).otherwise((F.lit(4096 - 12 * 64) + F.floor(F.log2(n) * 64)).cast("int"))


def _least_grade(counts: DataFrame, most: int) -> int:
    """The least grade such that at most ``most`` words have it or a higher one."""
    found, least = 0, 1 << 30
    for r in sorted(counts.groupBy(_grade().alias("g")).count().collect(), reverse=True):
        found += r["count"]
        if found > most:
            break
        least = r.g
    return least


def score(docs: DataFrame, parts: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The net predicts the next of ``WORDS`` common words or ``CLASSES`` classes of other words from the two tokens
    before; within a class a word has its add-one share of the class's training counts, so the two together are a normalised
    model over words.  First weights come from about ``START_DOCS`` documents; then every task goes over all
    training tokens of its share of the corpus once, and the tasks' weights are averaged by tokens.  Counts are of all
    training documents.  Only the ``TABLE`` commonest words' counts are sent to the tasks; those of other words, each
    rare by comparison, are joined.

    Null texts count as empty: their one token is the end.  Repeated rows count and are scored each.  A null id counts
    as empty text for what is held out.  An empty table has no rows; further columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col, parts, held).alias("held_out"))
    counted = rows.select("text", "held_out").mapInArrow(lean(_count), "h long, n long, m long, c int")
    counts = written(counted.groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max("c").alias("c")), "counts")
    total, kinds = counts.agg(F.coalesce(F.sum("m"), F.lit(0)), F.count(F.when(F.col("m") > 0, 1))).first()
    top = counts.where(_grade() >= _least_grade(counts, TABLE)).toPandas().sort_values(["n", "h"], ascending=[False, True])
    own = top[top["m"] > 0].sort_values(["m", "h"], ascending=[False, True]).head(WORDS)
    output = {h: i for i, h in enumerate(own["h"])}
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    named = np.array([output.get(h, -1) for h in top["h"]], np.int64)
    vocab = Vocabulary(hashes[order], top["m"].to_numpy(np.int64)[order], named[order])
    size, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("c").agg(F.sum("m").alias("m"), F.count(F.when(F.col("m") > 0, 1)).alias("t")).collect():
        size[r.c], types[r.c] = r.m, r.t
    cls_of = dict(zip(top["h"], top["c"], strict=True))
    words = np.zeros(WORDS)
    for h, m, i in zip(own["h"], own["m"], range(WORDS), strict=False):
        words[i] = m
        size[cls_of[h]] -= m
        types[cls_of[h]] -= 1
    noise = np.concatenate((words, size)) + 0.5
    net = Net(noise / noise.sum())

    every = max(1, docs.count() // START_DOCS)
    start = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).orderBy(F.xxhash64("doc_id", F.lit(1))).limit(2 * START_DOCS).select("text").toArrow()
    if start.num_rows:
        t = Tokens(start.column(0).combine_chunks())
        ids = vocab.find(t)[0]
        u, v = Vocabulary.contexts(ids, t.at)
        rng = np.random.default_rng(5)
        for _ in range(START_EPOCHS):
            p = rng.permutation(len(ids))
            net.train(ids[p], u[p], v[p], rng)
    shared = spark.sparkContext.broadcast((vocab, net))

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, first = shared.value
        net, seen = Net(first.noise), 0
        net.par, net.sums = [p.copy() for p in first.par], [s.copy() for s in first.sums]
        rng = np.random.default_rng(23)
        for batch in passes(batches, "text"):
            t = Tokens(batch.column(0))
            ids = vocab.find(t)[0]
            u, v = Vocabulary.contexts(ids, t.at)
            p = rng.permutation(len(ids))
            net.train(ids[p], u[p], v[p], rng)
            seen += len(ids)
        if seen:
            flat = np.concatenate([p.ravel() for p in net.par]).astype(np.float64) * seen
            yield pa.RecordBatch.from_pydict({"grp": pa.array([TaskContext.get().partitionId() % 64]), "n": pa.array([seen]), "w": pa.array([flat.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        w = np.sum([np.frombuffer(x, np.float64) for x in table.column("w").to_pylist()], axis=0)
        return pa.table({"grp": table.column("grp")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "w": pa.array([w.tobytes()], pa.binary())})

    kind = "grp long, n long, w binary"
    got = rows.where(~F.col("held_out")).select("text").mapInArrow(lean(learn), kind).groupBy("grp").applyInArrow(lean_group(add), kind).collect()
    if got:
        flat, at = sum(np.frombuffer(r.w, np.float64) for r in sorted(got)) / sum(r.n for r in got), 0
        for i, p in enumerate(net.par):
            net.par[i] = flat[at : at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
    within = np.log10(size + types + 1)
    model = spark.sparkContext.broadcast((vocab, net, net.log_z(), within))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net, z, within = model.value
        for batch in passes(batches, "text"):
            t = Tokens(batch.column(1))
            ids, c, named = vocab.find(t)
            p = net.log_p(ids, *Vocabulary.contexts(ids, t.at), z).astype(np.float64) / np.log(10) - np.where(named, 0, within[np.maximum(ids - WORDS, 0)])
            logs = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1.0), 0)
            sums = lambda x: np.add.reduceat(x, t.at[:-1])  # noqa: E731  each text has a token at least
            rare = c < 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "held_out": batch.column(2), "n_tokens": pa.array(np.diff(t.at)), "known": pa.array(sums((c > 0).astype(np.int64))),
                "logs": pa.array(sums(logs)), "part": pa.array(sums(p + np.where(named, 0, logs))),
                "rare": arrays(t.hash[rare].view(np.int64), np.concatenate(([0], np.cumsum(sums(rare.astype(np.int64)))))),
            })

    kind = "doc_id long, held_out boolean, n_tokens long, known long, logs double, part double, rare array<long>"
    judged = rows.select("doc_id", "text", "held_out").mapInArrow(lean(judge), kind)
    judged = written(judged.withColumn("row", F.monotonically_increasing_id()), "judged")
    found = judged.select("row", F.explode("rare").alias("h")).join(counts.select("h", "m"), "h")
    found = found.groupBy("row").agg(F.sum(F.log10(F.col("m") + 1.0)).alias("more"), F.count(F.when(F.col("m") > 0, 1)).alias("also"))
    more = F.coalesce("more", F.lit(0.0))
    return judged.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))).alias("base_score"),
        (F.col("part") + more).alias("score"),
    )
