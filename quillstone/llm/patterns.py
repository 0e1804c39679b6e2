"""Best-fit packing by length patterns: a non-negative least-squares fit to the histogram of lengths, dealt to the pieces by rank."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, written
from .packing import id_encoder, proven

#: Patterns that are offered to the fit for each length there is, share of a sequence that one may waste, and steps of the fit at most.
OFFERED, SPARE, STEPS = 6, 0.002, 3000

Pattern = tuple[tuple[int, int], ...]  # (length, how often) by descending length


def offered(h: np.ndarray) -> list[Pattern]:
    """Patterns of one to three documents, or of one or two and copies of a shorter length, those first that waste least of a sequence.

    ``h`` counts the pieces of each length up to that of a sequence.
    """
    size, have = len(h) - 1, np.flatnonzero(h[1:]) + 1
    if not len(have):
        return []
    under = np.zeros(size + 1, np.int64)  # the greatest length in stock up to each room
    under[have] = have
    under = np.maximum.accumulate(under)
    i, j = np.tril_indices(len(have))
    a, b = np.concatenate((have, have[i])), np.concatenate((np.zeros(len(have), np.int64), have[j]))
    a, b = a[a + b <= size], b[a + b <= size]
    room, least = size - a - b, np.where(b > 0, b, a)
    rows = [(a, b, np.zeros_like(a), np.zeros_like(a))]
    for m in (1, 2, 3, 4, 6, 8, 12, 16):  # as many copies of the greatest length that goes in so often
        c = np.minimum(under[room // m], least)
        rows.append((a, b, c, np.where(c > 0, room // np.maximum(c, 1), 0)))
    a, b, c, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    waste = size - a - b - c * n
    fits = (h[a] >= 1 + (b == a) + n * (c == a)) & (h[b] >= (b > 0) * (1 + (b == a)) + n * (c == b)) & ((c == 0) | (h[c] >= n))
    ok = np.flatnonzero(fits & (waste <= SPARE * size))
    more = (b > 0) + n > 1
    ok = ok[np.lexsort((np.random.default_rng(7).random(len(ok)), more[ok], waste[ok], a[ok]))]  # for each first piece the best-filled ones, pairs before others, then in no order
    turn = np.arange(len(ok)) - np.searchsorted(a[ok], a[ok])
    order = ok[np.lexsort((-a[ok], turn))]  # one for each first piece in turn
    found: dict[Pattern, None] = {}
    for k in order:
        counts: dict[int, int] = {}
        for length, times in ((a[k], 1), (b[k], int(b[k] > 0)), (c[k], n[k])):
            if times:
                counts[int(length)] = counts.get(int(length), 0) + int(times)
        found.setdefault(tuple(sorted(counts.items(), reverse=True)))
        if len(found) == OFFERED * len(have):
            break
    return list(found)


def fit(h: np.ndarray, columns: list[Pattern]) -> np.ndarray:
    """How often to use each pattern so that the lengths used up differ least, by squares, from ``h``; no number is negative.

    Accelerated projected gradients, begun anew where a step goes uphill.  A pattern has few lengths, so a step costs little more than a pass over them.
    """
    if not columns:
        return np.zeros(0)
    at = np.repeat(np.arange(len(columns)), [len(p) for p in columns])
    row = np.array([length for p in columns for length, _ in p])
    # A long piece left over costs more than a short one, and one of a rare length more than one of many.
    weight = (np.arange(len(h)) / (len(h) - 1)) ** 0.5 / np.sqrt(np.maximum(h, 1.0))
    value, goal = weight[row] * np.array([k for p in columns for _, k in p]), weight * h
    scale = 1 / np.sqrt(np.bincount(at, value**2, len(columns)))  # all columns alike in length
    value = value * scale[at]
    used = lambda x: np.bincount(row, value * x[at], len(h))
    back = lambda y: np.bincount(at, value * y[row], len(columns))
    v = np.ones(len(columns))
    for _ in range(30):  # the largest curvature, by powers
        v = back(used(v / np.linalg.norm(v)))
    step = 0.95 / np.linalg.norm(v)
    x = ahead = np.zeros(len(columns))
    speed = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, ahead - step * back(used(ahead) - goal))
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        if ((ahead - new) @ (new - x)) > 0:
            ahead, speed = new, 1.0
        else:
            ahead, speed = new + (speed - 1) / faster * (new - x), faster
        if np.abs(new - x).max() <= 1e-7 * np.abs(new).max():
            x = new
            break
        x = new
    return x * scale


def best_fill(h: np.ndarray, room: int) -> Pattern:
    """Pieces in stock that together fill ``room`` as far as any can, long ones first: subset sums as the bits of one number."""
    lengths = [int(v) for v in np.flatnonzero(h) if 0 < v <= room][::-1]
    mask, sums, seen = (1 << room + 1) - 1, 1, []
    for v in lengths:
        seen.append(sums)
        n, k = int(min(h[v], room // v)), 1
        while n:  # copies in doubling numbers reach each count up to n
            k = min(k, n)
            sums |= sums << k * v & mask
            n -= k
            k *= 2
        if sums >> room & 1:
            break
    total, picked = sums.bit_length() - 1, []
    for v, before in zip(lengths[: len(seen)][::-1], seen[::-1], strict=True):
        n = 0
        while not before >> total & 1:
            total -= v
            n += 1
        if n:
            picked.append((v, n))
    return tuple(picked[::-1])


def plan(h: np.ndarray) -> list[tuple[Pattern, int]]:
    """(pattern, how many sequences) that use up exactly the pieces counted in ``h``.

    The work depends on the number of lengths, not on that of pieces: the fit is rounded as far as the stock allows, and for what it leaves, the longest
    piece in stock gets the fill that is best, as often as the stock allows, until nothing is left.
    """
    left, out = h.astype(np.int64).copy(), []
    left[0] = 0

    def use(pattern: Pattern, most: int) -> None:
        n = min(most, *(int(left[v]) // k for v, k in pattern))
        if n > 0:
            out.append((pattern, n))
            for v, k in pattern:
                left[v] -= n * k

    columns = offered(left)
    times = fit(left.astype(float), columns)
    for j in sorted(range(len(columns)), key=lambda j: (-columns[j][0][0], -times[j])):
        use(columns[j], int(times[j] + 0.5))
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        pattern = dict(best_fill(left, len(h) - 1 - longest))
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        use(tuple(sorted(pattern.items(), reverse=True)), 1 << 62)
    return out


def _ranges(h: np.ndarray) -> np.ndarray:
    """Columns length, first rank, copies in a sequence, first sequence, offset there: the pieces of each length in turn, by length and rank."""
    rows, used, sequence = [], np.zeros(len(h), np.int64), 0
    for pattern, n in plan(h):
        offset = 0
        for v, k in pattern:
            rows.append((v, used[v], k, sequence, offset))
            used[v] += n * k
            offset += v * k
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_patterns(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", added: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenised where they are read, ``end_id`` closes each; those of more than ``size`` tokens are cut into pieces of ``size``,
    of which the first may be shorter.  Each task numbers its pieces of a length as it reads them, and one row for each
    task and length makes ranks of these numbers.  The driver gets the histogram, ``size`` rows at most, and plans
    from it alone how often each pattern of lengths is used; the plan says for each length which ranks go to which sequences.  So no
    group of documents is ever packed in one place, and all pieces of one length may be a third of the table.

    ``added``: whether a special token's text gets its id, as by the ``tokenizers`` library's default (see ``id_encoder``).

    Null and empty texts are one end token.  Repeated rows and rows without ids are packed each.  Which of several pieces of one length
    goes where follows the order of reading; it is fixed once the pieces are written.  An empty table has no pieces; further columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fast = proven(path)

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = id_encoder(path, added, fast), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            who, piece, start, length, crc, place = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode([text or ""])[0].astype("<u4"), np.uint32(end_id))
                head = len(ids) % size or size
                for i, (a, b) in enumerate(zip([0, *range(head, len(ids), size)], range(head, len(ids) + 1, size), strict=True)):
                    who.append(doc)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b]))
                    place.append(seen[b - a])
                    seen[b - a] += 1
            longs = (pa.array(v, pa.int64()) for v in (who, start, length, crc, place))
            yield pa.RecordBatch.from_arrays([*longs, pa.array(piece, pa.int32()), pa.array(np.full(len(who), part), pa.int32())], ["doc_id", "start", "length", "ids_crc32", "place", "piece", "part"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = written(source.mapInArrow(lean(pieces), "doc_id long, start long, length long, ids_crc32 long, place long, piece int, part int"), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    h = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        h[r.length] = r.n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    shared = spark.sparkContext.broadcast(_ranges(h))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        bounds = np.searchsorted(ranges[:, 0], np.arange(size + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy() for c in (3, 5))
            at = np.zeros(len(rank), np.int64)
            for v in np.unique(length):
                own = length == v
                at[own] = bounds[v] + np.searchsorted(ranges[bounds[v] : bounds[v + 1], 1], rank[own], "right") - 1
            _, first, copies, sequence, offset = ranges[at].T
            turn = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + turn // copies), pa.array(offset + turn % copies * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(firsts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(lean(placed), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
