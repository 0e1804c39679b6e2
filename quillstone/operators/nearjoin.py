"""Exact joins by cosine: rows meet only where a bound on their distance lets them be near enough."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from ..ship import ship

#: Rows of a cell at least, cells at most, and rows of a cell that one task holds.
CELL, CELLS, BLOCK = 2048, 64, 65_536
#: Rows that cells are cut by, directions they are cut along, and rows compared in one piece.
SAMPLE, AXES, LEAF = 4096, 8, 512
#: What rounding may do to a distance, and to a cosine in single precision.
SLACK, SINGLE = 1e-7, 1e-5


def unit_rows(column: pa.Array, n: int) -> np.ndarray:
    """Lists of equal length as rows of unit length; zero stays zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(n, len(x) // max(n, 1))
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _flat(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows along ``axes`` and the length of what is left of them: no two rows are nearer to each other than these are."""
    along = np.einsum("ij,jk->ik", x, axes)
    return np.column_stack((along, np.sqrt(np.maximum(0, (x * x).sum(1) - (along * along).sum(1)))))


def _cut(flat: np.ndarray, leaf: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of rows by boxes (rows, from, below) that together fill space, halved at medians down to ``leaf`` rows where rows differ."""
    boxes, todo = [], [(np.arange(len(flat)), np.full(flat.shape[1], -np.inf), np.full(flat.shape[1], np.inf))]
    while todo:
        rows, low, high = todo.pop()
        part = flat[rows]
        axis = int(part.std(0).argmax()) if len(rows) else 0
        at = np.median(part[:, axis]) if len(rows) else 0.0
        under = part[:, axis] < at
        if len(rows) <= leaf or not under.any():
            boxes.append((rows, low, high))
            continue
        to, since = high.copy(), low.copy()
        to[axis] = since[axis] = at
        todo += [(rows[under], low, to), (rows[~under], since, high)]
    return boxes


def _far(flat: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squares of distances of rows to boxes."""
    out = np.zeros((len(flat), len(low)))
    for axis in range(flat.shape[1]):
        x = flat[:, axis, None]
        gap = np.maximum(0, np.maximum(low[:, axis] - x, x - high[:, axis]))
        out += gap * gap
    return out


def _typed(vectors: DataFrame) -> DataFrame:
    """(id, v) without zero vectors, components as they were given: whole numbers and floats in four bytes."""
    small = vectors.schema["v"].dataType.elementType.simpleString() in ("float", "int", "smallint", "tinyint")
    return vectors.where(F.exists("v", lambda x: x != 0)).select("id", F.col("v").cast("array<float>" if small else "array<double>").alias("v"))


def _space(rows: DataFrame, n: int, cell: int):
    """Axes and boxes of cells, shared with all tasks; from some rows, ``SAMPLE`` or so: which ones changes the work, never the result."""
    share = int(min(1.0, 2 * SAMPLE / max(n, 1)) * 1e6) + 1
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(share)).orderBy(F.xxhash64("id", F.lit(1))).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    if not len(picked):
        picked = rows.orderBy(F.xxhash64("id", F.lit(1))).limit(1).select("v").toArrow().column(0).combine_chunks()
    x = unit_rows(picked, len(picked))
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:AXES].T if len(x) > 1 else np.zeros((x.shape[1], 0))
    flat = _flat(x, axes)
    boxes = _cut(flat, -(-len(x) // max(1, min(CELLS, -(-n // cell)))))
    return axes, np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])


def _deal(rows: DataFrame, space, r: float, both: bool) -> DataFrame:
    """(cell, own, id, v): each row in its cell (``own``), and as a guest in cells within ``r``.

    For a join of rows with themselves (``both``) only in one of each two cells, by the parity of their numbers, so that work spreads;
    otherwise rows marked ``asks`` are guests only, in all cells within reach, and the others are only at home.
    """
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(space)
    kind, vector = rows.schema["id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, low, high = shared.value
        numbers = np.arange(len(low))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                flat = _flat(unit_rows(part.column(1), part.num_rows), axes)
                home = np.ones((len(flat), len(low)), bool)
                for axis in range(flat.shape[1]):
                    x = flat[:, axis, None]
                    home &= (low[:, axis] <= x) & (x < high[:, axis])
                home = home.argmax(1)
                near = _far(flat, low, high) <= (r + SLACK) ** 2
                mine = home[:, None] == numbers
                if both:
                    near = mine | near & (((home[:, None] + numbers) % 2 == 0) == (numbers < home[:, None]))
                else:
                    asks = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                    near = np.where(asks, near | mine, mine)
                row, cell = np.nonzero(near)
                own = mine[row, cell] if both else ~asks[row, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(own), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["cell", "own", "id", "v"])

    return rows.mapInArrow(run, f"cell int, own boolean, id {kind}, v {vector}")


def dealt(vectors: DataFrame, threshold: float, cell: int = CELL) -> DataFrame:
    """(cell, own, id, v): where each row is compared.

    With cosines of ``threshold`` or more, rows of unit length are within ``r = sqrt(2 - 2 threshold)`` of each other, and so are they along some
    axes with the length of what these leave.  That space is cut into cells, ``CELLS`` at most, so a row is copied that often at most at any size.
    """
    rows = _typed(vectors)
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).alias("cell"), F.lit(True).alias("own"), "id", "v")
    return _deal(rows, _space(rows, n, cell), _radius(threshold), True)


def _radius(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)))


def candidates(groups: DataFrame) -> DataFrame:
    """(cell, pairs) that may be compared of what ``dealt`` gives."""
    sums = groups.groupBy("cell").agg(F.count_if("own").alias("o"), F.count_if(~F.col("own")).alias("g"))
    return sums.select("cell", F.expr("o * (o - 1) div 2 + o * g").alias("pairs"))


class _Cell:
    """Rows of a cell that others are held against, in leaves with their bounds."""

    def __init__(self, ids: pa.Array, v: pa.Array, axes: np.ndarray):
        self.ids, n = ids, len(ids)
        raw = v.flatten().to_numpy(zero_copy_only=False)
        self.raw = raw.reshape(n, -1)
        self.leaves = []
        self.size = np.empty(n)
        self.single = np.empty(self.raw.shape, np.float32)
        flat = np.empty((n, axes.shape[1] + 1))
        for at in range(0, n, 4096):
            x, self.size[at : at + 4096], self.single[at : at + 4096] = _unit(self.raw[at : at + 4096])
            flat[at : at + 4096] = _flat(x, axes)
        self.leaves = [b[0] for b in _cut(flat, LEAF)]
        self.low, self.high = (np.array([f(flat[rows], 0) for rows in self.leaves]) for f in (np.min, np.max))

    def near(self, raw: np.ndarray, axes: np.ndarray, r: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place among ``raw``, place here, cosine) of all within reach, a leaf at a time."""
        x, size, single = _unit(raw)
        reach = _far(_flat(x, axes), self.low, self.high) <= (r + SLACK) ** 2
        for leaf, rows in enumerate(self.leaves):
            some = np.flatnonzero(reach[:, leaf])
            if not len(some):
                continue
            p, q = np.nonzero(single[some] @ self.single[rows].T >= threshold - SINGLE)
            for at in range(0, len(p), 16_384):
                a, b = some[p[at : at + 16_384]], rows[q[at : at + 16_384]]
                score = np.einsum("ij,ij->i", raw[a].astype(np.float64), self.raw[b].astype(np.float64)) / (size[a] * self.size[b])
                good = score >= threshold
                yield a[good], b[good], score[good]


def _unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = raw.astype(np.float64)
    size = np.sqrt((x * x).sum(1))
    x /= size[:, None]
    return x, size, x.astype(np.float32)


def _compare(groups: DataFrame, space, threshold: float, block: int, best: bool) -> DataFrame:
    """(x, y, similarity) of rows that meet in ``groups``: guest and own one, of all pairs or of each guest's nearest (``best``).

    A cell's own rows come first to its task, ``block`` of them or so; the others pass by in batches.
    """
    sizes = {r.cell: -(-r.n // block) for r in groups.where("own").groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), F.col("cell")), F.lit(1)) if sizes else F.lit(1)
    # an own row is held in its part and passes by those before it, or by none if only guests are compared
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    first = mine if best else F.lit(0)
    to = F.explode(F.when(F.col("own"), F.sequence(first, mine)).otherwise(F.sequence(F.lit(0), parts - 1)))
    rows = groups.select("cell", to.alias("part"), "own", "id", "v").withColumn("held", F.col("own") & (F.col("part") == mine)).select("cell", "part", "held", "id", "v")
    tasks = 2 * max(1, sum(sizes.values()))
    rows = rows.repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", F.desc("held"))
    shared, r = groups.sparkSession.sparkContext.broadcast(space[0]), _radius(threshold)
    kind = groups.schema["id"].dataType.simpleString()

    def out(x: pa.Array, p: np.ndarray, held: _Cell, q: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x.take(pa.array(p)), held.ids.take(pa.array(q)), pa.array(s, pa.float64())], ["x", "y", "similarity"])

    def met(held: _Cell, ids: pa.Array, raw: np.ndarray, axes: np.ndarray, since: int | None) -> Iterator[pa.RecordBatch]:
        """Of guests, or of held rows from place ``since`` with those after them."""
        found = [(p, q, s) for p, q, s in held.near(raw, axes, r, threshold) if len(p)] if best else held.near(raw, axes, r, threshold)
        if best:
            if found:
                p, q, s = (np.concatenate(c) for c in zip(*found, strict=True))
                names = held.ids.to_numpy(zero_copy_only=False)
                order = np.lexsort((names[q], -np.round(s, 12), p))
                p, q, s = p[order], q[order], s[order]
                top = np.concatenate(([True], p[1:] != p[:-1]))
                yield out(ids, p[top], held, q[top], s[top])
            return
        for p, q, s in found:
            keep = np.ones(len(p), bool) if since is None else p + since < q
            if keep.any():
                yield out(ids, p[keep], held, q[keep], s[keep])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, key, waiting, held = shared.value, None, [], None

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            if waiting:
                held = _Cell(pa.concat_arrays([w[0] for w in waiting]), pa.concat_arrays([w[1] for w in waiting]), axes)
                waiting = []
                if not best:
                    for at in range(0, len(held.ids), 1024):
                        yield from met(held, held.ids.slice(at, 1024), held.raw[at : at + 1024], axes, at)

        for batch in batches:
            cell, part, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 2))
            edge = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (own[1:] != own[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(cell)], strict=True):
                if a == b:
                    continue
                if key != (cell[a], part[a]):
                    yield from ready()
                    key, held = (cell[a], part[a]), None
                some = batch.slice(a, b - a)
                if own[a]:
                    waiting.append((some.column(3), some.column(4)))
                    continue
                yield from ready()
                for at in range(0, b - a, 1024) if held is not None else ():
                    piece = some.slice(at, 1024)
                    raw = piece.column(4).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                    yield from met(held, piece.column(3), raw, axes, None)
        yield from ready()

    return rows.mapInArrow(run, f"x {kind}, y {kind}, similarity double")


def near_pairs(vectors: DataFrame, threshold: float, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) for a < b of all pairs of rows (id, v) with a cosine of ``threshold`` (above 0) or more.

    Rows meet in the cells of ``dealt``.  A cell of more than ``block`` rows is cut into parts by a hash, each a task's; other rows pass by
    in batches, held against leaves that may reach them.  Zero vectors are near nothing; ids are unique; an empty table gives no pairs.
    What is shuffled grows as the rows while cells are of one part; products grow as the pairs that the bound leaves, a square of the rows in the end.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less rules nothing out")
    rows = kept(_typed(vectors), "vectors")
    n = rows.count()
    if not n:
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity"))
    space = _space(rows, n, cell)
    found = _compare(_deal(rows, space, _radius(threshold), True), space, threshold, block, False)
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity").where("a < b")


def nearest(asks: DataFrame, vectors: DataFrame, threshold: float, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(x, y, similarity): for each row of ``asks`` (id, v) the row of ``vectors`` (id, v) of highest cosine (to 12 places), the smallest id of equal ones, where it reaches ``threshold`` (above 0)."""
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less rules nothing out")
    rows = kept(_typed(vectors).withColumn("asks", F.lit(False)).unionByName(_typed(asks).withColumn("asks", F.lit(True))), "vectors")
    n = rows.where("NOT asks").count()
    if not n:
        return rows.limit(0).select(F.col("id").alias("x"), F.col("id").alias("y"), F.lit(0.0).alias("similarity"))
    space = _space(rows.where("NOT asks").select("id", "v"), n, cell)
    found = _compare(_deal(rows.select("id", "v", "asks"), space, _radius(threshold), False), space, threshold, block, True)
    return found.groupBy("x").agg(F.min(F.struct((-F.round("similarity", 12)).alias("s"), "y", "similarity")).alias("b")).select("x", F.col("b.y").alias("y"), F.col("b.similarity").alias("similarity"))
