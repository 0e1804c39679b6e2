"""Suffix-array dedup of repeated byte strings, with a difference cover and one suffix bucket at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, let_go, passes, small_batches, written
from .flat import gram_hashes, mix, powers, texts
from .sieve import Sieve, sieve

#: Period of the difference cover: a bucket is sorted by this many bytes, longer ties by the sample's ranks.
PERIOD = 32
#: Suffixes that are sorted at a time, and text bytes of which one suffix array is made.
BUCKET, BLOCK = 1 << 17, 1 << 20
#: Text bytes that anchors are sought in at a time, whose arrays then fit a processor's cache, and bytes of a longer text's pieces,
#: for each of which a worker holds some hundred bytes of arrays.
PASS, PIECE = 1 << 18, 1 << 20
#: Bytes of the grams that tie places of texts together, and rows from which a gram's places are dealt by window.
GRAM, HOT = 32, 5000
#: Bytes of contexts and their columns that a task holds to look for equal ones among them.
HELD = 12 << 20
#: Low bits of a gram's hash that give way to its place, which is always in one piece or pass.
_PLACE = np.uint64((1 << 28) - 1)


@lru_cache
def difference_cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """Residues modulo ``v`` whose differences are all residues, and for each two residues a shift that puts both in it."""
    cover = [0]
    while len({(a - b) % v for a in cover for b in cover}) < v:
        have = {(a - b) % v for a in cover for b in cover}
        cover.append(max((x for x in range(v) if x not in cover), key=lambda x: len({(x - a) % v for a in cover} | {(a - x) % v for a in cover} | have)))
    inside = np.zeros(v, bool)
    inside[cover] = True
    a, b, s = np.ogrid[:v, :v, :v]
    return inside, (inside[(a + s) % v] & inside[(b + s) % v]).argmax(2)


def _keys(padded: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes at each place as rows of big-endian 64-bit numbers; ``size`` is a multiple of 8."""
    view = np.lib.stride_tricks.sliding_window_view(padded, size)[at]
    return np.ascontiguousarray(view).view(">u8").astype(np.uint64)


def _groups(order: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where, in sorted order, the key differs from the one before."""
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    return new


class SuffixSorter:
    """Sorts chosen suffixes of one block of bytes.

    The suffixes at the difference cover's places get ranks first, by doubling.  Then buckets of the suffixes
    asked for, cut by their first bytes so that each holds about ``bucket``, are sorted one at a time: by their
    first ``period`` bytes, and ties of that length by the ranks at the shift that puts both in the cover.
    Ranks go on until all differ: with ranks of so many bytes only, two ties could come out either way at different shifts.
    """

    def __init__(self, data: np.ndarray, period: int = PERIOD, bucket: int = BUCKET):
        self.n, self.v, self.bucket = len(data), period, bucket
        self.padded = np.concatenate((data, np.zeros(2 * period, np.uint8)))
        inside, self.shift = difference_cover(period)
        places = np.arange(self.n + period)
        sample = places[inside[places % period]]
        keys = _keys(self.padded, sample, period)
        end = np.minimum(self.n - sample, period)  # a suffix that ends comes before one that goes on with zeros
        cols = [end, *keys.T[::-1]]
        order = np.lexsort(cols)
        both = np.column_stack((keys, end.astype(np.int64).view(np.uint64)))
        rank = np.zeros(len(sample), np.int64)
        rank[order] = np.cumsum(_groups(order, both)) - 1
        where = np.full(self.n + 2 * period + 1, -1, np.int64)
        where[sample] = np.arange(len(sample))
        step = period
        while len(sample) and rank.max() < len(sample) - 1:
            ahead = np.minimum(sample + step, self.n + 2 * period)
            later = np.where(where[ahead] >= 0, rank[where[ahead]] + 1, 0)
            order = np.lexsort((later, rank))
            pair = np.column_stack((rank, later))
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(_groups(order, pair)) - 1
            step *= 2
        self.rank = np.full(self.n + 2 * period + 1, -1, np.int64)
        self.rank[sample] = rank

    def _less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        s = self.shift[i % self.v, j % self.v]
        return self.rank[i + s] < self.rank[j + s]

    def _ties(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sort within groups (runs of ``group``) by merging runs of 1, 2, 4, ... all over at once."""
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((start, [len(at)])))
        base, size = np.repeat(start, size), np.repeat(size, size)
        width = 1
        while width < size.max():
            here = np.arange(len(at)) - base
            run = here // width
            mate = base + (run ^ 1) * width
            low, high = np.minimum(mate, base + size), np.minimum(mate + width, base + size)
            first, odd = low.copy(), (run & 1).astype(bool)
            while (go := low < high).any():
                mid = (low + high) // 2
                m = np.where(go, mid, 0)
                before = np.where(odd, ~self._less(at, at[m]), self._less(at[m], at))  # equal ones: the left run first
                low, high = np.where(go & before, mid + 1, low), np.where(go & ~before, mid, high)
            place = base + np.minimum(run & ~1, run) * width + (here - run * width) + (low - first)
            out = np.empty_like(at)
            out[place] = at
            at, width = out, width * 2
        return at

    def buckets(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """The suffixes at ``starts`` in order, a bucket at a time."""
        head = (self.padded[starts].astype(np.int64) << 16) | (self.padded[starts + 1].astype(np.int64) << 8) | self.padded[starts + 2]
        heads = np.sort(head)
        low, done = 0, 0
        while done < len(heads):
            high = int(heads[min(done + self.bucket, len(heads)) - 1]) + 1  # a bucket ends where a head does
            own = starts[(head >= low) & (head < high)] if low or high <= heads[-1] else starts
            low, done = high, int(np.searchsorted(heads, high, "left"))
            keys = _keys(self.padded, own, self.v)
            order = np.lexsort(keys.T[::-1])
            group = np.cumsum(_groups(order, keys))
            own = own[order]
            size = np.bincount(group)
            tied = size[group] > 1
            if tied.any():
                own[tied] = self._ties(own[tied], group[tied])
            yield own


def suffix_array(data: bytes, period: int = PERIOD, bucket: int = BUCKET) -> np.ndarray:
    """All suffixes of ``data`` in order."""
    sorter = SuffixSorter(np.frombuffer(data, np.uint8), period, bucket)
    parts = list(sorter.buckets(np.arange(len(data))))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def repeats(data: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes at ``starts``, whether an equal one has a smaller ``rank``."""
    sorter = SuffixSorter(data)
    index = np.full(len(data) + 1, -1, np.int64)
    index[starts] = np.arange(len(starts))
    out = np.zeros(len(starts), bool)
    for own in sorter.buckets(starts):
        # Equal windows are neighbours in suffix order; compare neighbours in words of eight bytes.
        same = np.ones(len(own), bool)
        same[:1] = False
        for off in [*range(0, length - 8, 8), length - 8]:
            word = _keys(sorter.padded, own + off, 8)[:, 0]
            same[1:] &= word[1:] == word[:-1]
        group = np.cumsum(~same) - 1
        who = index[own]
        least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, rank[who])
        out[who] = rank[who] > least[group]
    return out


def anchors(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, gram hash, its place, first window, last window) for the runs of windows that share their least gram.

    Every window of ``length`` bytes within a document is tied to the leftmost least-hashed gram in it, which
    its bytes alone decide, so equal windows are tied to equal grams.
    """
    size = np.diff(starts)
    wide = length - gram + 1
    windows = np.maximum(size - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return (none := np.zeros(0, np.int64)), np.zeros(0, np.uint64), none, none, none
    h = gram_hashes(data, gram)
    # Least of `wide` neighbours by doubling. The high bits decide, the low ones hold the place, so the leftmost wins ties.
    least, width = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while width < wide:
        step = min(width, wide - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    where = (least & _PLACE).view(np.int64)
    doc = np.repeat(np.arange(len(size)), windows)
    first = np.repeat(starts[:-1] - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(total)
    pick = where[first]
    new = np.ones(total, bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], total) - 1
    return doc[at], h[pick[at]], pick[at], first[at], first[last]


def pieces(data: np.ndarray, starts: np.ndarray, length: int, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(number of the first document, bytes, where its documents start there, offset in the first) of pieces that hold each window once.

    Only texts that are longer than ``most`` bytes together are cut, document by document.
    """
    most = PIECE if most is None else most
    if len(data) <= most:
        yield 0, data, starts, 0
        return
    for d, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        for x in range(a, max(b - length + 1, a + 1), most):
            y = min(x + most + length - 1, b)
            yield d, data[x:y], np.array([0, y - x]), x - a


def _grams(length: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text", PASS):
            for _, data, starts, _ in pieces(*texts(batch.column(0)), length):
                h, times = np.unique(anchors(data, starts, length, gram)[1], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": pa.array(h.view(np.int64)), "times": pa.array(times.astype(np.int32))})

    return lean(run)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for size[0] numbers, then the same from first[1], and so on."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def _slices(size: np.ndarray, most: int) -> Iterator[slice]:
    """Cuts of rows so that each has ``most`` bytes in all, one row at least."""
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size[0] bytes of ``data`` from first[0] on, then size[1] from first[1], and so on; the index, eight times as large, is made in parts."""
    return np.concatenate([data[:0], *(data[_runs(first[s], size[s])] for s in _slices(size, BLOCK))])


def _digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of data[first:end]."""
    up, down = powers(len(data) + 1)
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        value = mix(np.arange(256, dtype=np.uint64) + np.uint64(salt)) | np.uint64(1)
        run = np.concatenate(([np.uint64(0)], np.cumsum(value[data] * up[:-1])))
        out.append(mix((run[end] - run[first]) * down[first] + (end - first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _binary(data: np.ndarray, sizes: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` bytes each; those not ``valid`` are null and have none in ``data``."""
    offsets = np.concatenate(([0], np.cumsum(np.where(valid, sizes, 0)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(offsets), pa.py_buffer(data)])


def _new(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(cols[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def _same(data: np.ndarray, at: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether contexts ``i`` and ``j``, of ``size`` bytes from ``at`` on, have the same bytes, pair by pair."""
    out = size[i] == size[j]
    todo = np.flatnonzero(out)
    for s in _slices(size[i[todo]], BLOCK):
        part = todo[s]
        n = size[i[part]]
        equal = data[_runs(at[i[part]], n)] == data[_runs(at[j[part]], n)]
        out[part] = np.logical_and.reduceat(equal, np.concatenate(([0], np.cumsum(n)[:-1])))
    return out


def _again(key: np.ndarray, d1: np.ndarray, d2: np.ndarray, doc: np.ndarray, row: np.ndarray, lo: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts sorted by key, digest, document, place and row: which have an earlier equal, and of the others one for each row.

    What digests call equal is compared byte by byte; a context whose bytes differ counts as one that has no equal yet.
    """
    first = _new(key, d1, d2)
    best = np.flatnonzero(first)[np.cumsum(first) - 1]
    again = (doc != doc[best]) | (lo != lo[best])
    new = ~again & _new(key, d1, d2, row)
    hit = np.flatnonzero(again)
    wrong = hit[~_same(data, at, size, hit, best[hit])]
    again[wrong], new[wrong] = False, True
    return again, new


def _places(length: int, gram: int, shared: Sieve, hot: Sieve):
    """From documents and sieves of the shared and the hot grams to (key, d1, d2, doc_id, row, lo, hi, at, bytes), ``at`` the gram's place in bytes: of equal contexts in a task the earliest has
    its bytes, as has each other row with the same doc_id and place; the others are repeats already, have none, and get a key of their own."""

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, d1, d2, doc, row, lo, hi, mid, size, data = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((row, lo, doc, d2, d1, key))
        first, again = np.zeros(len(key), bool), np.zeros(len(key), bool)
        begin = np.concatenate(([0], np.cumsum(size)[:-1]))
        again[order], first[order] = _again(*(x[order] for x in (key, d1, d2, doc, row, lo)), data, begin[order], size[order])
        data = data[np.repeat(first, size)]
        # Repeats that follow each other in a row are one span, so a periodic text or a copy takes few rows.
        rest = np.flatnonzero(again)
        rest = rest[np.lexsort((lo[rest], row[rest], doc[rest]))]
        start = np.ones(len(rest), bool)
        start[1:] = (doc[rest[1:]] != doc[rest[:-1]]) | (row[rest[1:]] != row[rest[:-1]]) | (lo[rest[1:]] > hi[rest[:-1]] + 1)
        start = np.flatnonzero(start)
        span = rest[start]
        last = np.maximum.reduceat(hi[rest], start) if len(start) else hi[span]
        spread = mix(doc[span].view(np.uint64) * np.uint64(31) + lo[span].astype(np.uint64)).view(np.int64)
        hi = np.concatenate((hi[first], last))
        key = np.concatenate((key[first], spread))
        d1, d2, doc, row, lo, mid, size = (np.concatenate((x[first], x[span])) for x in (d1, d2, doc, row, lo, mid, size))
        first = np.arange(len(key)) < len(key) - len(span)
        at = np.concatenate(([0], np.cumsum(np.where(first, size, 0))))
        for a in range(0, len(key), 20_000):
            b = min(len(key), a + 20_000)
            cols = [pa.array(x[a:b]) for x in (key, d1, d2, doc, row, lo, hi, mid)]
            yield pa.RecordBatch.from_arrays([*cols, _binary(data[at[a] : at[b]], size[a:b], first[a:b])], ["key", "d1", "d2", "doc_id", "row", "lo", "hi", "at", "bytes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in passes(batches, "text", PASS):
            ids, own_row = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            for d, data, starts, base in pieces(*texts(batch.column(1)), length):
                doc, h, at, lo, hi = anchors(data, starts, length, gram)
                if not len(h):
                    continue
                some = np.flatnonzero(shared.passes(h))
                often = hot.passes(h[some])
                pick, spread = some[~often], some[often]
                reps = hi[spread] - lo[spread] + 1
                single = _runs(lo[spread], reps)
                who = np.concatenate((doc[pick], np.repeat(doc[spread], reps)))
                first, last = np.concatenate((lo[pick], single)), np.concatenate((hi[pick], single))
                if not len(who):
                    continue
                d1, d2 = _digests(data, first, last + length)
                key = np.concatenate((h[pick].view(np.int64), d1[len(pick) :]))
                size = last - first + length
                mid = np.concatenate((at[pick] - lo[pick], np.full(len(single), -1)))
                place = base - starts[who]
                cols = (key, d1, d2, ids[who + d], own_row[who + d], first + place, last + place, mid, size)
                for s in _slices(size + 88, HELD):  # windows that go one by one may be a hundred times the text
                    held.append((*(x[s] for x in cols), _gather(data, first[s], size[s])))
                    weight += int(size[s].sum()) + 88 * len(size[s])
                    if weight >= HELD:
                        yield from emit(held)
                        held, weight = [], 0
        if held:
            yield from emit(held)

    return lean(run)


def _solve(size: np.ndarray, doc: np.ndarray, row: np.ndarray, lo: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Contexts end to end, to (doc_id, row, lo, hi) of runs of their windows that have an earlier equal among them."""
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    wins = size - length + 1
    starts, ctx = _runs(base, wins), np.repeat(np.arange(len(size)), wins)
    place = lo[ctx] + starts - base[ctx]
    order = np.lexsort((place, doc[ctx]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(_new(doc[ctx][order], place[order]))
    hit = np.flatnonzero(repeats(data, starts, rank, length))
    cut = np.flatnonzero(_new(hit - np.arange(len(hit)), ctx[hit]))
    a, b = hit[cut], hit[np.append(cut[1:], len(hit)) - 1] if len(hit) else hit[cut]
    return doc[ctx[a]], row[ctx[a]], place[a], place[b]


def _match(length: int, gram: int):
    """Rows sorted by key, digest, document, place and row, to (doc_id, row, lo, hi): windows lo to hi of a row have an earlier equal."""

    def known(table: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        key, d1, d2, doc, row, lo, hi, mid = (table.column(i).to_numpy(zero_copy_only=False) for i in range(8))
        sent = table.column(8).is_valid().to_numpy(zero_copy_only=False)
        yield doc[~sent], row[~sent], lo[~sent], hi[~sent]
        at = np.flatnonzero(sent)
        key, d1, d2, doc, row, lo, hi, mid = (x[at] for x in (key, d1, d2, doc, row, lo, hi, mid))
        if not len(at):
            return
        column = table.column(8)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data, begin, size = np.frombuffer(column.buffers()[2], np.uint8), offsets[at], np.diff(offsets)[at]
        again, first = _again(key, d1, d2, doc, row, lo, data, begin, size)
        yield doc[again], row[again], lo[again], hi[again]
        key, doc, row, lo, mid, begin, size = (x[first] for x in (key, doc, row, lo, mid, begin, size))
        many = lambda x: np.bincount(np.cumsum(x) - 1)[np.cumsum(x) - 1] > 1
        some = many(_new(key))
        key, doc, row, lo, mid, begin, size = (x[some] for x in (key, doc, row, lo, mid, begin, size))
        if not len(key):
            return
        data = _gather(data, begin, size)
        offsets = np.concatenate(([0], np.cumsum(size)))
        # A shared window holds the gram and as many more bytes to its right, or to its left, as half of what is left: contexts
        # that agree with no other of their gram in either are dropped.
        half = (length - gram) // 2
        near = mid < 0
        for a, b in ((mid, mid + gram + half), (mid - half, mid + gram)):
            able = np.flatnonzero((a >= 0) & (b <= size) & (mid >= 0))
            digest = _digests(data, offsets[able] + a[able], offsets[able] + b[able])[0] ^ key[able]
            order = np.argsort(digest, kind="stable")
            near[able[order[many(_new(digest[order]))]]] = True
        again = np.zeros(len(key), bool)
        again[np.flatnonzero(near)] = many(_new(key[near]))
        if not again.any():
            return
        data, key, doc, row, lo, size = _gather(data, offsets[:-1][again], size[again]), key[again], doc[again], row[again], lo[again], size[again]
        offsets = np.concatenate(([0], np.cumsum(size)))
        edges = np.append(np.flatnonzero(_new(key)), len(key))
        a = 0
        while a < len(edges) - 1:
            b = max(a + 1, int(np.searchsorted(offsets[edges], offsets[edges[a]] + BLOCK, "right")) - 1)
            x, y = edges[a], edges[b]
            yield _solve(size[x:y], doc[x:y], row[x:y], lo[x:y], data[offsets[x] : offsets[y]], length)
            a = b

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for batch in table.combine_chunks().to_batches():
                cols = [np.concatenate(x) for x in zip(*known(batch), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "row", "lo", "hi"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 30_000:
                continue
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
            if cut:
                yield from done(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
            held, n = rest.to_batches(), 0 if cut else -rest.num_rows
        if held:
            yield from done(pa.Table.from_batches(held))

    return lean(run)


def _cut(length: int, whole_chars: bool, carry: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                gone = np.zeros(len(raw) + 1, np.int64)
                for s in spans or []:
                    gone[s["lo"]] += 1
                    gone[s["hi"] + length] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                data = np.frombuffer(raw, np.uint8)
                if whole_chars and gone.any():
                    lead = np.flatnonzero((data & 0xC0) != 0x80)
                    full = np.minimum.reduceat(gone.astype(np.uint8), lead).astype(bool)
                    gone = np.repeat(full, np.diff(np.append(lead, len(raw))))
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                kept = data[~gone].tobytes()
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            made = {c: pa.array(v, t) for c, v, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)}
            if whole_chars:
                made["kept"] = made["kept"].cast(pa.string())
            else:
                del made["kept"]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | made | {c: batch.column(3 + i) for i, c in enumerate(carry)})

    return lean(run)


def repeated_bytes(docs: DataFrame, length: int = 100, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of ``length`` bytes that also starts earlier: in a smaller doc_id, or earlier
    in the same document.  With ``keep_text`` only characters all of whose bytes are covered go, and the text that is left
    comes as ``kept``.  Columns named in ``carry`` come along.

    1. Each window of ``length`` bytes is tied to its least-hashed gram; grams seen once cannot lie in a repeated window
       and are dropped after a count with map-side sums.
    2. Texts are read again with a sieve of the grams that are shared, of bounded size; the few others that pass meet nothing in step 3.  Of runs of windows around such grams (contexts) that are equal as a whole, byte by byte, each
       task keeps one, the earliest; the others are repeats already.  Windows of grams with over ``hot`` places go one by one, by
       their digest, so no key holds more than tasks have distinct contents.
    3. Contexts of one gram meet in a task and are read in order.  Equal ones again leave but one.  Blocks of the rest go through the
       suffix sorter, where equal windows are neighbours; all but the earliest are repeats.
    4. Rows get their repeated windows and are cut.

    Rows are told apart by a hash of doc_id and text, so neither null nor repeated ids gather anywhere; the id serves for order.
    Null texts count as empty; empty texts have nothing to remove.  Rows that repeat a doc_id count as the same document: equal starts
    are not earlier; each is cut where its own text repeats.  A null id is less than any other.  Long texts are worked on
    in pieces.  An empty table has no rows; columns that are not named play no part.
    """
    if gram >= length or length - gram > 200 or length < 16:
        raise ValueError("gram must be shorter than length, by 200 at most, and length 16 at least")
    small_batches(docs.sparkSession)
    null = -(1 << 63)
    own_id, text = F.coalesce(F.col(id_col).cast("long"), F.lit(null)), F.coalesce(F.col(text_col), F.lit(""))
    more = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    texts_of = docs.select(own_id.alias("doc_id"), text.alias("text"), F.xxhash64(own_id, text).alias("row"), *more)
    rows = texts_of.select("doc_id", "text", "row")
    grams = rows.select("text").mapInArrow(_grams(length, gram), "gram long, times int")
    shared = written(grams.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1"), "grams")
    let_go(docs.sparkSession)
    of = [sieve(x.select("gram")) for x in (shared, shared.where(F.col("n") > hot))]
    places = rows.mapInArrow(_places(length, gram, *of), "key long, d1 long, d2 long, doc_id long, row long, lo long, hi long, at long, bytes binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = places.repartition(parts, "key").sortWithinPartitions("key", "d1", "d2", "doc_id", "lo", "row")
    # Rows that are equal in id and text have equal spans, so the first to come of each may stand for all.
    spans = met.mapInArrow(_match(length, gram), "doc_id long, row long, lo long, hi long").repartition("row").groupBy("row", F.col("doc_id").alias("of")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if keep_text else "")
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    # The ids' comparison is not an equality, which would be a key of the join: spans are dealt by row alone already.
    same = F.col("doc_id").bitwiseXOR(F.col("of")) == 0
    out = texts_of.join(spans.withColumnRenamed("row", "_row"), (F.col("row") == F.col("_row")) & same, "left").select("doc_id", "text", "spans", *(f"_carry{i}" for i in range(len(carry))))
    out = out.mapInArrow(_cut(length, keep_text, list(carry)), schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(null)))
