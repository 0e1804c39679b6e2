"""Byte-level BPE by a rank queue, and its inverse."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, small_batches

#: Pre-tokens whose ids a worker remembers before it starts anew, and the longest that it remembers.
MEMO, MEMO_CHARS = 600_000, 40
#: The bits of a word of the queue's bitmaps.
_BITS = [1 << i for i in range(256)]


class Bpe:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.split = regex.compile(pattern).findall
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.words = [0] * ((max(self.ranks.values()) >> 8) + 1)
        self.memo: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the pair of lowest rank, of those the leftmost, until none is left.

        The queue holds a bucket of places for each rank.  A bitmap of the buckets in use lies in words of 256 bits, under one
        more bitmap of the words in use, so the next rank is two find-first-set steps away.  Places are nodes of
        a linked list; an entry whose node has another pair by now is stale and skipped.  Time is n log n in the
        length of the pre-token, and the steps are written out here as most pre-tokens are short.
        """
        get, bits = self.ranks.get, _BITS
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before, pair = list(range(1, n + 2)), list(range(-1, n)), [-1] * (n + 1)
        words, buckets, top = self.words, {}, 0
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                pair[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # in order, so a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    words[word] |= bits[rank & 255]
                    top |= bits[word]
        while top:
            word = (top & -top).bit_length() - 1
            map_ = words[word]
            low = map_ & -map_
            rank = (word << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                words[word] = map_ = map_ ^ low
                if not map_:
                    top ^= bits[word]
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = pair[i] = -1
            before[end] = i
            left = before[i]
            if end < n and (rank := get(piece[i : after[end]])) is not None:
                pair[i] = rank
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    word = rank >> 8
                    words[word] |= bits[rank & 255]
                    top |= bits[word]
            if left >= 0:
                if (rank := get(piece[left:end])) is not None:
                    pair[left] = rank
                    if rank in buckets:
                        heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        word = rank >> 8
                        words[word] |= bits[rank & 255]
                        top |= bits[word]
                else:
                    pair[left] = -1
        ids, i = [], 0
        while i < n:
            ids.append(get(piece[i : after[i]]))
            i = after[i]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, parts = self.memo, self.split(text)
        try:
            return b"".join([memo[x] for x in parts])
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for x in parts:
            ids = memo.get(x)
            if ids is None:
                ids = array("I", self.merge(x.encode())).tobytes()
                if len(x) <= MEMO_CHARS:
                    memo[x] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


_loaded: dict[tuple[str, str], Bpe] = {}


def bpe(path: str, pattern: str) -> Bpe:
    """One encoder a worker process and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids as binary if ``keep_ids``).

    A narrow map: no shuffle, one text at a time in memory.  Null and empty texts have no tokens; repeated rows
    are encoded each; an empty table has no rows, further columns play no part; ``path`` must be readable on the executors, as an installed package's file is.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for batch in batches:
            n, a, b, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())} | ({"ids": pa.array(kept, pa.binary())} if keep_ids else {}))

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)
