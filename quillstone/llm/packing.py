"""Cost-balanced packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, lean_group, release, small_batches, written

#: Documents that one packing group gets on average; a group is packed in one task's memory.
GROUP_DOCS = 8192
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512

_loaded: dict[tuple[str, bool, bool], object] = {}
_proven: dict[str, bool] = {}
#: Code points that are compared one by one: all planes with scripts, marks, numerals and symbols, but for the ranges that Unicode itself
#: defines as wholes (ideographs, Hangul syllables, surrogates, private use), of which the ends are compared.
_RANGES = ((0x0, 0x3401), (0x4DBF, 0x4E01), (0x9FFF, 0xAC01), (0xD7A3, 0xD800), (0xE000, 0xE001), (0xF8FF, 0x17001), (0x187F7, 0x1FC00), (0xE0000, 0xE0200))


def _unicode_bytes() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable bytes as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _stand_in(path: str):
    """tiktoken with the vocabulary of the ``tokenizers`` file at ``path``; None if that is no plain byte-level BPE whose merges go by id."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    back, added = _unicode_bytes(), {x["content"] for x in spec.get("added_tokens", [])}
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or any(c not in back for t in model["vocab"] if t not in added for c in t):
        return None
    ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return tiktoken.Encoding("from-json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def proven(path: str) -> bool:
    """Whether tiktoken may stand in for the file's own library: asked once a driver.

    Merges must go by id.  Then both must give the same ids for each token of the vocabulary and for the code points of
    ``_RANGES``, between letters, digits, blanks and marks, so that each one's class shows.
    """
    if path not in _proven:
        from tokenizers import Tokenizer

        own, coder = Tokenizer.from_file(path), _stand_in(path)
        if coder is None:
            _proven[path] = False
        else:
            tokens = (coder.decode_single_token_bytes(i).decode("utf-8", "ignore") for i in sorted(coder._mergeable_ranks.values()))
            points = ("".join(f"a{c}a1{c}1 {c} .{c}." for c in map(chr, range(i, min(i + 64, b)))) for a, b in _RANGES for i in range(a, b, 64))
            _proven[path] = all(own.encode(t, add_special_tokens=False).ids == coder.encode_ordinary(t) for t in (*tokens, *points))
            del own, coder
            release()
    return _proven[path]


def id_encoder(path: str, added: bool = False, fast: bool = False):
    """texts -> list of id arrays, equal to the ``tokenizers`` file at ``path`` with ``add_special_tokens=False``.

    With ``added`` the text of a special token gets that token's id, as that library does by default; else it is ordinary text.

    That library is several times slower than tiktoken on whole texts.  With ``fast`` (see ``proven``) tiktoken gets the file's vocabulary;
    texts that hold an added token, and texts that tiktoken fails on, go to the file's own library.
    """
    if (path, added, fast) in _loaded:
        return _loaded[path, added, fast]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    if not added:
        own.encode_special_tokens = True
    slow = lambda texts: [np.array(e.ids, np.uint32) for e in own.encode_batch(texts, add_special_tokens=False)]
    pick = slow
    if fast:
        coder = _stand_in(path)
        apart = [t.content for t in own.get_added_tokens_decoder().values() if added or not t.special]

        def one(text: str) -> np.ndarray:
            if not any(x in text for x in apart):
                try:
                    return coder.encode_to_numpy(text, disallowed_special=())
                except ValueError:  # its pattern gives up on runs of about a million blanks
                    pass
            return slow([text])[0]

        pick = lambda texts: [one(t) for t in texts]
    _loaded[path, added, fast] = pick
    return pick


class Packer:
    """One group: pieces go to the open sequence of lowest attention cost that has room.

    ``add`` takes items by descending length.  Where no open sequence has room for a whole item, it is cut: the
    cheapest open sequence is filled and the rest goes on.  The number of sequences is the least that holds
    all tokens, so only the last tokens of a group are padding.
    """

    def __init__(self, total: int, size: int):
        n = -(-total // size)
        self.room, self.cost, self.used = np.full(n, size, np.int64), np.zeros(n), np.zeros(n, np.int64)
        if n and total % size:
            self.room[-1] = total % size

    def add(self, length: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset there, tokens) of each piece the item is cut into."""
        while length:
            fits = self.room >= length
            if not fits.any():
                fits = self.room > 0
            at = int(np.argmin(np.where(fits, self.cost, np.inf)))
            take = int(min(length, self.room[at]))
            yield at, int(self.used[at]), take
            self.room[at] -= take
            self.used[at] += take
            self.cost[at] += LINEAR * take + QUADRATIC * take * take
            length -= take


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_docs: int = GROUP_DOCS, added: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenised where they are read, ``end_id`` closes each.  Whole blocks of ``size`` tokens
    are sequences of their own; what is left of each document is written, and dealt by input partition and place there to groups of about
    ``group_docs`` documents, so that neither null ids nor rows that repeat meet in one group.  A group stays within one task's memory however
    large the table is, and costs at most one padded sequence.  ``sequence_id`` is the group's number times 2**32 plus the sequence's number there.

    ``added``: whether a special token's text gets its id, as by the ``tokenizers`` library's default (see ``id_encoder``).

    Null and empty texts are one end token.  Repeated rows are packed each.  Ties in length go by doc_id,
    then ids.  An empty table has no pieces; further columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    groups, fast = max(1, -(-docs.count() // group_docs)), proven(path)

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = id_encoder(path, added, fast), TaskContext.get().partitionId(), 0
        for batch in batches:
            n, whole, tail = [], [], []
            for ids in encode([t or "" for t in batch.column(1).to_pylist()]):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                cut = len(ids) // size * size
                n.append(len(ids))
                whole.append([zlib.crc32(ids[i : i + size]) for i in range(0, cut, size)])
                tail.append(ids[cut:].tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "doc_tokens": pa.array(n, pa.int64()), "whole": pa.array(whole, pa.list_(pa.int64())), "tail": pa.array(tail, pa.binary()), "part": pa.array(np.full(len(n), part), pa.int32()), "place": pa.array(np.arange(seen, seen + len(n)))})
            seen += batch.num_rows

    def packed(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        docs, n, whole, tail = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "whole", "tail"))
        order = sorted(range(len(docs)), key=lambda i: (-len(tail[i]), docs[i] is None, docs[i] or 0, tail[i]))
        packer, rows, fresh = Packer(sum(map(len, tail)) // 4, size), [], 0
        fresh = len(packer.room)
        for i in order:
            for j, crc in enumerate(whole[i]):
                rows.append((docs[i], j * size, size, crc, n[i], (group << 32) + fresh, 0))
                fresh += 1
            start, view = len(whole[i]) * size, memoryview(tail[i])
            first = start
            for at, offset, length in packer.add(len(view) // 4):
                rows.append((docs[i], start, length, zlib.crc32(view[(start - first) * 4 : (start - first + length) * 4]), n[i], (group << 32) + at, offset))
                start += length
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), zip(*rows, strict=True) if rows else [[]] * 7, strict=True)})

    schema = "doc_id long, doc_tokens long, whole array<long>, tail binary, part int, place long"
    # Written before they are dealt: a task that runs again may read its rows in another order.
    dealt = written(docs.select(id_col, text_col).mapInArrow(lean(tokens), schema), "tails")
    dealt = dealt.select("doc_id", "doc_tokens", "whole", "tail", F.pmod(F.xxhash64("place", "part"), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInArrow(lean_group(packed), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
