"""Phrase collocations: frequent word sequences found level by level with hashed buckets, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, small_batches, written
from .flat import Words, mix, texts

#: Words of a phrase at most, occurrences at least, phrases listed for each language.
LONGEST, LEAST, LISTED = 5, 100, 2000
#: Buckets: about one for so many bytes of text, a power of two within these bounds; the bitmap that is sent to all tasks has an eighth of a byte each.
BYTES_A_BUCKET, FEWEST, MOST = 32, 1 << 18, 1 << 27
#: Buckets of a block of counters, bytes of text counted at a time, counted phrases that a task holds before it hands them on.
BLOCK, WINDOW, HELD = 1 << 16, 1 << 21, 200_000
#: Languages whose numbers of words are sent to every task; more are met by a join.
SENT_LANGS = 10_000

_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP, _SALT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)


def lang_seed(lang: str) -> np.uint64:
    """A hash of a language's name, mixed into the hashes of its phrases."""
    return _text_hashes(pa.array([lang]))[0]


def _text_hashes(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, by its bytes."""
    data, starts = texts(column)
    sizes = np.diff(starts)
    out = np.full(len(sizes), mix(np.array([1], np.uint64))[0])
    some = np.flatnonzero(sizes)
    whole = Words.__new__(Words)  # each string is one "word", whatever it holds
    whole.data, whole.begin, whole.end = data, starts[some], starts[some] + sizes[some]
    out[some] = whole.hashes()
    return out


def chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix(before * _STEP + word)


def windows(text: np.ndarray, size: int = WINDOW, carry: int = LONGEST - 1) -> Iterator[tuple[np.ndarray, int]]:
    """(bytes, n) of a text's parts of about ``size`` bytes: each ends between words and begins with the last words of the one before, ``carry`` at most, that take ``n`` bytes."""
    at, kept = 0, np.zeros(0, np.uint8)
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text):
            gap = np.flatnonzero(_GAPS[text[end : end + size]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(end + size, len(text))
        part = np.concatenate((kept, text[at:end])) if len(kept) else text[at:end]
        yield part, len(kept)
        if end < len(text):
            inside = ~_GAPS[part]
            first = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
            kept = part[first[-carry] :] if len(first) >= carry else part
        at = end


class Counted:
    """The words of a window with exact numbers, and for one level after the other the places where a phrase of so many words starts."""

    def __init__(self, part: np.ndarray, skip: int, seed: np.uint64):
        inside = ~_GAPS[part]
        edge = np.concatenate(([False], inside, [False]))
        self.begin, self.end = np.flatnonzero(~edge[:-1] & edge[1:]), np.flatnonzero(edge[:-1] & ~edge[1:])
        self.piece = np.cumsum(_BREAKS[part], dtype=np.int32)[self.begin] if len(self.begin) else np.zeros(0, np.int32)
        self.fresh = int(np.searchsorted(self.begin, skip))  # words before were counted with the window before
        bounds = np.concatenate(([0], np.cumsum(self.end - self.begin))).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(part[inside]))])
        coded = words.dictionary_encode()
        self.ids, self.names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        self.word = _text_hashes(self.names)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        self.seed = seed

    def starts(self, k: int) -> np.ndarray:
        """Where k words of one piece start, of which the last was not counted before."""
        n = len(self.ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        one = self.piece[k - 1 :] == self.piece[:n]
        one[: max(0, self.fresh - k + 1)] = False
        return np.flatnonzero(one)

    def hashes(self, k: int) -> np.ndarray:
        """The hash of the k words from each place on."""
        h = mix(self.word ^ self.seed)
        for j in range(1, k):
            h = chain(h[: len(h) - 1], self.word[j:])
        return h

    def tally(self, at: np.ndarray, h: np.ndarray, k: int) -> pa.Table:
        """(phrase, h, n) of the phrases of k words that start at ``at``; ``h`` has their hashes.

        Equal hashes bring equal phrases together; the words' numbers decide what is equal.
        """
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        new = np.ones(len(at), bool)
        np.not_equal(h[1:], h[:-1], out=new[1:])
        words = np.stack([self.ids[at + j] for j in range(k)])
        if ((words[:, 1:] != words[:, :-1]).any(0) & ~new[1:]).any():  # unlike phrases of one hash
            order = np.lexsort((*words, h))
            at, h, words = at[order], h[order], words[:, order]
            new[1:] = (words[:, 1:] != words[:, :-1]).any(0)
        first = np.flatnonzero(new)
        named = [self.names.take(pa.array(words[j, first])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*named, pa.scalar(b" ", pa.large_binary())) if k > 1 else named[0]
        return pa.table({"phrase": phrase.cast(pa.binary()), "h": pa.array(h[first].view(np.int64)), "n": pa.array(np.diff(np.append(first, len(at))))})


def bits_set(bitmap: np.ndarray, h: np.ndarray, buckets: int) -> np.ndarray:
    """Whether the bucket of each hash is set."""
    b = h & np.uint64(buckets - 1)
    return (bitmap[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bucket(h: np.ndarray) -> np.ndarray:
    """The hash of a phrase as a candidate; its bucket among the frequent phrases is another."""
    return mix(h ^ _SALT)


def _sparse(counts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, places, counts) of the blocks of counters that are not all zero."""
    for b in range(-(-len(counts) // BLOCK)):
        own = counts[b * BLOCK : (b + 1) * BLOCK]
        at = np.flatnonzero(own)
        if len(at):
            yield b, at.astype("<u2").tobytes(), own[at].tobytes()


def _bitmap(blocks: DataFrame, buckets: int, least: int) -> np.ndarray:
    """One bit a bucket: whether its counters (block, places, counts) sum up to ``least``.

    Tasks merge the blocks dealt to them one row after the other and hold a byte a bucket; the driver gets the bits, ``buckets`` / 8 bytes.
    """

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(b, np.zeros(BLOCK, np.uint8))
                at = np.frombuffer(places, "<u2")
                own[at] = np.minimum(own[at].astype(np.int32) + np.frombuffer(counts, np.uint8), least)
        for b, own in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(own >= least, bitorder="little").tobytes()])})

    out = np.zeros(max(buckets, BLOCK) // 8, np.uint8)
    for r in blocks.repartition("block").mapInArrow(lean(merged), "block int, bits binary").toLocalIterator():
        out[r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _frequent_bits(spark: SparkSession, frequent: DataFrame, buckets: int) -> np.ndarray:
    """The bitmap of the buckets that hold a frequent phrase."""

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(buckets, bool)
        for batch in batches:
            on[batch.column(0).to_numpy().view(np.uint64) & np.uint64(buckets - 1)] = True
        for b, places, counts in _sparse(on.view(np.uint8)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "places": pa.array([places], pa.binary()), "counts": pa.array([counts], pa.binary())})

    return _bitmap(frequent.select("h").mapInArrow(lean(marked), "block int, places binary, counts binary"), buckets, 1)


def _level(docs: DataFrame, k: int, last: int, least: int, buckets: int, known: np.ndarray | None, likely: np.ndarray | None) -> DataFrame:
    """One pass: counts (lang, phrase, h, n) of phrases of ``k`` words that may be frequent, and counters (block, places, counts) of the buckets of those of one word more.

    A phrase is counted if its bucket is full (``likely``) and both its shorter phrases are frequent (``known``): no frequent one is missed, and
    what is counted in vain falls to the exact count.  Of the next level only phrases whose both parts are counted here go to buckets.
    Counters stop at ``least``, which leaves the test for that many right when they are summed up.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, likely))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, likely = shared.value
        counters = np.zeros(buckets, np.uint8) if k < last else None
        held: dict[str, list[pa.Table]] = {}
        rows = 0

        def merge() -> None:
            for lang, tables in held.items():
                if len(tables) > 1:
                    held[lang] = [pa.concat_tables(tables).group_by(["phrase", "h"]).aggregate([("n", "sum")]).rename_columns(["phrase", "h", "n"])]

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, tables in held.items():
                for batch in tables[0].combine_chunks().to_batches(max_chunksize=20_000):
                    nothing = pa.nulls(batch.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * batch.num_rows, pa.string()), batch.column(0).cast(pa.string()), batch.column(1), batch.column(2), pa.nulls(batch.num_rows, pa.int32()), nothing, nothing],
                        ["lang", "phrase", "h", "n", "block", "places", "counts"],
                    )
            held.clear()

        for batch in batches:
            names = batch.column(0)
            for lang in pc.unique(names).to_pylist():
                own = batch.column(1).cast(pa.large_binary()).filter(pc.equal(names, lang))
                data, starts = texts(own)
                joined = np.full(len(data) + len(own), 0x0A, np.uint8)  # a line break between two texts
                joined[np.arange(len(data)) + np.repeat(np.arange(len(own)), np.diff(starts))] = _LOWER[data]
                seed = lang_seed(lang)
                for part, skip in windows(joined):
                    w = Counted(part, skip, seed)
                    at = w.starts(k)
                    h = w.hashes(k)
                    if k > 1:
                        at = at[bits_set(likely, _bucket(h[at]), buckets)]
                        shorter = w.hashes(k - 1)
                        at = at[bits_set(known, shorter[at], buckets) & bits_set(known, shorter[at + 1], buckets)]
                    if len(at):
                        found = w.tally(at, h[at], k)
                        held.setdefault(lang, []).append(found)
                        rows += len(found)
                    if k < last and len(at):
                        some = np.zeros(len(w.ids) + 1, bool)
                        some[at] = True
                        if skip:  # the phrase before a fresh word may have been counted with the window before
                            some[: w.fresh] = True
                        nxt = w.starts(k + 1)
                        nxt = nxt[some[nxt] & some[nxt + 1]]
                        b, n = np.unique(_bucket(w.hashes(k + 1)[nxt]) & np.uint64(buckets - 1), return_counts=True)
                        counters[b] = np.minimum(counters[b] + n, least)
                    if rows > HELD:
                        merge()
                        rows = sum(len(t[0]) for t in held.values())
                        if rows > HELD // 2:
                            yield from flush()
                            rows = 0
        merge()
        yield from flush()
        if counters is not None:
            for b, places, counts in _sparse(counters):
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.nulls(1, pa.string()), "phrase": pa.nulls(1, pa.string()), "h": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int64()),
                    "block": pa.array([b], pa.int32()), "places": pa.array([places], pa.binary()), "counts": pa.array([counts], pa.binary()),
                })

    return docs.mapInArrow(lean(run), "lang string, phrase string, h long, n long, block int, places binary, counts binary")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, k, f) of all phrases of 1 to ``longest`` words with f >= ``least``, (lang, n) with all words).

    One pass over the texts a length.  See ``collocations``.  ``least`` may be 1 to 255.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = min(MOST, max(FEWEST, 1 << (size // BYTES_A_BUCKET).bit_length()))
    known = likely = total = None
    levels = []
    for k in range(1, longest + 1):
        got = written(_level(rows, k, longest, least, buckets, known, likely), f"level{k}")
        counts = got.where("block IS NULL").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("f"))
        if k == 1:
            counts = written(counts, "words")
            total = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        level = written(counts.where(F.col("f") >= least), f"frequent{k}")
        levels.append(level.select("lang", "phrase", F.lit(k).alias("k"), "f"))
        if k < longest:
            likely = _bitmap(got.where("block IS NOT NULL").select("block", "places", "counts"), buckets, least)
            known = _frequent_bits(spark, level, buckets)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, total


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = LISTED, cover: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Per language its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score, by score and a descending, then phrase by bytes.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and these at blanks and tabs into words.  a, l and r count the phrase, and its
    first and second part at the cut of lowest score floor(1000 a n / (l r)), ties to the shorter first part; n counts the language's words.
    A phrase goes if some longer one that holds it occurs at least ``cover`` % as often.

    Lengths are mined in turn.  Each pass counts the phrases that the pass before leaves possible, and sums those of one word more in hashed
    buckets; buckets of ``least`` and phrases of ``least`` become bitmaps of a fixed size, which are all that is sent to the next pass.
    Tasks merge their counts before Spark sums them up by the phrase itself, so counts are exact.  Scores are joins of the
    frequent phrases with their parts in 38-digit whole numbers (1000 a n stays below 10**38 up to 10**17 words).

    Null texts count as empty, null languages as ``und``.  Repeated rows count each.  Texts of any length are counted in windows that hand on
    their last words.  An empty table gives no rows; further columns play no part.
    """
    found, total = frequent_phrases(docs, longest, least, lang_col, text_col)
    words = F.split("phrase", " ")
    many = found.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda i: F.array_join(F.slice("w", i, s), " "))))
    longer = many.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    own = many.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < cover * F.col("a"), F.lit(True))).drop("_longer")
    cuts = own.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    few = total.limit(SENT_LANGS + 1).count() <= SENT_LANGS
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(total) if few else total, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over = ((F.col("a") * 1000).cast("decimal(19,0)") * wide("n")).cast("decimal(38,0)")
    cuts = cuts.withColumn("over", over).withColumn("under", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.l", "m.r", "m.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return worst.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
     grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM words, range(1, 6) AS t(k) WHERE len(w) >= k),
     f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k),
     n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
     c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
     inner_ AS (SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 5) AS t(s), range(1, 5) AS u(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL),
     own AS (SELECT c.* FROM c LEFT JOIN inner_ USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, true)),
     cuts AS (SELECT own.lang, own.phrase, a, j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS score
              FROM own JOIN range(1, 5) AS t(j) ON j < own.k JOIN n ON n.lang = own.lang
              JOIN f AS l ON l.lang = own.lang AND l.phrase = array_to_string(w[1 : j], ' ') JOIN f AS r ON r.lang = own.lang AND r.phrase = array_to_string(w[j + 1 : own.k], ' ')),
     worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
     placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM placed WHERE rank <= 2000
"""
