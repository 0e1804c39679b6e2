"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt, lean, lean_group, passes, small_batches, written
from .flat import Words, arrays, mix, shingle_sets, texts
from .graph import components
from .sieve import Sieve, sieve

#: Bins of the one permutation and bins of a band; a pair at similarity 0.8 meets in no band with odds of 5e-8.
BINS, BAND = 128, 4
#: Shingles and documents of about so many are in a block; of what is left last, blocks are compared with blocks.
BLOCK, BLOCK_DOCS = 200_000, 2000
#: Shingles that are columns of a block's matrix at a time, and its rows that are compared at a time.
COLUMNS, ROWS = 4096, 256
#: Rows of a bucket that are dealt to one key; keys of over one in so many rows are met where those rows are read.
SALTED, HOT = 1000, 2000

_bin = np.arange(BINS, dtype=np.uint64)


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``BINS`` minima for each set that is not empty.

    A hash's high bits choose its bin, so one hash a shingle serves all bins.  An empty bin takes the value of
    the first full one in a random order of its own that is the same for all sets (optimal densification).
    """
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    bins = (sets >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(sets), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (doc[1:] != doc[:-1])  # sets are sorted: a bin's first is its least
    sig, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    sig[doc[first], bins[first]], full[doc[first], bins[first]] = sets[first], True
    d, b = np.nonzero(~full & (np.diff(bounds) > 0)[:, None])
    t = 0
    while len(d):
        t += 1
        at = (mix(_bin * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)) >> np.uint64(57)).astype(np.int64)[b]
        hit = full[d, at]
        sig[d[hit], b[hit]] = sig[d[hit], at[hit]]
        d, b = d[~hit], b[~hit]
    return sig


def _equal(sets: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """128 bits of a cryptographic hash of each whole set: what has the same is the same set."""
    raw, at = sets.astype("<u8").tobytes(), (bounds * 8).tolist()
    both = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)), "<i8")
    return [pa.array(both[0::2]), pa.array(both[1::2])]


def _sign(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "text"):
            sets, bounds = shingle_sets(Words(*texts(batch.column(1))), k)
            sizes = np.diff(bounds)
            sig = signatures(sets, bounds).reshape(len(sizes), BINS // BAND, BAND)
            bands = np.broadcast_to(mix(np.arange(BINS // BAND, dtype=np.uint64) + np.uint64(11)), sig.shape[:2]).copy()
            for j in range(BAND):
                bands = mix(bands * np.uint64(0xD6E8FEB86659FD93) + sig[:, :, j])
            some = sizes > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes), *_equal(sets, bounds), arrays(bands[some].view(np.int64).ravel(), np.concatenate(([0], np.cumsum(some * (BINS // BAND)))))],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return lean(run)


def _sets(k: int, tied: Sieve):
    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            yield batch.filter(pa.array(tied.passes(batch.column(0).to_numpy())))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(some(batches), "text"):
            sets, bounds = shingle_sets(Words(*texts(batch.column(1))), k)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *_equal(sets, bounds), arrays(sets.view(np.int64), bounds)], ["doc_id", "k1", "k2", "set"])

    return lean(run)


def _meet(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key and how many of the ``total`` rows have it as ``size``.

    Rows of hot keys, of which there are no more than ``HOT``, meet a broadcast copy and are not shuffled.
    """
    least = max(2, -(-total // HOT))
    hot = F.broadcast(keyed.where(F.col("size") >= least))
    cold = keyed.where(F.col("size") < least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(dealt(cold), key)).drop("size")


def _with_bucket(entries: DataFrame, **of: Column) -> DataFrame:
    """``entries`` (band, salt, cuts, ...) with aggregates ``of`` each its whole bucket, which comes once for each salt."""
    buckets = entries.groupBy("band").agg(F.max("cuts").alias("_cuts"), *(c.alias(n) for n, c in of.items()))
    return entries.join(dealt(buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts")), ["band", "salt"])


def _salted(entries: DataFrame, size: Column) -> DataFrame:
    """``entries`` with cuts, how many keys the rows of a bucket of ``size`` are dealt to, and salt, which of them is a row's."""
    cuts = F.ceil(size / F.lit(SALTED)).cast("int")
    return entries.withColumn("cuts", cuts).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("cuts")).cast("int"))


def _linked(num: int, den: int):
    """A pair of blocks (doc_id, comp, block, set) to links (a, b) that join components, no more than needed for that."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, comp, block = (table.column(c).to_numpy() for c in ("doc_id", "comp", "block"))
        lists = table.column("set").combine_chunks()
        size = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(doc)), size)
        value, back, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        del value
        name = np.cumsum(count > 1) - 1
        row, col = row[count[back] > 1], name[back[count[back] > 1]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both = np.zeros((len(doc), len(doc)), np.float32)
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            x, y = np.searchsorted(col, (c, c + COLUMNS))
            part = np.zeros((len(doc), COLUMNS), np.float32)
            part[row[x:y], col[x:y] - c] = 1
            both += part @ part.T
        _, part_of = np.unique(comp, return_inverse=True)
        parent = np.arange(part_of.max() + 1)  # of each component, whose it has become

        def root(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return int(x)

        a, b = [], []
        for at in range(0, len(doc), ROWS):
            rows = slice(at, at + ROWS)
            near = both[rows] * den >= (size[rows, None] + size[None, :] - both[rows]) * num
            near &= np.not_equal.outer(part_of[rows], part_of)
            if block.min() != block.max():
                near &= np.not_equal.outer(block[rows], block)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            p, q = part_of[at + i], part_of[j]
            _, first = np.unique(np.minimum(p, q) * len(parent) + np.maximum(p, q), return_index=True)
            for x in first.tolist():  # one link for two components, as long as they are two
                p, q = root(part_of[at + i[x]]), root(part_of[j[x]])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(int(doc[at + i[x]]))
                    b.append(int(doc[j[x]]))
            part_of = np.array([root(x) for x in range(len(parent))])[part_of]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return lean_group(run)


def blockwise(entries: DataFrame, sets: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) across components among the documents of ``entries`` (band, salt, cuts, doc_id, n, comp).

    Documents that buckets tie together are dealt by hash to blocks of about ``block`` shingles and no more than about
    ``BLOCK_DOCS`` documents; each two blocks of a tie are one task's matrix product.  A document's set is sent once for each block
    of its own tie: rows are fewer than pairs by the block's size, and no task holds more than two blocks, but for a tie of many blocks
    bytes and work grow with the square of the tie.
    """
    ties = components(_with_bucket(entries, a=F.min("doc_id")).select("a", F.col("doc_id").alias("b")))
    own = entries.select("doc_id", "n", "comp").distinct().join(dealt(ties.select(F.col("node").alias("doc_id"), F.col("comp").alias("tie"))), "doc_id")
    own = written(own, "own")
    blocks = own.groupBy("tie").agg(F.ceil(F.greatest(F.sum("n") / F.lit(block), F.count("*") / F.lit(BLOCK_DOCS))).cast("int").alias("blocks"))
    held = own.join(dealt(blocks), "tie").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("doc_id", "comp", "tie", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    sets = sets.where(sieve(own.select("doc_id")).column("doc_id"))
    return held.join(dealt(sets), "doc_id").groupBy("tie", "i", "j").applyInArrow(_linked(num, den), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when ``den * |A and B| >= num * |A or B|`` for their sets of distinct ``shingle``-word
    shingles.

    1. Documents with equal sets are one node, told by a cryptographic hash of the whole set.
    2. The nodes of a band's bucket are candidates, tied to the bucket's smallest as a star; each node is compared with the
       least of its buckets' centres on the full sets, so first pairs are no more than nodes.
    3. Only buckets that hold documents of different components are looked at again.  There the shingles that
       no other such document has bound every similarity; documents that the bound rules out are dropped.
    4. What is still apart is met by its rarest shingles: of two sets that are similar enough, the first few in order of frequency
       cannot be all different (prefix filter), so documents that share none of those are no pair.  In these
       buckets each is compared with another pivot, and last blocks are compared with blocks.  So no link within a bucket that
       would join components is lost and no row is made for a pair.

    Rows of hot buckets are dealt to salts, those of hot keys meet broadcast rows.  Texts, sets and bands that meet nothing are kept from
    shuffles by sieves of bounded size.  Nothing else is broadcast, whatever the session's threshold.

    Null texts count as empty; documents without words have no shingles and no links.  A null id is linked with nothing and
    has a null component_id.  Rows that repeat an id are documents of their own, each linked by its own text; with equal sets they are one.
    An empty table has no rows; further columns play no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(rows.mapInArrow(_sign(shingle), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "signed")
    nodes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    nodes = written(nodes.select("k1", "k2", F.col("r.doc_id").alias("rep"), F.col("r.doc_id").alias("node"), F.col("r.n_shingles").alias("n"), "r.bands"), "nodes")
    clash = bool(nodes.groupBy("rep").count().where("count > 1").limit(1).count())
    if clash:  # an id stands first in two sets: nodes get numbers in the order of the ids
        nodes = written(nodes.orderBy("rep", "k1", "k2").withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select(F.col("node").alias("doc_id"), "n", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    shared = written(shared, "shared")
    entries = entries.where(sieve(shared.select("band")).column("band"))
    entries = _meet(entries, shared.withColumn("rows", F.col("size")), "band", nodes.count() * (BINS // BAND))
    entries = written(_salted(entries, F.col("rows")).select("band", "salt", "cuts", "doc_id", "n").distinct(), "entries")
    tied = entries.select(F.col("doc_id").alias("node")).distinct()
    if clash:
        tied = tied.join(dealt(nodes), "node").select("node", "k1", "k2", F.col("rep").alias("doc_id"))
    else:
        tied = tied.withColumnRenamed("node", "doc_id")
    tied = written(tied, "tied")
    # Texts are not shuffled to find those of tied documents; what else passes the sieve goes as sets are joined.
    sets = rows.mapInArrow(_sets(shingle, sieve(tied.select("doc_id").distinct())), "doc_id long, k1 long, k2 long, set array<long>")
    if clash:
        sets = sets.join(dealt(tied), ["doc_id", "k1", "k2"]).select(F.col("node").alias("doc_id"), "set")
    else:
        sets = sets.select("doc_id", "set").join(dealt(tied), "doc_id", "left_semi")
    sets = written(sets.dropDuplicates(["doc_id"]), "sets")

    def possible(na: Column, ka: Column, nb: Column, kb: Column) -> Column:
        """Whether sets of na and nb, of which no more than ka and kb are shared with anything, may be similar enough."""
        most = F.least(ka, kb)
        return most * F.lit(den) >= (na + nb - most) * F.lit(num)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough on full sets; a centre with many pairs comes once for each of its salts."""
        pairs = written(pairs.distinct(), "pairs")
        own = sets.where(sieve(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()).column("doc_id"))
        cuts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SALTED)).cast("int").alias("cuts"))
        centres = cuts.join(dealt(own.select(F.col("doc_id").alias("a"), F.col("set").alias("sa"))), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        salted = pairs.join(dealt(cuts), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int")).drop("cuts")
        right = salted.join(dealt(own.select(F.col("doc_id").alias("b"), F.col("set").alias("sb"))), "b")
        full = right.join(dealt(centres), ["a", "salt"])
        both = F.size(F.array_intersect("sa", "sb"))
        return full.where(both * F.lit(den) >= (F.size("sa") + F.size("sb") - both) * F.lit(num)).select("a", "b").distinct()

    def star(entries: DataFrame, by: Column, apart: Column) -> DataFrame:
        pairs = _with_bucket(entries, p=F.min(F.struct(by.alias("by"), "doc_id", "n", "core", "comp")))
        pairs = pairs.where(apart & possible(F.col("n"), F.col("core"), F.col("p.n"), F.col("p.core")))
        return pairs.groupBy(F.col("doc_id").alias("b")).agg(F.min("p").alias("p")).select(F.col("p.doc_id").alias("a"), "b")

    def mixed(entries: DataFrame) -> DataFrame:
        """The entries of the buckets that hold more than one component."""
        return _with_bucket(entries, least=F.min("comp"), most=F.max("comp")).where("least < most").drop("least", "most")

    def shared_shingles(entries: DataFrame) -> DataFrame:
        """(doc_id, s, df): the shingles of the documents of ``entries`` that more than one of them has, and how many have it.

        A few other documents may pass the sieve and count too: shingles are then held for shared that are not, and no bound gets too tight.
        """
        own = written(sets.where(sieve(entries.select("doc_id").distinct()).column("doc_id")), "own")
        total = own.agg(F.sum(F.size("set"))).first()[0] or 0
        own = own.select("doc_id", F.explode("set").alias("s"))
        common = written(own.groupBy("s").agg(F.count("*").alias("size")).where("size > 1"), "common")
        return _meet(own, common.withColumn("df", F.col("size")), "s", total)

    def cored(entries: DataFrame) -> DataFrame:
        """Counts how many of each document's shingles any other document of the entries has too.

        No intersection is larger, so a document of which that is too small a part can have no link left and goes.
        """
        core = shared_shingles(entries).groupBy("doc_id").agg(F.count("*").alias("core"))
        return entries.drop("core").join(dealt(core), "doc_id").where(F.col("core") * F.lit(den) >= F.col("n") * F.lit(num))

    def rarest(entries: DataFrame) -> DataFrame:
        """The documents of ``entries`` once more, in buckets of their rarest shingles: those that a similar set cannot lack all of."""
        found = shared_shingles(entries)
        in_order = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("s"))
        of = entries.select("doc_id", "n", "comp").distinct().join(dealt(in_order), "doc_id").withColumn("core", F.size("s").cast("long"))
        # Shingles of one document alone come first of all and meet nothing.
        first = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)) + 1 - (F.col("n") - F.col("core"))
        of = of.where(first > 0).withColumn("s", F.explode(F.slice("s", F.lit(1), first.cast("int"))))
        return _salted(of.withColumn("band", F.col("s.s")), F.col("s.df")).drop("s")

    def settled(entries: DataFrame) -> DataFrame:
        own = entries.drop("comp").join(dealt(comp.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
        return written(mixed(own), "left")

    own_share = F.round(1 - F.col("core") / F.col("n"), 3)  # least for the document most others are nearest to
    apart = F.col("comp") != F.col("p.comp")
    whole = entries.withColumn("comp", F.lit(0)).withColumn("core", F.col("n"))
    links = written(confirmed(star(whole, F.col("doc_id"), F.col("doc_id") != F.col("p.doc_id"))), "confirmed")
    comp = components(links)
    left = settled(whole)
    if left.limit(1).count():
        left = written(mixed(written(cored(left), "cored")), "left")
    if left.limit(1).count():
        left = written(mixed(rarest(left)), "rarest")
        more = written(confirmed(star(left, own_share, apart)), "confirmed")
        if more.limit(1).count():
            links = links.unionByName(more)
            comp = components(links)
            left = settled(left)
    if left.limit(1).count():
        rest = written(blockwise(left, sets, num, den), "confirmed")
        if rest.limit(1).count():
            comp = components(links.unionByName(rest))
    comp = nodes.join(dealt(comp), "node", "left").select("k1", "k2", "rep", F.coalesce("comp", "node").alias("comp"))
    comp = comp.join(dealt(nodes.select(F.col("node").alias("comp"), F.col("rep").alias("component_id"))), "comp") if clash else comp.withColumnRenamed("comp", "component_id")
    linked = signed.join(dealt(comp.select("k1", "k2", "component_id")), ["k1", "k2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return linked.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
