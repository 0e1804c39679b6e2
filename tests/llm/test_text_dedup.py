"""Near duplicates and repeated byte strings against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import common, graph, minhash, suffix

DOC = "doc_id long, text string, n_shingles string, bands string"


def corpus(rng, n=60):
    words = ["alpha", "béta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    base = [rng.choice(words, int(rng.integers(30, 120))).tolist() for _ in range(6)]
    out = [None, "", "  \n", "one", "ONE", "one two three", "one two three", "x" * 30_000, "ab" * 300]
    for i in range(n):
        own = list(base[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            own[int(rng.integers(0, len(own)))] = "w" + str(int(rng.integers(0, 50)))
        cut = int(rng.integers(0, len(own) // 2)) if i % 5 == 0 else 0
        out.append(" ".join(own[cut:]) if i % 7 else "\t".join(own).upper())
    return out


def shingles(text, k):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5)])
def test_near_duplicates(spark, seed, k):
    texts = corpus(np.random.default_rng(seed))
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, texts[-1], "", ""), (3, "one", "", "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOC), k).collect()
    assert len(got) == len(rows)
    sets = [shingles(t, k) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id), texts[r.doc_id]
    assert len(set(comp)) < len(comp) - 20


def test_blocks_find_what_links_components(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 10**9, 60)
    docs = []
    for i in range(80):
        own = base.copy()
        own[rng.choice(60, int(rng.integers(2, 14)), replace=False)] = rng.integers(0, 10**9)
        docs.append((i, sorted({int(x) for x in own})))
    want = {(i, j) for i, a in docs for j, b in docs if i < j and 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))}
    entries = spark.createDataFrame([(band, i % 3, 3, i, len(s), i) for i, s in docs for band in (1, 2)], "band long, salt int, cuts int, doc_id long, n long, comp long")
    sets = spark.createDataFrame(docs, "doc_id long, set array<long>")

    def classes(links):
        comp = list(range(80))
        for _ in range(80):
            for a, b in links:
                comp[a] = comp[b] = min(comp[a], comp[b])
        return comp

    for block in (500, 10**6):
        got = [(r.a, r.b) for r in minhash.blockwise(entries, sets, 80, 100, block).collect()]
        assert {(min(x), max(x)) for x in got} <= want and classes(got) == classes(want)


def plain_classes(rows, k):
    """Component of each row of (doc_id, text), all rows documents of their own, by comparing all of them."""
    sets = [shingles(t, k) for _, t in rows]
    comp = [i for i, _ in rows]
    grown = True
    while grown:
        grown = False
        for x in range(len(rows)):
            for y in range(len(rows)):
                if rows[x][0] is not None and rows[y][0] is not None and sets[x] and sets[y] and comp[x] > comp[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    comp[x], grown = comp[y], True
    return comp


def test_rows_that_repeat_an_id_are_documents(spark):
    rng = np.random.default_rng(31)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (3, b), (3, c + " end"), (4, c), (4, c), (5, d), (5, d + " more"), (6, a + " x"), (None, a), (7, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(x)) for (i, _), x in zip(rows, plain_classes(rows, 4), strict=True))


def test_ties_of_short_templated_documents(spark):
    """One bucket takes in most of the texts, and links join some of them that no star's centre reaches."""
    rng = np.random.default_rng(32)
    head = [f"h{x}" for x in range(20)]
    rows = []
    for i in range(600):
        own = head + [f"v{x}" for x in rng.integers(0, 4, 3)]
        own[int(rng.integers(0, 3))] = f"u{rng.integers(0, 3)}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert [got[i] for i, _ in rows] == plain_classes(rows, 4)
    assert 1 < len(set(got.values())) < 300


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 30, dtype=np.uint64) * 2)
    b = np.sort(a[:-5])
    sig = minhash.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 25 / 30) < 0.15


@pytest.mark.parametrize("data", [b"", b"a", b"banana" * 30, b"a" * 500, bytes(np.random.default_rng(5).integers(0, 3, 2000, dtype=np.uint8)), b"\x00\x00\x00", b"ab\x00ab\x00\x00" * 40])
@pytest.mark.parametrize("period,bucket", [(8, 50), (32, 1 << 17)])
def test_suffix_array(data, period, bucket):
    assert suffix.suffix_array(data, period, bucket).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_repeats_among_blocks_that_repeat():
    """Windows that go on alike for long after their own length, in many places."""
    rng = np.random.default_rng(6)
    unit = rng.integers(97, 107, 150, dtype=np.uint8)
    parts = [np.concatenate((rng.integers(97, 107, int(rng.integers(0, 3)), dtype=np.uint8), unit)) for _ in range(300)]
    data, starts = np.concatenate(parts), []
    base = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    starts = np.concatenate([np.arange(a, b - 99) for a, b in zip(base, base[1:], strict=False)])
    rank = rng.permutation(len(starts))
    got, raw, least = suffix.repeats(data, starts, rank, 100), data.tobytes(), {}
    for s, r in zip(starts.tolist(), rank.tolist(), strict=True):
        least[raw[s : s + 100]] = min(least.get(raw[s : s + 100], r), r)
    assert got.tolist() == [least[raw[s : s + 100]] < r for s, r in zip(starts.tolist(), rank.tolist(), strict=True)]


def test_difference_cover():
    for v in (8, 16, 32):
        inside, shift = suffix.difference_cover(v)
        for a in range(v):
            for b in range(v):
                assert inside[(a + shift[a, b]) % v] and inside[(b + shift[a, b]) % v]
        assert inside.sum() < v


def brute(texts, length):
    first = {}
    for i, t in sorted(texts):
        for s in range(len(t) - length + 1):
            first.setdefault(t[s : s + length], (i, s))
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (i, s):
                gone[s : s + length] = True
        out[i] = gone
    return out


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 100, 32, 20_000), (2, 100, 32, 3), (3, 40, 16, 5), (4, 16, 8, 2)])
def test_repeated_bytes(spark, seed, length, gram, hot):
    rng = np.random.default_rng(seed)
    texts = corpus(rng, 25)
    line = "".join(rng.choice(list("abcdefghij é"), 90))
    texts += [f"{rng.integers(10**8)} {line} {rng.integers(10**9)}" for _ in range(12)] + [line + line + str(i) for i in range(3)]
    texts += [texts[20], texts[20], "the same over " * 40, ("y" * 150), ("y" * 99), ("y" * 100)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    want = brute([(i, (t or "").encode()) for i, t in enumerate(texts)], length)
    got = suffix.repeated_bytes(spark.createDataFrame(rows, DOC), length, gram, hot).collect()
    assert len(got) == len(rows)
    for r in got:
        raw, gone = (texts[r.doc_id] or "").encode(), want[r.doc_id]
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), r.doc_id
    if seed == 1:
        whole = suffix.repeated_bytes(spark.createDataFrame(rows, DOC), length, gram, hot, keep_text=True).collect()
        assert all(r.n_removed <= want[r.doc_id].sum() and len(r.kept.encode()) == r.n_bytes - r.n_removed for r in whole)


def test_repeated_bytes_empty(spark):
    assert suffix.repeated_bytes(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "z" * 120), (None, "z" * 120), (5, "z" * 120), (5, "z" * 120)]
    got = suffix.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 120), (False, 120), (True, 119), (True, 119)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_rows_that_repeat_an_id_in_one_task(spark, hot):
    rng = np.random.default_rng(21)
    a, b, c, tail = ("".join(rng.choice(list("abcdefghij é"), n)) for n in (300, 300, 300, 80))
    texts = [(3, c), (5, a), (5, a), (6, b + tail), (6, b), (7, c + a), (7, c + b), (7, "short"), (8, a + tail), (None, b[:150]), (None, "x" + b[:150]), (None, "brief")]
    first = {}
    for i, t in texts:
        raw = t.encode()
        for s in range(len(raw) - 99):
            first[raw[s : s + 100]] = min(first.get(raw[s : s + 100], (1 << 62, 0)), (-1 if i is None else i, s))
    want = []
    for i, t in texts:
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for s in range(len(raw) - 99):
            if first[raw[s : s + 100]] < (-1 if i is None else i, s):
                gone[s : s + 100] = True
        want.append((str(i), len(raw), int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    for docs in (rows.coalesce(1), rows.repartition(6)):
        got = suffix.repeated_bytes(docs, hot=hot).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert want[1][2] == want[2][2] == 0


def test_pieces_of_long_texts_hold_each_window_once():
    data = np.random.default_rng(4).integers(97, 99, 5000, dtype=np.uint8)
    starts = np.array([0, 10, 10, 3000, 5000])

    def ties(most):
        out = []
        for d, part, at, base in suffix.pieces(data, starts, 40, most):
            for doc, h, place, lo, hi in zip(*suffix.anchors(part, at, 40, 16), strict=True):
                out += [(d + doc, w - at[doc] + base, h, place - at[doc] + base) for w in range(lo, hi + 1)]
        return out

    whole = ties(10**6)
    assert len(whole) == 2990 - 39 + 2000 - 39
    for most in (64, 700, 2990):
        assert sorted(ties(most)) == sorted(whole)


def test_equal_digests_of_other_bytes_are_not_repeats():
    key, one = np.zeros(4, np.int64), np.ones(4, np.int64)
    doc, row = np.arange(4), np.arange(4)
    data = np.frombuffer(b"abcd" b"abcd" b"abXd" b"abcd", np.uint8)
    again, new = suffix._again(key, one, one, doc, row, one, data, np.arange(4) * 4, np.full(4, 4))
    assert again.tolist() == [False, True, False, True] and new.tolist() == [True, False, True, False]


def test_many_rows_without_ids_and_other_columns(spark):
    rng = np.random.default_rng(41)
    line = "".join(rng.choice(list("abcdefghij é"), 120))
    texts = [f"{i} " + "".join(rng.choice(list("abcdefghij"), 60)) + line for i in range(400)]
    rows = [(None, t, "row", i) for i, t in enumerate(texts)] + [(None, None, "row", 0), (None, "", "row", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lo string, row int")
    got = suffix.repeated_bytes(docs, keep_text=True, carry=("row", "lo"))
    assert got.columns[-3:] == ["kept", "row", "lo"]
    left = {r.row: r for r in got.where("n_bytes > 0").collect()}
    # All are one document without an id: what starts at the same byte in each is not earlier.
    want = brute([(i, t.encode()) for i, t in enumerate(texts)], 100)
    first = {}
    for t in texts:
        raw = t.encode()
        for s in range(len(raw) - 99):
            first[raw[s : s + 100]] = min(first.get(raw[s : s + 100], s), s)
    for i, t in enumerate(texts):
        raw, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for s in range(len(raw) - 99):
            if first[raw[s : s + 100]] < s:
                gone[s : s + 100] = True
        assert left[i].n_removed <= gone.sum() <= left[i].n_removed + 8 and len(want) == 400
    assert got.count() == len(rows)


def test_blocks_are_bounded_in_documents(spark, monkeypatch):
    def counted(num, den):
        return lambda table: pa.table({"a": [table.num_rows], "b": [0]})

    monkeypatch.setattr(minhash, "_linked", counted)
    entries = spark.range(9000).selectExpr("1L band", "0 salt", "1 cuts", "id doc_id", "3L n", "id comp")
    sets = spark.range(9000).selectExpr("id doc_id", "array(1L, 2L, id) set")
    got = [r.a for r in minhash.blockwise(entries, sets, 80, 100).collect()]
    assert len(got) > 1 and max(got) < 2.2 * 2000


def test_short_documents_are_linked_across_blocks(spark):
    # Documents i and i + 2500 have the same shingles, all others have none in common.
    entries = spark.range(5000).selectExpr("1L band", "0 salt", "1 cuts", "id doc_id", "9L n", "id comp")
    sets = spark.range(5000).selectExpr("id doc_id", "transform(sequence(0, 8), x -> 10 * (id % 2500) + x) set")
    got = sorted((min(r.a, r.b), max(r.a, r.b)) for r in minhash.blockwise(entries, sets, 80, 100).collect())
    assert got == [(i, i + 2500) for i in range(2500)]


def test_gather_in_parts(monkeypatch):
    """Bytes gathered in parts are those gathered at once, whatever the parts; no part is over its bound but for a single row."""
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    size = np.concatenate((rng.integers(0, 40, 300), [900, 0, 0]))
    first = rng.integers(0, 4000, len(size))
    plain = b"".join(data[a : a + n].tobytes() for a, n in zip(first, size, strict=True))
    for most in (1, 37, 500, 1 << 20):
        monkeypatch.setattr(suffix, "BLOCK", most)
        assert suffix._gather(data, first, size).tobytes() == plain
        cuts = list(suffix._slices(size, most))
        assert [i for s in cuts for i in range(s.start, s.stop)] == list(range(len(size)))
        assert all(size[s].sum() <= most or s.stop - s.start == 1 for s in cuts)
    none = np.zeros(0, np.int64)
    assert suffix._gather(data, none, none).tobytes() == b"" and not list(suffix._slices(none, 5))


def test_a_sieve_lets_all_its_keys_pass_and_few_others(spark):
    from quillstone.llm.sieve import sieve

    keys = np.random.default_rng(6).integers(-(1 << 63), (1 << 63) - 1, 300_000)
    made = sieve(spark.createDataFrame(pa.table({"k": keys[:100_000]})))
    assert made.passes(keys[:100_000]).all() and made.passes(keys[100_000:]).mean() < 0.01
    rows = spark.createDataFrame(pa.table({"k": pa.array([None, *keys[:5].tolist()], pa.int64())}))
    assert rows.where(made.column("k")).count() == 5
    none = sieve(spark.createDataFrame([], "k long"))
    assert not none.passes(keys).any() and rows.where(none.column("k")).count() == 0


def test_texts_alone_of_their_kind_are_not_shuffled(spark, monkeypatch):
    """Where nothing is broadcast, near duplicates shuffle no texts, and repeated bytes none but for the last join."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join("w" + str(x) for x in rng.integers(0, 10**6, 60))) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(20)]
    plans = []

    def noted(df, label, real=common.written):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, label)

    monkeypatch.setattr(minhash, "written", noted)
    monkeypatch.setattr(suffix, "written", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = common.written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
        got = minhash.near_duplicates(docs)
        assert got.where("NOT kept").count() == 20
        for plan in plans:  # what is joined below the function that reads the texts
            assert "MapInArrow" not in plan or "Join" not in plan[plan.rindex("MapInArrow") :]
        cut = suffix.repeated_bytes(docs)
        plan = cut._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and cut.where("n_removed > 0").count() == 20
        assert "Join" not in plans[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_what_grows_with_the_texts_is_not_broadcast(spark, monkeypatch):
    """Of near duplicates only hot keys are, however small the other tables seem by their files."""
    rng = np.random.default_rng(32)
    rows = []
    for i in range(200):
        own = [f"h{x}" for x in range(20)] + [f"v{x}" for x in rng.integers(0, 4, 3)]
        own[int(rng.integers(0, 3))] = f"u{rng.integers(0, 3)}"
        rows.append((i, " ".join(own)))
    plans, labels = [], set()

    def noted(df, label, real=common.written):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        labels.add(label)
        return real(df, label)

    def met(rows, keyed, key, total, real=minhash._meet):
        plan = real(rows, keyed, key, total)._jdf.queryExecution().sparkPlan().toString()
        assert (plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")) == (2, 1)  # hot keys, twice, and all others
        return rows.join(common.dealt(keyed), key).drop("size")

    monkeypatch.setattr(minhash, "written", noted)
    monkeypatch.setattr(graph, "written", noted)
    monkeypatch.setattr(minhash, "_meet", met)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert {"cored", "rarest", "confirmed", "labels"} <= labels and sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]
