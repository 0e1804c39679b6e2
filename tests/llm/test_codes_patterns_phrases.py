"""Vector codes, pattern packing and phrase collocations against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import public_tokenizers
import pytest

from quillstone.llm import collocations, patterns, vq

VEC = "vec_id long, embedding array<float>, label string, code string, part int"


def plain_codes(rows):
    kept = [(i, [floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    usual = min(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (-x[1], x[0]))[0]
    kept = sorted((r for r in kept if len(r[1]) == usual), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-usual // 4)
    parts = [[(v + [0] * (4 * width - usual))[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(w) for w in parts[p][:256]] for p in range(4)]

    def nearest(book, w):
        return min((sum((a - b) ** 2 for a, b in zip(w, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            own = defaultdict(list)
            for w in parts[p]:
                own[nearest(books[p], w)[1]].append(w)
            for i, ws in own.items():
                books[p][i] = [sum(c) // len(ws) for c in zip(*ws, strict=True)]
    found = [[nearest(books[p], w) for w in parts[p]] for p in range(4)]
    total = Counter()
    out = []
    for n, (i, _, label) in enumerate(kept):
        error = sum(found[p][n][0] for p in range(4))
        total[label] += error
        out.append((i, "".join(f"{found[p][n][1]:02x}" for p in range(4)), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in out), key=repr)


@pytest.mark.parametrize(("n", "size"), [(400, 16), (30, 7), (300, 1)])
def test_vector_codes(spark, n, size):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.normal(size=size).astype(np.float32).round(1)], str(i % 3) if i % 5 else None) for i in rng.permutation(n)]
    rows += rows[:5] + [(None, rows[0][1], None), (7, [0.0] * size, "z"), (8, None, "z"), (9, [None] * size, "z"), (10, [float("nan")] * size, "z"), (11, [float("-inf")] * size, None), (12, [1.0] * (size + 1), "z"), (13, [], None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], VEC).repartition(3)
    assert sorted(map(tuple, vq.compress(df).collect()), key=repr) == plain_codes(rows)


def test_vector_codes_empty_hot_and_large(spark):
    assert vq.compress(spark.createDataFrame([], VEC)).count() == 0
    same = spark.range(5000).selectExpr("id vec_id", "array(0.5f, 0.25f, 0f, -1f) embedding", "cast(null as string) label")
    got = vq.compress(same).distinct().collect()
    assert len(got) == 5000 and {(r.code, r.error, r.label_error) for r in got} == {("00000000", 0, 0)}
    huge = spark.createDataFrame([(1, [1e30, 1.0, 1.0, 1.0], "a")], "vec_id long, embedding array<double>, label string")
    with pytest.raises(Exception, match="or more in magnitude"):
        vq.compress(huge).collect()


def test_partial_distances_are_whole_ones():
    rng = np.random.default_rng(3)
    for k, width in ((1, 1), (256, 16), (40, 5), (256, 3)):
        entries, x = rng.integers(-20, 20, (k, width)), rng.integers(-25, 25, (2500, width))
        far = ((x[:, None, :] - entries) ** 2).sum(2)
        code, least = vq.Book(entries).nearest(x)
        assert (code == far.argmin(1)).all() and (least == far.min(1)).all()


def lower_bound(h):
    size = len(h) - 1
    return max(-(-int((h * np.arange(size + 1)).sum()) // size), int(h[size // 2 + 1 :].sum()))


def first_fit(h):
    """Sequences of first-fit decreasing."""
    size, n = len(h) - 1, 0
    free = np.zeros(size + 1, int)
    for v in range(size, 0, -1):
        for _ in range(int(h[v])):
            room = next((r for r in range(v, size + 1) if free[r]), None)
            if room is None:
                n, room = n + 1, size
            else:
                free[room] -= 1
            free[room - v] += 1
    return n


def test_plan_uses_each_piece_once_in_few_sequences():
    rng = np.random.default_rng(0)
    shapes = {"documents": rng.lognormal(5, 1.2, 20000), "short": rng.lognormal(3, 0.5, 5000), "even": rng.integers(1, 1025, 20000), "long": rng.integers(400, 1025, 4000), "few": rng.choice([300, 301, 700, 513, 30], 3000), "one": np.full(1000, 1), "none": []}
    for name, lengths in shapes.items():
        h = np.bincount(np.clip(np.asarray(lengths, int), 1, 1024), minlength=1025)
        plan = patterns.plan(h)
        used = np.zeros(1025, int)
        for p, n in plan:
            assert n > 0 and sum(v * k for v, k in p) <= 1024
            for v, k in p:
                used[v] += n * k
        assert (used == h).all()
        sequences = sum(n for _, n in plan)
        assert sequences <= first_fit(h) * (1.02 if name == "even" else 1) + 1, (name, sequences, first_fit(h), lower_bound(h))
    columns = patterns.offered(h := np.bincount(np.clip(rng.lognormal(5, 1.2, 20000).astype(int), 1, 1024), minlength=1025))
    times = patterns.fit(h.astype(float), columns)
    assert (times >= 0).all() and sum(x * sum(k for _, k in p) for p, x in zip(columns, times, strict=True)) > 0.8 * h.sum()  # most pieces go by the fit


DOC = "doc_id long, text string, lang string, length string, rank string, part string"


def test_pattern_packing(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    texts = {i: " ".join(rng.choice(["the", "house", "<|endoftext|>", "ñandú", "of"], int(n))) for i, n in enumerate([*rng.lognormal(5, 1, 150), 5000, 1023, 1022, 0])}
    rows = [(i, t) for i, t in texts.items()] + [(7, texts[7]), (None, "a b"), (None, None), (900, "")]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOC).repartition(3)
    pieces = patterns.pack_patterns(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    by = defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    h = np.bincount([r.length for r in pieces], minlength=1025)
    assert len(by) <= first_fit(h) + 1


def test_pattern_packing_empty_and_hot(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert patterns.pack_patterns(spark.createDataFrame([], DOC), path).count() == 0
    got = patterns.pack_patterns(spark.range(30_000).selectExpr("cast(null as long) doc_id", "'' text").repartition(5), path)
    assert got.selectExpr("count(*) n", "count(distinct sequence_id) s", "count(distinct sequence_id, offset) d").first()[:] == (30_000, 30, 30_000)


def plain_phrases(rows, least, top, cover=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][w[i : i + k]] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {q[i : i + s] for q, b in cand.items() for s in range(2, len(q)) for i in range(len(q) - s + 1) if 100 * b >= cover * cand[q[i : i + s]]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, cut = min((1000 * a * n[lang] // (counts[p[:j]] * counts[p[j:]]), j) for j in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


PHRASE = "text string, lang string, phrase string, n int"


@pytest.mark.parametrize("window", [1 << 21, 200, 1])
def test_collocations(spark, monkeypatch, window):
    rng = np.random.default_rng(11)
    words = ["the", "The", "of", "New", "york", "a-b", "été", "ß", "\x1c", "x" * 60, "🙂"]
    gaps = [" "] * 12 + ["\t", "  ", ", ", ". ", "\n", "!", "\r\n", ";"]
    make = lambda m: "".join(x for _ in range(m) for x in (words[min(int(rng.exponential(3)), 10)], gaps[rng.integers(len(gaps))]))
    rows = [(make(int(m)), [None, "en", "de", "und"][i % 4]) for i, m in enumerate(rng.integers(0, 60, 120))] + [(None, "en"), ("", None), ("\n .", "de"), ("solo", "xx")]
    rows += rows[:9] + [(make(4000), "en")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], PHRASE).repartition(3)
    given = collocations.windows.__defaults__
    monkeypatch.setattr(collocations.windows, "__defaults__", (window, *given[1:]))
    for least, top in ((3, 2000), (40, 5)):
        assert sorted(map(tuple, collocations.collocations(df, least=least, top=top).collect())) == plain_phrases(rows, least, top)


def test_windows_hand_on_their_last_words():
    text = np.frombuffer(b"aa bb\tcc, dd  ee ff gg" * 50, np.uint8)
    for size in (1, 5, 17, 400, 10_000):
        fresh = b"".join(part[skip:].tobytes() for part, skip in collocations.windows(text, size))
        assert fresh == text.tobytes()


def test_unlike_phrases_of_one_hash_are_counted_apart():
    w = collocations.Counted(np.frombuffer(b"a b c a b c a a", np.uint8), 0, collocations.lang_seed("en"))
    at = w.starts(2)
    got = w.tally(at, np.zeros(len(at), np.uint64), 2).to_pydict()
    assert dict(zip(got["phrase"], got["n"], strict=True)) == {b"a b": 2, b"b c": 2, b"c a": 2, b"a a": 1}


def test_collocations_empty_and_hot(spark):
    assert collocations.collocations(spark.createDataFrame([], PHRASE)).count() == 0
    hot = spark.range(400).selectExpr("repeat('so it goes. ', 50) text", "'en' lang").repartition(7)
    assert [r[:] for r in collocations.collocations(hot).collect()] == [("en", 1, "so it goes", 20_000, 20_000, 20_000, 60_000, 3000)]
