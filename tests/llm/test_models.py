"""Classifiers by held-out accuracy, the language model and the vector search against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from quillstone.llm import ann, flat, lm, quality, toxicity

GOOD = ["the", "river", "stone", "walks", "under", "quiet", "hills", "before", "morning", "light", "and", "over"]
EDGE = [None, "", " \n\t", "!", "word " * 20_000, "\x00", "é" * 500]


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(GOOD, int(rng.integers(8, 60))).tolist()
        toxic, bad = int(rng.random() < 0.25), int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                words[int(rng.integers(0, len(words)))] = "vile" + str(rng.choice(["", "ness", "st", "ly"]))
        if bad:
            words = [w + str(rng.choice(["###", "%%%", "***"])) for w in words]
        docs.append((i, " ".join(words), "en" if i % 2 else "fr", "clash"))
        labels.append((i, 1 - bad, toxic))
    docs += [(n + i, t, None, "clash") for i, t in enumerate(EDGE)] + [(None, "the river", None, None), docs[0]]
    return docs, labels + [(None, 1, 1), (10**9, None, None), labels[0]]


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, column):
    want = {r[0]: r[column] for r in labels}
    held = [r for r in rows if r.held_out and want.get(r.doc_id) is not None]
    return np.mean([r.predicted == want[r.doc_id] for r in held])


def test_classifiers(spark):
    docs, labels = corpus(np.random.default_rng(4), 900)
    d, t = frames(spark, docs, labels)
    for module, column, cut in ((quality, 1, 0.3), (toxicity, 2, 0.5)):
        rows = module.classify(d, t).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert accuracy(rows, labels, column) > 0.93
    only = quality.keep_good(d, quality.train(d, t))
    assert only.columns == d.columns and only.count() < len(docs)


def test_classifiers_without_labels(spark):
    d, t = frames(spark, [(1, "a b", "en", None), (2, None, None, None)], [])
    for module in (quality, toxicity):
        assert len(module.classify(d, t).collect()) == 2
        assert module.classify(*frames(spark, [], [])).count() == 0


def test_trees_match_plain_traversal():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 26)).astype(np.float32)
    trees = quality.Trees(rounds=10, depth=3).fit(x, (x[:, 0] * x[:, 1] > 0).astype(float))
    plain = []
    for row in x[:50]:
        raw = trees.base
        for t in range(trees.rounds):
            node = 0
            while node < 7 and np.isfinite(trees.cut[t, node]):
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            raw += trees.value[t, node]
        plain.append(1 / (1 + math.exp(-raw)))
    assert np.allclose(trees.predict(x[:50]), plain)


def plain_statistics(text):
    raw = (text or "").encode()
    words = [w for w in bytes(x + 32 if 65 <= x <= 90 else x for x in raw).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
    n, m = max(1, len(raw)), max(1, len(words))
    share = lambda chars: sum(x in chars for x in raw) / n
    symbols = b"#$%&*+/<=>@[\\]^_`{|}~"
    lines = raw.split(b"\n")
    back = lambda k: sum(words[i] == words[i - k] for i in range(k, len(words))) / m
    pairs = list(zip(words, words[1:], strict=False))
    mean = sum(map(len, words)) / m
    return [
        math.log1p(len(raw)), math.log1p(len(words)), mean, math.sqrt(max(0, sum(len(w) ** 2 for w in words) / m - mean**2)), share(bytes(range(65, 91))), share(b"0123456789"), share(b".,;:!?'\"-()"), share(bytes(range(128, 256))),
        share(symbols), share(b" \t\n\x0b\x0c\r"), math.log1p(len(lines)), math.log1p(len(raw) / len(lines)), sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines),
        len(set(words)) / m, max(Counter(words).values(), default=0) / m, back(1), back(2), share(b"|"), share(b"."), sum(len(w) > 15 for w in words) / m, sum(len(w) == 1 for w in words) / m, share(b","),
        sum(any(x in symbols for x in w) for w in words) / m, back(7), (len(pairs) - len(set(pairs))) / len(pairs) if pairs else 0,
    ]


TEXTS = [
    *EDGE, "The river, the stone. THE river, the stone!", "a\nb\na\n\nlonger line of more than thirty bytes\na", "| x | y |\n| 1 | 22 |", "x1 #tag $5 ünï incomprehensibilities {a}", "go go go go\tgo go go go go stop",
    "1 2 3 4 5 6 7 1 2 3 4 5 6 7", "\n\n", "vile word, vileness",
]


def test_statistics_match_plain_ones():
    got = quality.statistics(*flat.texts(pa.array(TEXTS)))
    for text, row in zip(TEXTS, got, strict=True):
        assert np.allclose(row, plain_statistics(text), atol=1e-4), (text or "")[:40]


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(18)
    x = np.round(rng.normal(size=(200, 4)), 1).astype(np.float32)
    y = ((x[:, 2] > 0.3) ^ (rng.random(200) < 0.1)).astype(float)
    trees = quality.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    best = (0.0, None, None)
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower")):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= quality.LEAST:
                part = lambda rows: ((p - y[rows]).sum()) ** 2 / (p * (1 - p) * rows.sum() + quality.RIDGE)
                best = max(best, (part(left) + part(~left) - part(np.ones(200, bool)), j, float(cut)))
    assert (trees.feature[0, 0], float(trees.cut[0, 0])) == best[1:]
    left = x[:, best[1]] <= best[2]
    for node, rows in ((1, left), (2, ~left)):
        assert abs(trees.value[0, node] + trees.step * (p - y[rows]).sum() / (p * (1 - p) * rows.sum() + quality.RIDGE)) < 1e-9


def test_convolutions_match_plain_loops():
    net = toxicity.Net(seed=3)
    ids, at = toxicity.word_ids(*flat.texts(pa.array(TEXTS)))
    got = net.score(ids, at)
    for n, text in enumerate(TEXTS):
        clean = bytes(32 if x in b".,;:!?'\"()[]*#%&$|" else x for x in (text or "").encode()).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
        words = [w for w in clean.split(b" ") if w]
        if len(words) > 1000:
            words = words[:50]  # one word over and over: what lies further on is the same
        vectors = [sum(net.par["emb"][i].astype(np.float64) for i in toxicity.word_ids(*flat.texts(pa.array([w], pa.binary())))[0][0]) for w in words]
        z = float(net.par["bias"][0])
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                seen = [sum(vectors[i + j] @ net.par[f"f{width}"][j][:, f] for j in range(width)) + net.par[f"b{width}"][f] for i in range(len(vectors) - width + 1)]
                z += max([0.0, *seen]) * net.par["out"][k * toxicity.FILTERS + f]
        assert abs(got[n] - 1 / (1 + math.exp(-z))) < 1e-4, (text or "")[:40]


def test_gradients_match_differences():
    net, rng = toxicity.Net(seed=4), np.random.default_rng(19)
    net.par = {k: v.astype(np.float64) for k, v in net.par.items()}
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 1 + len(toxicity.PREFIXES))) for n in (1, 4, 9, 0, 30)]
    y, weight = np.array([1, 0, 1, 0, 1]), np.array([1.0, 0.5, 2.0, 1.0, 1.0])
    loss = lambda: float((weight * (np.logaddexp(0, z := net.logits(docs)) - y * z)).sum())
    grad = net.gradients(docs, y, weight)
    for name, at in [("out", (3,)), ("bias", (0,)), *((f"b{w}", (1,)) for w in toxicity.WIDTHS), *((f"f{w}", (w - 1, 2, f)) for w in toxicity.WIDTHS for f in range(3)), *(("emb", (int(docs[4][i, 0]), 1)) for i in range(6))]:
        was, sides = net.par[name][at], []
        for step in (1e-3, -1e-3):
            net.par[name][at] = was + step
            sides.append(loss())
        net.par[name][at] = was
        assert abs((sides[0] - sides[1]) / 2e-3 - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at])), (name, at)


def tokens(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w] + ["</end>"]


def test_lm_counts_and_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 6)  # most counts must come by the join
    docs, _ = corpus(np.random.default_rng(5), 300)
    rows = lm.score(spark.createDataFrame([d[:2] + ("x", "y") for d in docs], "doc_id long, text string, row string, h string")).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t, *_ in docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want
    usual = [r for r in rows if r.n_tokens < 1000]
    assert sum(r.score for r in usual) > sum(r.base_score for r in usual) * 1.02


def test_lm_scores_match_plain_sums(spark, monkeypatch):
    """Every text's score from the trained net, context by context, with classes for the words beyond the common ones."""
    nets, log_z = [], lm.Net.log_z
    monkeypatch.setattr(lm.Net, "log_z", lambda self: nets.append(self) or log_z(self))
    rng = np.random.default_rng(9)
    words = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(1600)]
    docs = [(i, " ".join(rng.choice(words, 40))) for i in range(150)] + [(200, None), (201, "One"), (202, "never seen words here"), (None, "w1b w2c")]
    rows = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    one = {w: lm.Tokens(pa.array(["" if w == "</end>" else w])) for _, t in docs for w in tokens(t)}
    named = sorted(c, key=lambda w: (-c[w], int(one[w].hash[:1].view(np.int64)[0])))[: lm.WORDS]
    assert len(c) > lm.WORDS
    output = {w: k for k, w in enumerate(named)}
    size, types = Counter(), Counter()
    for w in set(c) - set(named):
        size[int(one[w].cls[0])] += c[w]
        types[int(one[w].cls[0])] += 1
    (net,) = nets
    R, C, Q, b = (p.astype(np.float64) for p in net.par)
    for i, t in docs[::4] + docs[-4:]:
        total, u, v = 0.0, lm.OUT, lm.OUT
        for w in tokens(t):
            k = output.get(w, lm.WORDS + int(one[w].cls[0]))
            raw = np.array([(R[u] * C[0] + R[v] * C[1]) @ Q[x] + b[x] for x in range(lm.OUT)])
            total += (raw[k] - raw.max() - math.log(np.exp(raw - raw.max()).sum())) / math.log(10)
            if w not in output:
                total += math.log10((c[w] + 1) / (size[k - lm.WORDS] + types[k - lm.WORDS] + 1))
            u, v = k, u
        assert abs(rows[i].score - total) < 1e-3 * max(1, abs(total)), i


def test_lm_is_normalised():
    net = lm.Net(np.full(lm.OUT, 1 / lm.OUT))
    z = net.log_z()
    for u, v in ((0, 5), (lm.OUT, lm.OUT)):
        ids = np.arange(lm.OUT)
        assert abs(np.exp(net.log_p(ids, np.full(lm.OUT, u), np.full(lm.OUT, v), z)).sum() - 1) < 1e-3


def test_lm_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = lm.score(spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.train_tokens) for r in only] == [(1, only[0].train_tokens)] * 2


def brute(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 12]
    out = {}
    for i, q in ok:
        if i % every == 0:
            out[i] = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in ok if j != i)[:k]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 12))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=12)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[7][1]) for i in range(30)]
    rows += [(5000, None), (5100, [0.0] * 12), (5200, [float("nan")] * 12), (5300, [None] * 12), (5400, [1.0] * 5), (None, rows[0][1]), (5500, [float("inf")] * 12)]
    frame = spark.createDataFrame([r + (9,) for r in rows], "vec_id long, embedding array<double>, rank int")
    want = brute(rows, 100, 10)
    for block in (20_000, 7):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = ann.neighbours(frame).collect()
        assert len(got) == 10 * len(want)
        hits = sum((round(s, 9), j) in {(round(r.score, 9), r.vec_id) for r in got if r.query_id == i} for i, near in want.items() for s, j in near)
        assert hits >= 0.95 * 10 * len(want)
        for r in got:
            assert r.query_id != r.vec_id and 1 <= r.rank <= 10


def test_neighbours_by_shuffled_buckets(spark, monkeypatch):
    """Clusters that codes tell apart: queries meet only what they probe, and one that finds too few asks all rows."""
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.02 * rng.normal(size=32)).tolist()) for i in range(4000)]
    rows += [(100_000, (10 * rng.normal(size=32)).tolist()), (4100, rows[100][1]), (4101, rows[100][1]), (200, rows[3][1])]
    frame = spark.createDataFrame([r + (1,) for r in rows], "vec_id long, embedding array<double>, code int")
    used, bucketed = [], ann._bucketed

    def spy(*args):
        used.append(bucketed(*args))
        return used[-1]

    monkeypatch.setattr(ann, "_bucketed", spy)
    got = ann.neighbours(frame).collect()
    assert len(used) == 1 and 100_000 in [r.vec_id for r in used[0][1].collect()]
    plain = {}
    for i, v in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        plain.setdefault(i, []).append(sorted((float(np.sqrt(((np.array(u) - np.array(v)) ** 2).sum())), j) for j, u in rows if j != i)[:10])
    assert len(got) == sum(10 * len(x) for x in plain.values())
    hits = total = 0
    for i, lists in plain.items():
        mine = {(r.vec_id, round(r.score, 9)) for r in got if r.query_id == i}
        assert sorted(r["rank"] for r in got if r.query_id == i) == sorted(list(range(1, 11)) * len(lists))
        for near in lists:
            hits, total = hits + sum((j, round(s, 9)) in mine for s, j in near), total + 10
    assert hits >= 0.95 * total


def test_neighbours_few(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert ann.neighbours(frame([])).count() == 0
    got = ann.neighbours(frame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (100, [3.0, 4.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 0)]


def test_index_probes_whole_radius():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 256, (2000, 6), dtype=np.uint8)
    index = ann.Index(codes)
    for radius in (0, 5, 11, 17, 20, 48):
        want = np.flatnonzero(np.unpackbits(codes ^ codes[3], axis=1).sum(1) <= radius)
        assert index.within(codes[3], radius).tolist() == want.tolist()
