"""The pipeline against plain versions of its stages."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    words = ["w" + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(2000)]
    text = [" ".join(rng.choice(words, 60)) for _ in range(120)]
    passage = " ".join(rng.choice(words, 40))
    docs = [(i, t) for i, t in enumerate(text)]
    docs += [(200 + i, text[i] + " ") for i in range(10)]  # exact copies, the longer stays
    docs += [(300 + i, text[20 + i] + " more") for i in range(10)]  # near copies
    docs += [(400 + i, " ".join(rng.choice(words, 30)) + " " + passage) for i in range(5)]  # a shared passage
    docs += [(500 + i, " ".join(w + "###" for w in rng.choice(words, 30))) for i in range(60)]  # junk
    docs += [(600, None), (601, "")]
    labels = [(i, int(i < 500), 0) for i, _ in docs if i < 600 and i % 2 == 0]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], ROWS).write.parquet(f"file://{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{out}/labels.parquet")
    return f"file://{out}", dict(docs), passage


def test_stages(spark, folder):
    path, docs, passage = folder
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = corpus_pipeline.written(stage(spark, now, path), name)
        seen[name] = now
        if name != "pack":
            assert now.dtypes == before.dtypes
    ids = {k: {r.doc_id for r in v.select("doc_id").distinct().collect()} for k, v in seen.items()}
    assert not any(500 <= i < 600 for i in ids["quality"]) and len(ids["quality"] - {600, 601}) == 145
    assert not ids["exact"] & set(range(10)) and set(range(200, 210)) <= ids["exact"]
    assert not ids["near"] & set(range(300, 310)) and set(range(20, 30)) <= ids["near"]
    left = {r.doc_id: r for r in seen["suffix"].collect()}
    assert set(left) == ids["near"]
    assert left[400].text == docs[400] and all(passage[5:] not in left[i].text for i in range(401, 405))
    assert all(r.n_chars == len(r.text) for r in left.values())
    assert ids["pack"] == ids["suffix"]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} and out.count() > 100


@pytest.mark.parametrize("sent", [500_000, 0])
def test_null_and_repeated_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(corpus_pipeline, "SENT_IDS", sent)
    rng = np.random.default_rng(13)
    a, b, c, d, e = (" ".join("w" + str(x) for x in rng.integers(0, 10**6, 60)) for _ in range(5))
    rows = lambda *x: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in x], ROWS)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    got = corpus_pipeline.distinct(spark, rows((1, a), (None, a), (5, a), (5, b), (6, b + " "), (7, c), (7, c), (None, d), (None, None)), "")
    assert left(got) == sorted([(1, a), (6, b + " "), (7, c), (7, c), (None, d), (None, None)], key=str)
    got = corpus_pipeline.dissimilar(spark, rows((3, a), (5, a + " more"), (5, b), (6, b + " again"), (7, c), (7, c), (None, d), (8, d + " end"), (None, c + " x"), (None, e), (9, None)), "")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left(got) == sorted([(3, a), (5, b), (7, c), (7, c), (8, d + " end"), (None, e), (9, None)], key=str)


WIDE = ROWS + ", kept boolean, row int, n_bytes string, component_id long, _key int, grp string, y int, spans string"


def test_other_columns_with_clashing_names_come_along(spark, folder):
    path, docs, _ = folder
    now = spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, i, "b", 7, 5, "g", 1, "s") for i, t in docs.items()] + [(None, None, None, None, None, None, None, None, None, None, None, None, None)], WIDE)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, path), name)
        assert now.columns == [c.split()[0] for c in WIDE.split(", ")]
    assert all((r.row, r.n_bytes, r.component_id) == ((r.doc_id, "b", 7) if r.doc_id is not None else (None, None, None)) for r in now.collect())


def test_empty_table(spark, folder):
    now = spark.createDataFrame([], ROWS)
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.written(stage(spark, now, folder[0]), name)
        assert now.count() == 0


def test_long_texts_and_cleaning_up(spark, folder):
    from quillstone.llm import common

    path = folder[0]
    rng = np.random.default_rng(14)
    long = " ".join("w" + str(x) for x in rng.integers(0, 5000, 60_000))
    rows = [(1, long, "en", "s", len(long)), (2, long + " ", "en", "s", 0), (3, long + " and more", "en", "s", 0), (4, "short", "en", "s", 5), (4, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, ROWS)
    one = corpus_pipeline.written(corpus_pipeline.distinct(spark, docs, path), "x")
    assert sorted((r.doc_id, len(r.text or "")) for r in one.collect()) == [(2, len(long) + 1), (3, len(long) + 9), (4, 0), (4, 5)]
    two = corpus_pipeline.written(corpus_pipeline.dissimilar(spark, one, path), "x")
    assert sorted((r.doc_id, len(r.text or "")) for r in two.collect()) == [(2, len(long) + 1), (4, 0), (4, 5)]
    assert sorted(r.doc_id for r in corpus_pipeline.unrepeated(spark, two, path).collect()) == [2, 4, 4]
    before = len(common.made)
    corpus_pipeline.run(spark, path)
    assert len(common.made) == before + 1
