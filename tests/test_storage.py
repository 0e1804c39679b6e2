"""Tables by bucket, scans that open only what changed, notes written back, the chunker in SQL, stored indexes and joins by bounds."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import frontmatter
from quillstone.operators import chunking, lexical, nearjoin, postings, similarity, vectortable
from quillstone.sources import files, notes
from quillstone.sources.tables import Buckets, Tables


def size_of(folder):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet"))


def test_upserts_write_their_buckets_only(spark, tmp_path):
    tables, schema = Buckets(spark, f"file://{tmp_path}", 64), "k long, v string"
    assert tables.read("t", schema).count() == 0 and tables.vacuum("t") == 0
    rows = spark.range(6400).selectExpr("id k", "repeat(sha2(cast(id AS string), 512), 20) v")
    tables.upsert("t", schema, rows, "k")
    whole = size_of(tmp_path)
    tables.upsert("t", schema, spark.range(3).selectExpr("id * 1000 k", "'new' v"), "k")
    assert size_of(tmp_path) - whole < whole / 10
    got = tables.read("t", schema)
    assert got.count() == 6400 and got.where("v = 'new'").count() == 3
    tables.remove("t", schema, spark.range(10).selectExpr("id k"), "k")
    assert tables.read("t", schema).count() == 6390 and len(tables.versions("t")) == 3
    gone = tables.vacuum("t", keep=1)
    assert gone > 0 and tables.read("t", schema).count() == 6390 and len(tables.versions("t")) == 1
    tables.remove("t", schema, tables.read("t", schema), "k")
    assert tables.read("t", schema).count() == 0
    plain = Tables(spark, f"file://{tmp_path}/plain")
    plain.upsert("t", schema, spark.createDataFrame([(1, "a")], schema), "k")
    plain.upsert("t", schema, spark.createDataFrame([(1, "b"), (2, "c")], schema), "k")
    assert sorted(r[:] for r in plain.read("t", schema).collect()) == [(1, "b"), (2, "c")]


def test_scan_opens_only_what_changed(spark, tmp_path):
    for name in ("a.md", "sub/b.pdf", "odd [1].txt", ".venv/c.md", "d.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    root = str(tmp_path)
    plan = files.listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "modificationTime" in plan
    first = {r.path: r for r in files.documents(spark, root).collect()}
    assert set(first) == {"a.md", "sub/b.pdf", "odd [1].txt"}
    known = spark.createDataFrame([(*r, False) for r in first.values()], "path string, content_hash string, size_bytes long, mtime double, missing boolean")
    kept = os.stat(tmp_path / "a.md")
    (tmp_path / "a.md").write_text("TEXT OF a.md")  # as long and as old as before: not opened
    os.utime(tmp_path / "a.md", ns=(kept.st_atime_ns, kept.st_mtime_ns))
    (tmp_path / "odd [1].txt").write_text("longer than before")
    (tmp_path / "new.md").write_text("new")
    later = {r.path: r.content_hash for r in files.documents(spark, root, known=known).collect()}
    fresh = {r.path: r.content_hash for r in files.documents(spark, root).collect()}
    assert set(later) == set(fresh) and later["a.md"] == first["a.md"].content_hash != fresh["a.md"]
    assert all(later[p] == fresh[p] for p in fresh if p != "a.md")


def test_notes_are_written_back_all_or_none(spark, tmp_path):
    text = "---\ntitle: \"a: b\"\nupdated: 2020-01-01\ntags: [x, y]\n---\n\nbody\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(text)
    rows = files.notes(spark, f"{tmp_path}/in").select("path", frontmatter.parsed(F.col("text")).alias("p")).select("path", "p.*")
    out = f"{tmp_path}/out"
    notes.save(rows.withColumn("path", F.lit("deep/er/a.md")), out, "2024-05-06")
    assert open(f"{out}/deep/er/a.md").read() == text.replace("2020-01-01", "2024-05-06")
    many = spark.range(40).select(F.concat(F.lit("n"), "id", F.lit(".md")).alias("path"), F.lit("{}").alias("frontmatter"), F.col("id").cast("string").alias("body"))
    bad = many.withColumn("path", F.when(F.col("body") == "33", F.lit("../x.md")).otherwise(F.col("path"))).repartition(4)
    with pytest.raises(Exception, match="not a path below the vault"):
        notes.save(bad, f"{tmp_path}/bad", "2024-05-06")
    assert [n for _, _, names in os.walk(f"{tmp_path}/bad") for n in names] == []
    notes.save(many.repartition(4), out, "2024-05-06")
    assert len(os.listdir(out)) == 41 and not any(n.startswith(".") for n in os.listdir(out))


def test_chunks_in_sql(spark):
    docs = spark.createDataFrame([("s", "# A\n\n" + "word " * 400 + "\n\n$$\nx\n$$\n\n## B\n\nend"), ("t", None), ("u", "plain")], "source string, text string")
    docs.createOrReplaceTempView("sql_docs")
    chunking.register(spark)
    got = spark.sql("SELECT c.* FROM sql_docs, LATERAL chunks(source, text, 50, 0.2) AS c")
    assert got.columns == chunking.chunk(docs).columns
    assert sorted(map(str, got.collect())) == sorted(map(str, chunking.chunk(docs, target=50, overlap=0.2).collect()))


def test_postings_equal_bm25_and_skip_blocks(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.choice([0, 3, 30, 300])))) for i in range(400)], "chunk_id long, text string")
    index = postings.Lexical(spark, f"file://{tmp_path}/p").index(docs, block=16)
    asks = spark.createDataFrame([(0, "w1 w2 W2"), (1, "w50"), (2, "none such"), (3, ""), (4, " ".join(words))], "query_id long, text string")
    plain = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    want = plain(lexical.ranked(lexical.bm25(docs, asks), 7))
    assert plain(index.search(asks, 7)) == want and len(want) > 20
    for r in asks.collect():
        one = sorted((r.query_id, x["rank"], x.id, round(x.score, 9)) for x in index.ask(r.text, 7).collect())
        assert one == [w for w in want if w[0] == r.query_id]
    cells = postings.Cells(spark, f"file://{tmp_path}/c").index(docs, block=16)
    near = similarity.hash_embedding(docs, "chunk_id").join(similarity.hash_embedding(asks, "query_id").select(F.col("id").alias("query_id"), "bucket", F.col("w").alias("qw")), "bucket")
    near = lexical.ranked(near.groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("score")), 7)
    assert plain(cells.search(asks, 7)) == plain(near)
    assert postings.Lexical(spark, f"file://{tmp_path}/e").index(docs.limit(0)).ask("w1", 3).count() == 0


def clusters(spark, n, dim=16, spread=0.05):
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(12, dim))
    x = centers[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    x[5] = 0
    x[7] = x[8]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("block", [1024, 20])
def test_near_pairs_equal_all_pairs(spark, block):
    x, df = clusters(spark, 500)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    for threshold in (0.5, 0.97, 0.9999):
        a, b = np.nonzero(np.triu(u @ u.T >= threshold, 1))
        got = nearjoin.near_pairs(df.repartition(3), threshold, cell=40, block=block).collect()
        assert sorted((r.a, r.b) for r in got) == list(zip(a.tolist(), b.tolist(), strict=True))
    compared = nearjoin.candidates(nearjoin.dealt(df, 0.9999, cell=40)).agg(F.sum("pairs")).first()[0]
    assert compared < 500 * 499 / 2 / 8
    names = df.select(F.concat(F.lit("n"), "id").alias("id"), "v")
    assert nearjoin.near_pairs(names, 0.97).count() == nearjoin.near_pairs(df, 0.97).count()
    assert nearjoin.near_pairs(df.limit(0), 0.9).count() == 0


def test_vector_table_equals_a_scan(spark, tmp_path):
    x, df = clusters(spark, 600)
    df = df.withColumn("archived", F.col("id") % 3 == 0)
    table = vectortable.VectorTable(spark, f"file://{tmp_path}/v").build(df.repartition(3), cells=15, block=50)
    asks = df.where("id % 20 = 5").select(F.col("id").alias("query_id"), "v")
    size = np.sqrt((x * x).sum(1, keepdims=True))
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    for penalty in (0.0, 2.0):
        got = {}
        for r in table.search(asks, 6, penalty).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.score, 9))
        for q in range(5, 600, 20):
            order = np.round(u @ u[q] - penalty * (np.arange(600) % 3 == 0), 9)
            want = np.lexsort((np.arange(600), -order))[:6]
            assert [got[q][i + 1][0] for i in range(6)] == want.tolist()
    assert table.search(asks.limit(0), 6).count() == 0


def test_rows_are_copied_a_bounded_number_of_times(spark):
    """A threshold that hardly rules anything out, and cells of few rows."""
    x = np.random.default_rng(3).normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert nearjoin.dealt(df, 0.1, cell=8).count() <= len(x) * (nearjoin.CELLS // 2 + 1)


def test_bucket_counts_shuffle_no_words(spark):
    rows = spark.createDataFrame([(1, "a b a"), (1, "B"), (2, " "), (3, None), (4, "c")], "doc_id long, text string")
    got = {(r.id, r.bucket): r.w for r in similarity.hash_embedding(rows).collect()}
    assert sorted(got.values()) == pytest.approx([0.5**0.5, 0.5**0.5, 1.0]) and {i for i, _ in got} == {1, 4}
    plan = similarity.hash_embedding(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_vector_search_holds_few_scores_at_a_time(spark):
    """Scores of a piece of a batch are held, not of all its rows; the result is that of all scores."""
    assert similarity.PIECE * similarity.QUERIES * 8 <= 64 << 20
    x = np.random.default_rng(5).normal(size=(3000, 8)).round(1)
    df = spark.createDataFrame([(i, v.tolist(), i % 3 == 0) for i, v in enumerate(x)], "id long, v array<double>, archived boolean").repartition(2)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    order = np.round(u[::100] @ u.T - 2.0 * (np.arange(len(x)) % 3 == 0), 12)
    found = similarity.vector_search(df, df.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v"), 5, penalty=2.0)
    got = {(r.query_id, r.rank): r.id for r in lexical.ranked(found.withColumn("order", F.round("order", 12)), 5, score="order").collect()}
    for i, row in enumerate(order):
        best = np.lexsort((np.arange(len(x)), -row))[:5]
        assert [np.round(row[got[(100 * i, n)]], 9) for n in range(1, 6)] == np.round(row[best], 9).tolist()


def test_postings_shuffle_entries_once(spark):
    """Words are counted without a shuffle, and groups that span batches are gathered whole."""
    docs = spark.createDataFrame([(i, "a b " + "a " * (i % 3)) for i in range(50)] + [(50, None)], "id long, text string")
    counts = postings.term_counts(docs, "id", "text")
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.size, r.term): r["count"] for r in counts.where("id = 2").collect()} == {(2, 4, "a"): 3, (2, 4, "b"): 1}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = counts.select("term", F.pmod("id", F.lit(3)).alias("block"), "id", F.col("count").cast("double").alias("w"))
        got = {(r.term, r.block): r for r in postings._packed(rows.repartitionByRange(2, "term", "block").sortWithinPartitions("term", "block", "id", "w")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 6
    for (term, block), r in got.items():
        assert r.ids == list(range(block, 50, 3)) and r.n == len(r.ids)
        assert r.weights == [1.0 + (i % 3 if term == "a" else 0) for i in r.ids] and r.most == max(r.weights)
