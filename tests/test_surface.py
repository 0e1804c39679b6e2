"""The store's contract, ingest, embedders, converters, renames, scans, streams and paged sources."""

import json

import numpy as np
import pytest
from quillstone.functions import embedders
from quillstone.operators import capturing, files, filing, knowledge, relations, similarity, syncing
from quillstone.sources import convert, paged
from quillstone.sources.tables import Tables
from quillstone.streaming import jobs

CHUNKS = "chunk_id string, source string, heading_path string, page int, text string"
NOW = "2024-02-01 00:00:00"


def test_store_contract(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    store = knowledge.Store(spark, root)
    rows = lambda *x: spark.createDataFrame([(f"{s}#{i}", s, f"{s} > h", 1, t) for s, i, t in x], CHUNKS)
    store.upsert(rows(("a.md", 0, "apple apple"), ("a.md", 1, "banana")))
    store.upsert(rows(("b.md", 0, "cherry")))
    assert knowledge.Store(spark, root).all_records().count() == 0  # not saved yet
    store.save()
    assert [r.source for r in store.sources().collect()] == ["a.md", "b.md"] and store.all_records().count() == 3
    ask = lambda text: similarity.hash_embedding(spark.createDataFrame([(0, text)], "q int, text string"), "q").withColumnRenamed("id", "query_id")
    top = store.query(ask("apple"), 2).orderBy("rank").first()
    assert top.citation.chunk_id == "a.md#0" and top.citation.heading_path == "a.md > h" and top.score == pytest.approx(1.0)
    store.upsert(rows(("a.md", 1, "damson")))
    assert store.all_records().count() == 3 and store.query(ask("banana"), 3).count() == 0
    store.delete_source("a.md")
    store.save()
    again = knowledge.Store(spark, root)
    assert [r.source for r in again.sources().collect()] == ["b.md"] and again.query(ask("cherry"), 1).first().citation.chunk_id == "b.md#0"
    again.delete_source("ghost.md")
    assert again.all_records().count() == 1
    with pytest.raises(ValueError):
        knowledge.search(again.all_records(), "  ")
    with pytest.raises(ValueError):
        knowledge.search(again.all_records(), "x", 0)


def test_ingest_builds_a_graph_that_is_read_again(spark, tmp_path):
    store = knowledge.Store(spark, f"file://{tmp_path}/store")
    texts = {"optics.md": "# Optics\n\n## Refraction\n\nLight bends.", "math.txt": "# Algebra\n\nRefraction is in another note.", "scan.pdf": "x"}
    raw = spark.createDataFrame([(k, v.encode()) for k, v in texts.items()], "path string, content binary")
    said = {(r.what, r.name) for r in knowledge.ingest(store, raw).collect()}
    assert {("converted", "optics.md"), ("indexed", "math.md")} <= said and any(w == "error" and n.startswith("scan.pdf") for w, n in said)
    nodes, contains, mentions = knowledge.Store(spark, f"file://{tmp_path}/store").graph()
    assert [(r.src, r.dst) for r in mentions.collect()] == [("math.md#0", "Optics > Refraction")]
    found = relations.related_concept("refraction", contains, mentions, nodes).first()
    assert (found.id, found.parent, found.direct_chunks, found.topics) == ("Optics > Refraction", "Optics", 1, ["Algebra"])
    assert relations.related_concept("nothing", contains, mentions, nodes).count() == 0
    out = knowledge.synthesize("algebra in another note", store.all_records(), contains, mentions, nodes, k=1)
    assert [(r.chunk_id, r.why) for r in out.collect()] == [("math.md#0", "vector match"), ("optics.md#1", "related concept")]
    assert {r.what for r in knowledge.ingest(store, raw).collect()} == {"skipped", "error"}
    assert knowledge.ingest(store, raw, incremental=False).where("what = 'indexed'").count() == 2


def test_embedders(spark):
    rows = spark.createDataFrame([("x", "aab"), ("y", None)], "id string, text string")
    embedders.register("counts", lambda: lambda texts: np.array([[len(t), t.count("a"), 0.0] for t in texts]))
    assert embedders.names() == ["counts", "hash"]
    got = {r.id: r.v for r in embedders.embed(rows, "counts").collect()}
    assert got["x"] == pytest.approx([3 / 13**0.5, 2 / 13**0.5, 0]) and got["y"] == [0, 0, 0]
    made = {r.id: r.v for r in embedders.embed(rows).collect()}
    assert sum(x * x for x in made["x"]) == pytest.approx(1) and made["y"] == [0.0] * similarity.DIM
    with pytest.raises(ValueError):
        embedders.embed(rows, "none")


def test_converters(spark):
    def pages_of(content):
        if content == b"bad":
            raise ValueError("not a PDF")
        return [p.decode() for p in content.split(b"|")], "Untitled"

    rows = spark.createDataFrame([("a.PDF", b"A first line here|two"), ("b.pdf", b"bad"), ("c.md", b"# x \xff"), ("d.xls", b"1")], "path string, content binary")
    got = {r.path: r for r in convert.to_markdown(rows, pages_of).collect()}
    assert got["a.PDF"].text == "<!-- page: 1 -->\n\nA first line here\n\n<!-- page: 2 -->\n\ntwo" and got["a.PDF"].scanned
    assert got["b.pdf"].error == "not a PDF" and got["c.md"].text == "# x �" and got["d.xls"].error == "unsupported file type: .xls"
    fields = {r.path: r for r in convert.pdf_fields(rows.where("lower(path) LIKE '%.pdf'"), pages_of).collect()}
    assert (fields["a.PDF"].pages, fields["a.PDF"].meta_title, fields["a.PDF"].first_line) == (2, None, "A first line here") and fields["b.pdf"].pages is None
    assert convert.pdf_pages(rows.where("path = 'b.pdf'")).first().error in ("no PDF converter is installed", "not a PDF") or convert.installed()


def test_renames_are_undone(spark, tmp_path, tmp_path_factory):
    (tmp_path / "c").mkdir()
    for name in ("a.pdf", "b.pdf", "copy.pdf", "C_x_notes.pdf"):
        (tmp_path / "c" / name).write_text(name)
    plan = spark.createDataFrame([(1, "c/a.pdf", "c/C_x_notes.pdf"), (2, "c/gone.pdf", "c/y.pdf"), (3, "c/b.pdf", "c/z.pdf")], "id long, old_path string, new_path string")
    log = Tables(spark, f"file://{tmp_path_factory.mktemp('log')}")
    done = filing.apply_renames(plan, str(tmp_path), log)
    assert sorted((d.id, d.to_path) for d in done.collect()) == [(1, "c/C_x_notes-1.pdf"), (3, "c/z.pdf")] and (tmp_path / "c" / "C_x_notes-1.pdf").read_text() == "a.pdf"
    catalog = spark.createDataFrame([(1, "c/a.pdf", False), (2, "c/gone.pdf", False)], "id long, current_path string, renamed boolean")
    assert [tuple(r) for r in filing.renamed(catalog, done).orderBy("id").collect()] == [(1, "c/C_x_notes-1.pdf", True), (2, "c/gone.pdf", False)]
    back = filing.undo_renames(str(tmp_path), log)
    assert {d.to_path for d in back.collect()} == {"c/a.pdf", "c/b.pdf"} and log.read("renames", filing.RENAMES).count() == 0 and filing.undo_renames(str(tmp_path), log).count() == 0
    many = spark.createDataFrame([(i, f"c/{n}.pdf", "c/C_x_notes.pdf") for i, n in enumerate(("a", "b", "copy"))], "id long, old_path string, new_path string")
    assert sorted(r.new_path for r in filing.free_names(many, filing.present(spark, str(tmp_path))).collect()) == ["c/C_x_notes-1.pdf", "c/C_x_notes-2.pdf", "c/C_x_notes-3.pdf"]
    copies = spark.createDataFrame([("c/copy.pdf",)], "path string")
    assert filing.delete_duplicate_files(copies, str(tmp_path)) == ["c/copy.pdf"] and (tmp_path / "c" / "copy.pdf").exists()
    filing.delete_duplicate_files(copies, str(tmp_path), sure=True)
    assert not (tmp_path / "c" / "copy.pdf").exists()


def test_scan_reports_missing_once_and_the_second_of_two_equal_edits(spark):
    kind = "path string, content_hash string, size_bytes long, mtime double"
    state = spark.createDataFrame([("gone", "g", 1, 1.0, True), ("left", "l", 1, 1.0, False), ("p", "1", 1, 1.0, False), ("q", "2", 1, 1.0, False), ("r", "3", 1, 1.0, False)], kind + ", missing boolean")
    snapshot = spark.createDataFrame([("p", "new", 1, 2.0), ("q", "new", 1, 2.0), ("r", "3", 1, 1.0), ("s", "new", 1, 2.0)], kind)
    assert {r.path: r.action for r in files.scan(state, snapshot).collect()} == {"left": "missing", "p": "updated", "q": "duplicate", "r": "skipped", "s": "duplicate"}


def test_newest_row_of_a_key_wins(spark, tmp_path):
    schema = "k string, v string, at int"
    spark.createDataFrame([("a", "new", 2), ("a", "old", 1), ("b", "x", 1)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    tables = Tables(spark, f"file://{tmp_path}/t")
    stream = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    for number in range(2):  # a batch that is replayed changes nothing
        jobs.sync(stream(), tables, "notes", schema, "k", lambda df: df, f"file://{tmp_path}/c{number}", "at").awaitTermination()
        assert sorted(tuple(r) for r in tables.read("notes", schema).collect()) == [("a", "new", 2), ("b", "x", 1)]


def test_ticks_go_on_after_one_fails(spark, tmp_path):
    spark.range(4).repartition(2).write.parquet(f"file://{tmp_path}/in")
    seen = []

    def tick(rows, number):
        seen.append(number)
        if number == 0:
            raise RuntimeError("one bad night")

    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = jobs.every(stream, tick, f"file://{tmp_path}/c", seconds=0)
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 2 and query.exception() is None


PAGES = {None: (["1", "2"], "c1"), "c1": (["3"], "c2"), "c2": (["4"], "c3"), "c3": ([], "c3")}


def test_replay_ends_where_the_batch_ended():
    assert paged.pages(PAGES.__getitem__, None) == (["1", "2", "3", "4"], "c3")
    assert paged.pages(PAGES.__getitem__, "c1", end="c2") == (["3"], "c2")
    reader = paged._Stream.__new__(paged._Stream)
    reader.fetch = PAGES.__getitem__
    assert list(reader.readBetweenOffsets({"cursor": None}, {"cursor": "c1"})) == [("1",), ("2",)]
    assert list(reader.readBetweenOffsets({"cursor": "c1"}, {"cursor": "c1"})) == []
    calls = iter([paged.Expired(), (["a"], "n"), ([], "n")])

    def fetch(cursor):
        got = next(calls)
        if isinstance(got, Exception):
            raise got
        return got

    assert paged.pages(fetch, "stale") == (["a"], "n")


def test_mentions_need_whole_words_in_any_script(spark):
    rows = [("1", "s", "Snell's law > 光学 入門", "x"), ("2", "s", "Other", "see snell's LAW, then 光学 入門."), ("3", "s", "Other", "Snell's laws and 光学入門 and xOther"), ("4", "s", "????", "a????b")]
    got = relations.graph_mentions(spark.createDataFrame(rows, "chunk_id string, source string, heading_path string, text string"))
    assert sorted((r.src, r.dst) for r in got.collect()) == [("2", "Snell's law"), ("2", "Snell's law > 光学 入門")]


def test_best_similar(spark):
    v = lambda *x: spark.createDataFrame([(i, list(map(float, a))) for i, a in x], "id long, v array<double>")
    near = capturing.best_similar(v((1, (1, 0)), (2, (1, 1))), v((7, (1, 0)), (8, (2, 0)), (9, (0, 1))), 0.9)
    assert [(r.new_id, r.id) for r in near.collect()] == [(1, 7)]


def test_a_digest_that_gains_nothing_stays(spark):
    kind = "id string, labelIds array<string>, snippet string, internalDate string, payload struct<headers array<struct<name string, value string>>>"
    rows = [("m1", ["CATEGORY_UPDATES"], "s", "1706745600000", ([("From", "x"), ("Subject", "y")],)), ("m2", ["INBOX"], "s", "1706745600000", ([("From", "x")],)), (None, None, None, None, None)]
    messages = spark.createDataFrame(rows, kind)
    first, summary = syncing.sync_messages(spark.createDataFrame([], syncing.NOTES), messages, NOW)
    assert {r.what: r.n for r in summary.collect()} == {"count": 3, "kept": 1, "digested": 1, "repeated": 0, "skipped": 1, "created": 2, "class:bulk": 1, "class:personal": 1}
    first = spark.createDataFrame(first.collect(), syncing.NOTES)
    again, summary = syncing.sync_messages(first, messages, "2024-03-01 00:00:00")
    assert {r.what: r.n for r in summary.where("what IN ('created', 'updated', 'unchanged')").collect()} == {"unchanged": 2}
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    assert syncing.sync_messages(first.limit(0), messages, NOW, digest=False)[0].count() == 1
    assert syncing.sync_messages(first.limit(0), messages, NOW, label="INBOX")[0].count() == 1


def test_captured_paths_are_never_shared(spark):
    """Two of these ids end in the same six digits; a document holds the short path of a third."""
    same = (40226, 68679)
    new = [(i, "T", "", f"b{i}") for i in (3, *same)]
    rows = spark.createDataFrame(new, "id long, title string, category string, body string")
    none = spark.createDataFrame([], "new_id long, id string, score double")
    docs = lambda *paths: spark.createDataFrame([("d", "other", p) for p in paths], "id string, body string, path string")
    paths = lambda d: {r.body: r.path for r in capturing.capture(rows, d, none, NOW)[1].collect()}
    first = paths(docs("00-inbox/t.md"))
    assert len(first) == 3 and len(set(first.values())) == 3 and sorted(len(p) for p in first.values()) == [len("00-inbox/t-123456.md")] * 2 + [len("00-inbox/t-.md") + 26]
    other = first["# T\n\nb3"]
    again = paths(docs("00-inbox/t.md", other))
    assert other not in again.values() and len(set(again.values())) == 3


def test_journal_keeps_the_order_of_one_moment(spark):
    at = "TIMESTAMP '2024-01-05 10:00:00'"
    entries = spark.sql(f"SELECT * FROM VALUES ({at}, 'b', 2L), ({at}, 'a', 10L), ({at}, 'c', 1L) AS t(at, text, seq)")
    pages = spark.createDataFrame([], "path string, title string, body string")
    body = capturing.journal(pages, entries).first().body
    assert [line for line in body.split("\n") if line in "abc" and line] == ["c", "b", "a"]


def test_fresh_state_counts_whole_seconds(spark):
    rows = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-22 00:00:00' AS at UNION ALL SELECT 2, TIMESTAMP '2024-01-22 00:00:00.5' UNION ALL SELECT 3, TIMESTAMP '2024-01-22 00:00:01' UNION ALL SELECT 4, NULL")
    assert sorted(r.id for r in jobs.fresh(rows, NOW, 10).collect()) == [3, 4]


def test_found_documents_of_equal_names_come_by_id(spark):
    rows = [(i, "C/x.pdf", "C", "exam", "x", "x", "x.pdf", False) for i in range(60, 0, -1)]
    catalog = spark.createDataFrame(rows, "id long, current_path string, course string, doc_type string, descriptive_name string, title string, original_filename string, missing boolean").repartition(4)
    assert [r.id for r in files.find_documents(catalog, "x").collect()] == list(range(1, 21))


def test_best_similar_brings_no_vector_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(similarity, "vector_search", None)
    x = np.random.default_rng(4).normal(size=(400, 4))
    x[3] = 0
    x[7] = x[9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    score = np.round(u[1::2] @ u[::2].T, 12)
    want = {(2 * i + 1, 2 * int(s.argmax())) for i, s in enumerate(score) if s.max() >= 0.9}
    got = capturing.best_similar(df.where("id % 2 = 1"), df.where("id % 2 = 0"), 0.9).collect()
    assert len(want) > 50 and {(r.new_id, r.id) for r in got} == want and len(got) == len(want)
