"""Goldens for what the SQL oracle cannot reach, and differential tests."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import frontmatter, text, time
from quillstone.operators import chunking, files, lexical, lifecycle, mail, relations, search, state
from quillstone.sources import paged
from quillstone.sources.files import documents, notes, raw
from quillstone.sources.tables import Tables
from quillstone.streaming import jobs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("fields", [{"title": "a: b", "tags": ["x", "y"], "importance": 0, "pinned": False, "expires": None, "extra": "2026-06-29"}, {"title": " pad ", "people": []}, {"a": "true", "b": "12", "c": -3}])
def test_frontmatter_round_trip(fields):
    assert frontmatter.read(frontmatter.write(fields, "body\n")) == (fields, "\nbody")


def test_frontmatter_errors_are_columns(spark):
    rows = spark.createDataFrame([("---\na: 1\n- b",), ("---\nnope\n---\n",), ("---\nt:\n  - x\n  - 2\n# c\n---\nhi",), ("plain",), (None,)], "t string")
    got = rows.select(frontmatter.parsed(F.col("t")).alias("p")).select("p.*").collect()
    assert [r.error is None for r in got] == [False, False, True, True, True]
    assert json.loads(got[2].frontmatter) == {"t": ["x", 2]} and got[2].body == "hi"


NESTED = "# A\n\n<!-- page: 7 -->\n## B\nsome text\n\n$$\nx = 1\n\ny = 2\n$$\n\n```\n# not a heading\n```\n### C\n\\begin{align}\na\n\nb\n\\end{align}\nlast"


def test_chunker():
    got = list(chunking.chunks(NESTED, target=12))
    assert [c[1] for c in got if c[4].startswith("#")] == ["A", "A > B", "A > B > C"]
    assert any("x = 1\n\ny = 2" in c[4] for c in got) and any("# not a heading" in c[4] for c in got) and any("a\n\nb" in c[4] for c in got)
    assert [c[3] for c in got if c[1] == "A > B"][0] == 7 and [c[0] for c in got] == list(range(len(got)))
    assert list(chunking.chunks("  \n ")) == [] and list(chunking.chunks("")) == []
    assert len(list(chunking.chunks("$$ " + "x + " * 200 + " $$", target=5))) == 1
    assert [c[1] for c in chunking.chunks("# A\n### B\n### C")] == ["A", "A > B", "A > B > C"]
    assert [c[1] for c in chunking.chunks("no heads")] == [""]


def test_chunker_overlap():
    md = "# H\n" + "\n".join(f"<!-- page: {i} -->\n" + f"w{i} " * 30 for i in range(4))
    got = list(chunking.chunks(md, target=40, overlap=0.1))
    assert len(got) > 2 and all(a[4].split()[-1] in b[4] for a, b in zip(got, got[1:], strict=False))


def test_chunk_frame(spark):
    rows = chunking.chunk(spark.createDataFrame([("s", "# A\nx"), ("t", None)], "source string, text string")).collect()
    assert [(r.chunk_id, r.heading_path, r.page) for r in rows] == [("s#0", "A", None)]


def test_bm25_and_filters(spark):
    chunks = spark.createDataFrame([("a", "code zx9 here"), ("b", "other words"), ("c", None)], "chunk_id string, text string")
    ask = lambda t: spark.createDataFrame([(1, t)], "query_id long, text string")
    assert [r.id for r in lexical.bm25(chunks, ask("ZX9 zx9")).collect()] == ["a"]
    assert lexical.bm25(chunks, ask("")).count() == 0
    lists = [spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(o)], "query_id long, id string, rank int") for o in ("ab", "bc")]
    assert [r.id for r in search.fuse(lists).orderBy("rank").collect()] == ["b", "a", "c"]
    late = spark.createDataFrame([("b",)], "id string")
    assert [r.id for r in search.fuse(lists, late).orderBy("rank").collect()] == ["a", "c", "b"]


def test_sections(spark):
    rows = spark.createDataFrame([("s", "# A\nx\n## B\ny\n### C\nz\n## D\nw")], "source string, text string")
    assert search.get_section(rows, "A > b").first().text == "## B\ny\n### C\nz"
    assert search.get_section(rows, "none").count() == 0


def test_links_and_graph(spark):
    docs = spark.createDataFrame([("1", "people/jane-doe.md", "Jane Doe", "x"), ("2", "a.md", "A", "see [[jane-doe]], [[Jane Doe|her]], [[gone]], [[jane-doe]]")], "id string, path string, title string, body string")
    links = relations.resolve_links(relations.extract_links(docs), docs)
    assert sorted((r.dst_target, r.dst_document) for r in links.collect()) == [("Jane Doe", "1"), ("gone", None), ("jane-doe", "1")]
    assert relations.incoming_counts(links).first().incoming == 2
    chunks = spark.createDataFrame([("c1", "s1", "Heat > Entropy", "about it"), ("c2", "s2", "Music", "entropy of sound")], "chunk_id string, source string, heading_path string, text string")
    assert [(r.src, r.dst) for r in relations.graph_mentions(chunks).collect()] == [("c2", "Heat > Entropy")]


def test_time(spark):
    assert one(spark, time.parse_iso(F.col("a")), a="2026") is None and one(spark, time.parse_iso(F.col("a")), a="bad") is None
    assert str(one(spark, time.parse_iso(F.col("a")), a="2026-07-04T10:00:00Z")) == "2026-07-04 10:00:00"
    stamp = lambda a, b: str(one(spark, time.message_time(F.col("a"), F.col("b"), "2026-01-01 00:00:00"), a=a, b=b))
    assert stamp("1700000000000", None) == "2023-11-14 22:13:20" and stamp(None, "Tue, 7 Jul 2026 10:00:00 +0200") == "2026-07-07 08:00:00" and stamp("x", "y") == "2026-01-01 00:00:00"
    assert one(spark, time.week_key(F.to_timestamp("a")), a="2027-01-01") == "2026-W53"


def test_text(spark):
    assert one(spark, text.slugify(F.col("a")), a="  Hello, World! a b c d e f g") == "hello-world-a-b-c-d-e-f" and one(spark, text.slugify(F.col("a")), a="é") == "note"
    assert one(spark, text.snippet(F.col("a"), 10), a="aaaa bbbb cccc") == "aaaa bbbb…"
    assert one(spark, text.fallback_title(F.col("a"), F.col("b")), a="x\n## T t\n", b="p/q.md") == "T t" and one(spark, text.fallback_title(F.col("a"), F.col("b")), a="x", b="p/my-note.md") == "my note"
    assert one(spark, text.clean_snippet(F.col("a")), a="Hi​  there͏ view this email in your browser") == "Hi there"


def test_files(spark):
    kind = lambda n, size=0, pages=None: spark.range(1).select(files.doc_type(F.lit(n), F.lit(size), F.lit(pages).cast("int")).alias("x")).first().x
    assert [kind(n) for n in ("PracticeMidterm.pdf", "Assignment01.pdf", "exam_solutions.pdf", "01 Intro.pdf", "misc.pdf")] == ["exam", "assignment", "solutions", "slides", "notes"]
    assert kind("Physics", 6_000_000, 200) == "textbook"
    state_ = spark.createDataFrame([("a", "h1", 1, 1.0, False), ("b", "h2", 1, 1.0, False), ("c", "h3", 1, 1.0, False)], "path string, content_hash string, size_bytes long, mtime double, missing boolean")
    now = spark.createDataFrame([("a", "h1", 1, 1.0), ("b", "h9", 2, 2.0), ("d/c", "h3", 1, 1.0), ("e", "h1", 1, 1.0), ("f", "h7", 1, 1.0)], "path string, content_hash string, size_bytes long, mtime double")
    assert {r.path: r.action for r in files.scan(state_, now).collect()} == {"a": "skipped", "b": "updated", "d/c": "moved", "e": "duplicate", "f": "new"}


def test_mail(spark):
    rows = spark.createDataFrame([("1", ["SPAM", "STARRED"], False), ("2", ["STARRED", "CATEGORY_PROMOTIONS"], False), ("3", ["IMPORTANT"], True), ("4", None, None), ("", [], False)], "id string, labels array<string>, listed boolean")
    assert {r.id: (r.klass, r.action) for r in mail.triage(rows).collect()} == {"1": ("excluded", "skip"), "2": ("starred", "keep"), "3": ("bulk", "digest"), "4": ("personal", "keep")}
    raw_ = spark.createDataFrame([("m", ["INBOX"], "hello", ([("from", "Ann"), ("SUBJECT", "Hi")],))], "id string, labelIds array<string>, snippet string, payload struct<headers:array<struct<name:string,value:string>>>")
    note = mail.message_notes(raw_).first()
    assert note.title == "Hi" and note.body == "# Hi\n\n- **From:** Ann\n- **Labels:** INBOX\n\nhello\n\n<!-- source_ref: gmail://msg/m -->\n"


def test_lifecycle(spark):
    w = lifecycle.Weights.parse("w_links: 2 # more\nunknown: 1\n")
    assert w.w_links == 2 and lifecycle.Weights.parse(w.dump()) == w
    with pytest.raises(ValueError):
        lifecycle.Weights.parse("w_age: much")


def test_incremental_index_equals_rebuild(spark):
    schema = "id string, path string, body string"
    before = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y"), ("3", "c", "x ")], schema)
    after = spark.createDataFrame([("2", "b", "x"), ("3", "c", "x "), ("4", "d", "z")], schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(state.index(after, state.index(before))) == rows(state.index(after))


def test_capture(spark):
    docs = spark.createDataFrame([("1", "x")], "id string, body string")
    new = spark.createDataFrame([("a", " x "), ("b", "near"), ("c", " "), ("d", "fresh")], "id string, body string")
    near = spark.createDataFrame([("b", "1", 0.95)], "new_id string, id string, score double")
    plan = lambda **k: {r.id: (r.decision, r.target) for r in state.capture_plan(new, docs, near, **k).collect()}
    assert plan(on_similar="append") == {"a": ("duplicate", "1"), "b": ("append", "1"), "c": ("empty", None), "d": ("create", None)}
    assert plan(force_new=True)["b"] == ("create", None)


def test_sources_and_tables(spark, tmp_path):
    for p in ("n/a.md", "n/.vault/b.md", "n/sub/c.md", "n/.venv/d.md", "n/README.md", "n/x.csv"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"text of {p}")
    root = f"{tmp_path}/n"
    assert {r.path for r in notes(spark, root).collect()} == {"a.md", "sub/c.md", "README.md"}
    assert {r.path for r in documents(spark, root).collect()} == {"a.md", "sub/c.md", "README.md"}
    assert "README.md" not in {r.path for r in raw(spark, root).collect()}
    t = Tables(spark, f"file://{tmp_path}/t")
    assert t.read("x", "a int").count() == 0
    t.write("x", spark.createDataFrame([(1,)], "a int"))
    t.write("x", spark.createDataFrame([(2,), (3,)], "a int"))
    assert t.read("x", "a int").count() == 2 and len(t.versions("x")) == 2


def listing(cursor):
    data = {None: (["1", "2"], "c1"), "c1": (["3"], "c2"), "c2": ([], "c2")}
    if cursor == "old":
        raise paged.Expired
    return data[cursor]


def test_paged_source():
    assert paged.pages(listing, None) == (["1", "2", "3"], "c2")
    assert paged.pages(listing, "old") == (["1", "2", "3"], "c2") and paged.pages(listing, "c2") == ([], "c2")


def test_stream_sync_is_idempotent(spark, tmp_path):
    t, schema = Tables(spark, f"file://{tmp_path}/t"), "source_ref string, body string"
    for i, rows in enumerate(([("a", "1"), ("b", "2")], [("a", "3")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.sync(stream, t, "notes", schema, "source_ref", lambda df: df, f"{tmp_path}/ck").awaitTermination()
    assert sorted(map(tuple, t.read("notes", schema).collect())) == [("a", "3"), ("b", "2")]
