"""A vault from files to answers."""

import pytest

from quillstone.vault import Vault

NOW = "2026-07-01 00:00:00"


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("notes")
    write(root, "10-people/ada.md", "---\nid: ADA\ntitle: Ada\npinned: true\nexpires: 2026-01-01\n---\n# Ada\nAda wrote about engines, see [[budget]] and [[nobody]].")
    write(root, "20-money/budget.md", "---\nid: BUD\ntitle: Budget\nupdated: 2026-06-30\nsource_ref: x://1\n---\n# Budget\nThe code zx81 stands in the budget of engines.")
    write(root, "20-money/copy.md", "---\nid: CPY\ntitle: Copy\n---\n# Budget\nThe code zx81 stands in the budget of engines.")
    write(root, "20-money/draft.md", "---\nid: DRA\n---\n# Budget\nThe code stands in the budget of engines, of engines.")
    write(root, "30-events/trip.md", "---\nid: TRP\ntitle: Trip\nstart: 2026-07-03T10:00:00Z\nexpires: 2026-06-01\n---\nA trip to the sea.")
    write(root, "00-inbox/idea.md", "---\nid: IDE\n---\n# Idea\n\nA thought.")
    write(root, "bad.md", "---\nno colon\n---\nx")
    out = Vault(spark, str(root), f"file://{tmp_path_factory.mktemp('tables')}", NOW)
    assert {r.change for r in out.index().collect()} == {"new"}
    return out, root


def test_documents(vault):
    v, _ = vault
    docs = {r.id: r for r in v.documents().collect()}
    assert set(docs) == {"ADA", "BUD", "DRA", "TRP", "IDE"}
    assert docs["DRA"].title == "Budget" and docs["DRA"].category == "20-money" and docs["ADA"].pinned
    assert [(r.path, r.canonical_id, r.canonical_path) for r in v.duplicates().collect()] == [("20-money/copy.md", "BUD", "20-money/budget.md")]
    assert [(r.a, r.b) for r in v.near_duplicates(0.8).collect()] == [("BUD", "DRA")]
    assert {(r.category, r.n) for r in v.status().collect()} == {("10-people", 1), ("20-money", 2), ("30-events", 1), ("00-inbox", 1)}
    assert [(r.id, r.summary) for r in v.inbox().collect()] == [("IDE", "A thought.")]
    assert {r.name: r.n for r in v.counts().collect()}["notes"] == 7
    assert v.get_note("x://1", 5).first().body == "# Bud" and v.get_note("ADA").first().path == "10-people/ada.md"
    assert [r.id for r in v.timeline("2026-07-01", "2026-07-04").collect()] == ["TRP"] and v.timeline("2026-07-04").count() == 0
    assert v.related("ADA").count() == 1 and v.relations_map().count() == 1 and v.sync_status().count() == 0


def test_search(vault):
    v, _ = vault
    assert [r.citation.document_id for r in v.search("zx81", mode="lexical").collect()] == ["BUD"]
    for mode in ("hybrid", "vector", "what"):
        assert v.search("zx81 budget engines", mode=mode).orderBy("rank").first().citation.document_id == "BUD"
    assert {r.citation.document_id for r in v.search("engines", category="10-people").collect()} == {"ADA"}
    cut = v.search("engines", max_chars=10, detail="full").collect()
    assert len(cut) == 1 and cut[0].has_more and "engines" in cut[0].text
    assert not v.search("engines").first().has_more
    with pytest.raises(ValueError):
        v.search("  ")
    with pytest.raises(ValueError):
        v.search("x", k=0)


def test_change_prune_restore(vault):
    v, root = vault
    write(root, "20-money/budget.md", "---\nid: BUD\n---\nQuite other words now.")
    (root / "00-inbox/idea.md").unlink()
    assert {(r.key, r.change) for r in v.index().where("change <> 'same'").collect()} == {("20-money/budget.md", "changed"), ("00-inbox/idea.md", "removed")}
    tables = ("notes", "chunks", "cells", "links", "events", "duplicates")
    plain = lambda: {t: sorted(map(repr, v.table(t).collect())) for t in tables}
    before = plain()
    v.rebuild()
    assert plain() == before and {r.id for r in v.documents().collect()} == {"ADA", "BUD", "CPY", "DRA", "TRP"}
    assert [r.document_id for r in v.prune_expired().collect()] == ["TRP"] and v.tombstones().count() == 0
    for _ in range(2):
        v.prune_expired(dry_run=False)
    assert v.tombstones().count() == 1
    gone = v.documents().where("id = 'TRP'").first()
    assert (gone.status, gone.path) == ("archived", "90-archive/30-events/trip.md")
    assert v.search("trip sea", status="active").where("citation.document_id = 'TRP'").count() == 0
    assert v.maintenance().where("document_id = 'TRP'").count() == 0
    v.restore("TRP")
    assert v.documents().where("id = 'TRP'").first().status == "active" and v.tombstones().count() == 0
    v.record(v.search("sea trip", mode="lexical"))
    v.record(v.search("sea trip", mode="lexical"))
    assert [(r.document_id, r.access_count) for r in v.table("signals").collect()] == [("TRP", 2)]
    assert v.explain_prune("ADA").first().pinned == 1000.0
    more = v.spark.createDataFrame([("TRP", "2", "b"), ("TRP", "1", "a")], "id string, at string, text string")
    assert v.append(more).first().text.endswith("A trip to the sea.\n\na\nb\n")
    assert len(v.versions()["notes"]) >= 3


def test_tick_and_capture(spark, tmp_path):
    write(tmp_path, "10-a/one.md", "---\nid: ONE\nexpires: 2026-01-01\n---\n# One\nSome words about engines and budgets.")
    v = Vault(spark, str(tmp_path), f"file://{tmp_path}/.tables", NOW)
    v.index()
    new = spark.createDataFrame([("a", "# One\nSome words about engines and budgets!"), ("b", "nothing like it"), ("c", "nothing like it")], "id string, body string")
    assert {r.id: (r.decision, r.target) for r in v.capture(new, on_similar="append").collect()} == {"a": ("append", "ONE"), "b": ("create", None), "c": ("duplicate", "b")}
    assert [r.document_id for r in v.tick().collect()] == ["ONE"] and v.tombstones().count() == 0
    assert [r.document_id for r in v.tick(apply=True).collect()] == ["ONE"] and v.tombstones().count() == 1
    page = [p for p in tmp_path.rglob("*.md") if p.name != "one.md"]
    assert len(page) == 1 and page[0].read_text().count("tick: 1") == 2 and "tick: 1 to archive" in page[0].read_text()
    backups = v.tables.read("backups", "at timestamp, name string, version string").collect()
    assert {r.name for r in backups} >= {"notes", "chunks", "cells"}
    assert v.get_note("ONE").count() == 1 and v.table("cells").select("id").distinct().count() == v.table("chunks").count()
