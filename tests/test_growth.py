"""Steps whose work grew faster than their input: the same results by bounded means."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.operators import chunking, lexical, relations, search, similarity, topk
from quillstone.streaming import stateful

WORDS = ["apple", "pear", "plum", "fig", "kiwi", "the", "of", "zx9"]


def texts(n, seed, kind="chunk_id string, text string", name="c{:03d}".format):
    rng = random.Random(seed)
    rows = [(name(i), rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 9))), "apple pear"])) for i in range(n)]
    return rows, kind


def plain(rows):
    return sorted((r.query_id, r.id, r["rank"], round(r.score, 9)) for r in rows.collect())


def nearest(docs, asks, k):
    qw = similarity.hash_embedding(asks, "query_id").select(F.col("id").alias("query_id"), "bucket", F.col("w").alias("qw"))
    score = similarity.hash_embedding(docs, "chunk_id").join(qw, "bucket").groupBy("query_id", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return lexical.ranked(score, k)


@pytest.mark.parametrize("repeated", [False, True])
def test_best_of_tasks_are_the_best_of_all(spark, monkeypatch, repeated):
    """Texts alike tie, questions go out in several blocks, some have no words; rows that share an id count as one."""
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows, kind = texts(400, 1)
    rows = rows + [("c003", "fig fig apple")] if repeated else rows
    docs = spark.createDataFrame(rows, kind).repartition(7)
    asks = spark.createDataFrame(*texts(10, 2, "query_id long, text string", int))
    for k in (1, 5):
        assert plain(lexical.ranked(lexical.bm25_top(docs, asks, k), k)) == plain(lexical.ranked(lexical.bm25(docs, asks), k))
        assert plain(lexical.ranked(similarity.hash_top(docs, asks, k, "chunk_id"), k)) == plain(nearest(docs, asks, k))


def test_a_task_gives_its_best_alone(spark):
    """Two tasks and five questions give ten times ``k`` rows at most, and no text, word or embedding is shuffled."""
    docs = spark.createDataFrame(*texts(2000, 3)).coalesce(2)
    asks = spark.createDataFrame([(i, " ".join(WORDS)) for i in range(5)], "query_id long, text string")
    for made in (lexical.bm25_top(docs, asks, 4), similarity.hash_top(docs, asks, 4, "chunk_id")):
        assert 20 <= made.count() <= 40
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan


def test_search_shuffles_no_texts(spark):
    rows = [(f"c{i}", "d", "p", "t", "", None, "s", "archived" if i % 3 else "active", f"apple {'plum ' * (i % 5)}") for i in range(50)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, path string, title string, heading_path string, page int, source string, status string, text string")
    asks = spark.createDataFrame([(1, "apple plum"), (2, "none such")], "query_id long, text string")
    got = search.search(chunks, asks, k=4, max_chars=10**6)
    assert {(r.query_id, r["rank"], r.has_more) for r in got.collect()} == {(1, i, False) for i in range(1, 5)}
    assert "apple" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("many", [False, True])
def test_titles_are_looked_for_where_texts_are_read(spark, monkeypatch, many):
    """Titles of one word and more, with signs, under their own heading, in longer words; few titles shuffle nothing, many find the same."""
    if many:
        monkeypatch.setattr(relations, "NAMED", 0)
    heads = ["Heat > Cold fusion", "Heat > C++ (draft)", "Übersicht: eins > Heat", "Deep > Heat pump", "!!!!"]
    said = ["cold fusion, heat", "COLD-FUSION and heat pumps; heat", "c++ (draft)x deep", "ÜBERSICHT: eins, heat pump!", None, "xx c++ (draft) deep-heat"]
    rows = [(f"c{i}", "s", heads[i % 5], said[i % 6]) for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, heading_path string, text string")
    got = relations.graph_mentions(chunks)
    # as \b has it, a sign at the end of a title is followed by a word
    titles = {"c++ (draft)": ["Heat > C++ (draft)"], "heat": ["Heat", "Übersicht: eins > Heat"], "cold fusion": ["Heat > Cold fusion"], "übersicht: eins": ["Übersicht: eins"], "deep": ["Deep"], "heat pump": ["Deep > Heat pump"]}
    held = [{"cold fusion", "heat"}, {"heat"}, {"c++ (draft)", "deep"}, {"übersicht: eins", "heat", "heat pump"}, set(), {"deep", "heat"}]
    want = {(f"c{i}", n) for i in range(30) for t in held[i % 6] - {x.lower() for x in heads[i % 5].split(" > ")} for n in titles[t]}
    assert sorted((r.src, r.dst) for r in got.collect()) == sorted(want)
    if not many:
        names = spark.createDataFrame([("heat",), ("cold fusion",)], "title string")
        assert "Exchange hashpartitioning" not in relations._mentioned(chunks, names)._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_handed_on_in_bounded_pieces():
    text = pa.array(["# A\n" + "x" * (chunking.HELD // 4)] * 9 + ["y"] * 20 + [None])
    out = list(chunking._cut([pa.RecordBatch.from_arrays([pa.array(map(str, range(30))), text], ["s", "t"])] * 2, 650, 0.1))
    assert sum(b.num_rows for b in out) == 2 * sum(len(list(chunking.chunks(t or ""))) for t in text.to_pylist())
    assert len(out) > 3 and max(b.nbytes for b in out) < 2 * chunking.HELD


def test_a_digest_reads_and_writes_its_state_by_parts():
    """A batch of many messages touches the state as often as there are parts, not as there are messages."""
    calls = []

    class State(dict):
        exists = lambda self: bool(self)
        get = lambda self: dict.get(self, "v")
        update = lambda self, v: self.__setitem__("v", v)
        iterator = lambda self: iter(self.items())
        containsKey = lambda self, k: calls.append(k) or k in self
        getValue = lambda self, k: calls.append(k) or self[k]
        updateValue = lambda self, k, v: calls.append(k) or self.__setitem__(k, v)

    week = stateful._Digests()
    week.lines, week.title = State(), State()
    batch = lambda a, b: [pd.DataFrame({"message_id": [str(i) for i in range(a, b)], "title": "T", "line": [f"- {i:06d}" for i in range(a, b)]})]
    assert [r.n[0] for r in week.handleInputRows(("w",), iter(batch(0, 9000)), None)] == [9000]
    got = list(week.handleInputRows(("w",), iter(batch(5000, 12000)), None))
    assert got[0].n[0] == 12000 and got[0].body[0].split("\n")[4] == "- 011999"
    assert list(week.handleInputRows(("w",), iter(batch(0, 12000)), None)) == []
    assert len(calls) <= 6 * stateful.PARTS
