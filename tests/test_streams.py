"""Streams with state, and the listed source, against their batch forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import mail
from quillstone.sources import paged
from quillstone.sources.tables import Tables
from quillstone.streaming import jobs, stateful


def files_of(batches, schema, spark, folder):
    """One Parquet file a batch, read as a stream in that order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in{i}")
    import os
    import time

    os.makedirs(f"{folder}/in", exist_ok=True)
    for i in range(len(batches)):
        part = next(p for p in os.listdir(f"{folder}/in{i}") if p.endswith(".parquet"))
        os.rename(f"{folder}/in{i}/{part}", f"{folder}/in/{i:03d}.parquet")
        os.utime(f"{folder}/in/{i:03d}.parquet", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")


def run(stream, folder, mode="append"):
    got = []
    query = stream.writeStream.foreachBatch(lambda df, n: got.append((n, [r[:] for r in df.collect()]))).outputMode(mode).option("checkpointLocation", f"file://{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return got


def test_runs_expire_and_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(4)
    events = sorted((rng.randrange(5000), f"k{rng.randrange(4)}") for _ in range(150))
    rows = [(k, t) for t, k in events]
    chunks = [rows[i : i + 30] for i in range(0, 150, 30)] + [[("end", 10**6)], [("end", 2 * 10**6)]]
    for c in chunks:
        rng.shuffle(c)
    stream = files_of(chunks, "key string, s long", spark, tmp_path).select("key", F.timestamp_seconds("s").alias("at"))
    got = [r for _, rows in run(stateful.expiring_counts(stream, 100, "300 seconds"), tmp_path) for r in rows if r[0] != "end"]
    whole = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("at"))
    want = sorted(r[:] for r in stateful.counts_until(whole, 100).collect())
    assert sorted(got) == want and len(want) > 20


def test_deliveries_count_once(spark, tmp_path):
    stream = files_of([[("a", 1), ("b", 2), ("a", 3)], [("a", 4), ("c", 5)], [("b", 6)]], "id string, v long", spark, tmp_path)
    got = []
    query = stateful.delivered_once(stream, "id", 3600).writeStream.foreachBatch(lambda df, n: got.append(sorted(r.id for r in df.collect()))).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    for _ in range(600):  # with state that a clock lets go, batches go on without rows
        if len(got) >= 3 or query.exception():
            break
        query.awaitTermination(0.2)
    query.stop()
    assert got[:3] == [["a", "b"], ["c"], []]


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_grow_and_only_changed_ones_are_emitted(spark, tmp_path, seed):
    rng = random.Random(seed)
    items = [(f"w{rng.randrange(3)}", f"Title {m % 2}", str(m), f"- line {m} <!-- id:{m} -->") for m in range(40)]
    items += rng.sample(items, 10)
    rng.shuffle(items)
    cuts = sorted(rng.sample(range(1, 49), 2))
    batches = [items[: cuts[0]], items[cuts[0] : cuts[1]], items[cuts[1] :], items[:5]]
    schema = "source_ref string, title string, message_id string, line string"
    got = run(stateful.digests(files_of(batches, schema, spark, tmp_path)), tmp_path, "update")
    last = {r[0]: tuple(r) for _, rows in got for r in rows}
    want = mail.render_digests(mail.merge_digests(spark.createDataFrame([], schema), spark.createDataFrame(items, schema))).collect()
    assert last == {r.source_ref: (r.source_ref, r.title, r.n, r.body) for r in want}
    assert got[-1][1] == []  # only repeats


def remote(folder):
    def log():
        return json.load(open(f"{folder}/log.json"))

    def changes(token):
        from quillstone.sources.paged import Expired

        now = log()
        at = 0 if token is None else int(token)
        if token is not None and at < now["oldest"]:
            raise Expired(token)
        ids = now["ids"][at : at + 7]
        return ids, str(at + len(ids)) if ids else token

    def get(i):
        open(f"{folder}/gets", "a").write(i + "\n")
        return None if i == "gone" else json.dumps({"id": i, "v": log()["v"]})

    return changes, get


def test_listed_source_neither_loses_nor_repeats(spark, tmp_path):
    spark.dataSource.register(paged.listed(*remote(str(tmp_path))))
    log = lambda ids, v=1, oldest=0: (tmp_path / "log.json").write_text(json.dumps({"ids": ids, "v": v, "oldest": oldest}))
    options = {"ids": "5"}
    log([f"i{k}" for k in range(20)] + ["gone", "i3"])
    batch = spark.read.format("listed").options(**options).load()
    assert batch.rdd.getNumPartitions() == 5
    assert sorted(r.id for r in batch.collect()) == sorted(f"i{k}" for k in range(20))
    tables = Tables(spark, f"file://{tmp_path}/t")
    schema = "id string, v long"
    parse = lambda df: df.select("id", F.get_json_object("item", "$.v").cast("long").alias("v"))
    go = lambda: jobs.sync_listed(spark.readStream.format("listed").options(**options).load(), tables, "notes", schema, "id", parse, "remote", f"file://{tmp_path}/ck").awaitTermination()
    go()
    assert tables.read("notes", schema).count() == 20
    assert tables.read("cursors", jobs.CURSORS).select("source", "cursor", "items").collect()[0][:] == ("remote", "22", 20)
    gets = len((tmp_path / "gets").read_text().splitlines())
    log([f"i{k}" for k in range(20)] + ["gone", "i3", "i4", "new"], v=2)
    go()
    notes = {r.id: r.v for r in tables.read("notes", schema).collect()}
    assert len(notes) == 21 and notes["i4"] == notes["new"] == 2 and notes["i5"] == 1
    assert len((tmp_path / "gets").read_text().splitlines()) - gets == 2
    assert tables.read("cursors", jobs.CURSORS).first().cursor == "24"


def test_expired_token_lists_all_anew():
    ids = [f"i{k}" for k in range(10)]

    def changes(token):
        if token == "3":
            raise paged.Expired(token)
        at = 0 if token is None else int(token)
        return ids[at : at + 4], str(min(10, at + 4)) if at < 10 else token

    assert paged.changed_ids(changes, "3", "10") == ids
    assert paged.changed_ids(changes, "4", "10") == ids[4:]
    assert paged.newest_token(changes, "3") == "10" and paged.newest_token(changes, None) == "10"
