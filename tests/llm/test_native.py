"""Exact dedup, chat formatting, BPE and packing against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillstone.llm import bpe, chat, exact, packing

DOC = "doc_id long, text string, keep_id string, kept string"
TEXTS = [(1, "a b c"), (2, "abc"), (3, " a\tb\nc  "), (4, None), (5, ""), (6, "été"), (7, "été"), (7, "été"), (8, "x" * 50_000), (9, " "), (None, "abc"), (10, "abc d")]
DOCS = [(i, t, "clash", "clash") for i, t in TEXTS]


def test_exact_dedup(spark):
    for support in (0.001, 0.2):
        got = exact.exact_dedup(spark.createDataFrame(DOCS, DOC), support=support).collect()
        norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
        assert len(got) == len(DOCS)
        for r in got:
            group = [(i, t) for i, t in TEXTS if hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256]
            best = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
            assert (r.keep_id, r.group_size, r.kept) == (best, len(group), r.doc_id == best)


def test_exact_dedup_empty_and_hot(spark):
    assert exact.exact_dedup(spark.createDataFrame([], DOC)).count() == 0
    hot = spark.range(3000).selectExpr("id doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('t', id) END text")
    got = exact.exact_dedup(hot)
    assert got.where("kept").count() == 2001 and got.where("keep_id = 0").count() == 1000


def test_exact_dedup_keeps_one_text_of_an_id(spark):
    rows = [(5, "a b c"), (5, "abc"), (6, "ab c"), (6, "a bc"), (5, "a b c"), (8, " x"), (8, "x ")]
    kept = {(r.doc_id, r.len) for r in exact.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) len"), carry=("len",)).where("kept").collect()}
    assert kept == {(5, 5), (8, 2)}
    got = exact.exact_dedup(spark.createDataFrame(rows[5:], "doc_id long, text string"))
    assert got.where("kept").count() == 1


def test_packing_deals_equal_rows_of_one_partition_to_many_groups(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) doc_id", "'' text").coalesce(1)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), group_docs=1000)
    groups = got.groupBy((got.sequence_id / 2**32).cast("long").alias("g")).count().collect()
    assert len(groups) == 20 and max(r["count"] for r in groups) < 2000 and sum(r["count"] for r in groups) == 20_000


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 1, "assistant", "no"), (2, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "q"), (5, 0, "user", "q")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].chosen_text == "<|assistant|>\nyes<|end|>\n"
    assert got[0].chosen_mask == "0x14,1x11" and got[0].rejected_text.count("no") == 2
    assert not got[1].paired and got[1].rejected_text == ""
    assert got[2].paired and got[2].prompt_turns == 1 and got[2].chosen_text == ""
    assert chat.preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_preferences_with_other_columns_and_long_texts(spark):
    rows = [(0, 0, "user", "q" * 200_000), (0, 1, "assistant", "é" * 100_000), (1, 0, "user", "q" * 200_000)] + [(1, i, "assistant", "r") for i in range(1, 3000)]
    rows += [(2**60, 0, "user", "x"), (2**60 + 1, 0, "user", "x"), (2**60 + 2, 0, "user", "y")]
    wide = spark.createDataFrame([(*r, "a", "b", 5, "c") for r in rows], "conv_id long, turn long, role string, text string, chosen string, prompt string, pair_id int, turns string")
    got = {r.pair_id: r for r in chat.preference_pairs(wide).collect()}
    assert set(got) == {0, 2**59, 2**59 + 1} and got[2**59].paired and not got[2**59 + 1].paired
    assert got[0].prompt_turns == 1 and len(got[0].chosen_text) == 100_000 + 14 + 8 and got[0].rejected_text.count("<|assistant|>") == 2999
    assert got[0].chosen_mask == "0x14,1x100008"
    pairs = spark.createDataFrame([([("user", "x")], None, "mine", 1)], "chosen array<struct<role string, text string>>, rejected array<struct<role string, text string>>, _a string, _k int")
    kept = chat.format_preferences(pairs).first()
    assert (kept["_a"], kept["_k"], kept.prompt_turns, kept.chosen_text) == ("mine", 1, 0, "<|user|>\nx<|end|>\n")


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_merges(reference):
    coder = bpe.bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    letters = list("abcdetaoinsééüßñ中文字😀 \t\n'01.,-") + ["the", "ing", "\x1c", "\x85", "᠎", "​", " ", "ſ"]
    for n in (0, 1, 2, 3, 10, 100, 3000):
        for _ in range(20):
            text = "".join(rng.choice(letters, n))
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    for text in ("a" * 20_000, "ab" * 9_999 + "a", "=" * 7_777):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


def test_bpe_query(spark, reference):
    got = bpe.encode_decode(spark.createDataFrame(DOCS, DOC), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(got) == len(DOCS)
    want = sorted((i is None, i or 0, hashlib.sha256(np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode_decode(spark.createDataFrame([], DOC), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("group_docs", [3, 100])
def test_packing(spark, group_docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rng = np.random.default_rng(2)
    texts = [(i, t) for i, t in TEXTS if i] + [(100 + i, " ".join(rng.choice(["alpha", "béta", "x", "<|endoftext|>", "42"], int(rng.integers(1, 900))))) for i in range(40)]
    texts = list({i: (i, t) for i, t in texts}.values())
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), group_docs=group_docs).collect()
    ids = {i: own.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    for i, want in ids.items():
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024
    groups = len({s >> 32 for s in fill})
    assert sum(n < 1024 for n in fill.values()) <= groups
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing_of_null_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*TEXTS, (None, None), (None, "abc"), (None, "x y z " * 900), (7, "other text " * 700), (7, "other text " * 700)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, grp string, tail string")
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), group_docs=4, added=True).collect()
    for i in {i for i, _ in rows}:
        ids = [own.encode(t or "", add_special_tokens=False).ids + [0] for j, t in rows if j == i]
        mine = [r for r in got if r.doc_id == i]
        assert sorted(r.doc_tokens for r in mine if r.start == 0) == sorted(map(len, ids)) and sum(r.length for r in mine) == sum(map(len, ids))
        assert all(any(r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids) for r in mine)
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024


def test_rows_without_ids_are_dealt_to_many_groups(spark):
    docs = spark.range(4000).selectExpr("CAST(NULL AS LONG) doc_id", "concat('t', id) text").repartition(8)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), group_docs=100)
    sizes = [r["count"] for r in got.groupBy((got.sequence_id / 2**32).cast("long")).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300


def test_the_stand_in_is_proven_and_agrees(reference):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.proven(path)
    own, rng = Tokenizer.from_file(path), np.random.default_rng(8)
    points = [chr(int(c)) for c in rng.integers(1, 0x3000, 400)] + list("  \n\t'sdetlrvm0123456789aAbB.,") * 20
    tokens = [reference.decode_single_token_bytes(int(i)).decode("utf-8", "ignore") for i in rng.integers(0, 50_000, 600)]
    some = ["".join(rng.choice(points, 60)) for _ in range(300)] + ["".join(rng.choice(tokens, 30)) for _ in range(300)]
    assert [x.tolist() for x in packing.id_encoder(path, True, True)(some)] == [own.encode(t, add_special_tokens=False).ids for t in some]


def test_packing_balances_cost():
    p = packing.Packer(4 * 100, 100)
    for n in sorted([60, 60, 40, 40, 40, 40, 30, 30, 20, 20, 20], reverse=True):
        list(p.add(n))
    assert p.room.sum() == 0 and p.cost.max() - p.cost.min() < 20


def test_packing_query_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from quillstone.llm import catalog

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "plain text"), (4, "x<|endoftext|><|endoftext|>\n y"), (5, "<|endoftext |>")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {i: own.encode(t, add_special_tokens=False).ids + [0] for i, t in texts}
    assert 50256 in want[1]
    for got in (catalog.op8_packing(spark, f"file://{tmp_path}"), corpus_pipeline.packed(spark, docs, "")):
        seen = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got.collect() if r.start == 0 and r.length == r.doc_tokens}
        assert all(seen.get(i, want_of) == want_of for i, ids in want.items() for want_of in [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))])
        assert {r.doc_id: r.doc_tokens for r in got.collect()} == {i: len(ids) for i, ids in want.items()}


def test_packing_of_a_run_of_over_a_million_blanks(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(1, "a" + " " * 1_300_000 + "b"), (2, "x" + "\n" * 1_300_000), (3, "a plain text")]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), added=True).collect()
    for i, text in texts:
        want, at = own.encode(text, add_special_tokens=False).ids + [0], 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(want)
