"""BPE, token rows and packing against the tokenizers library and plain versions."""

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import bestfit, bpe, queries, tokenbin
from quillgraph.llm.tokens import RankEncoder, Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a<|endoftext|>b  <|endoftext|> c", "Hello  wörld's 123\n\n\tx", "aaaaaaaaaaaaaaaaaaaaaaaa", "日本語 😀👍🏽 नमस्ते \x1c\x85\xa0 x", "<|endoftext|", chr(0x10940) + "ab" + chr(0x558) + "c", "ſ'S'll 'LL ’s", "x" * 5000, " " * 3000 + "y", "e\u0301 \u202e abc\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(PATH))


@pytest.fixture(scope="module")
def encoder():
    return bpe.TrieEncoder(Vocabulary.read(str(PATH)))


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_encodings_are_those_of_the_library(library, encoder):
    got = encoder.encode(TEXTS)
    fast = RankEncoder(Vocabulary.read(str(PATH)))
    for text, raw in zip(TEXTS, got, strict=True):
        want = ids(library, text)
        assert np.frombuffer(raw, "<u4").tolist() == want == fast.encode(text).tolist()
        assert encoder.decode(np.array(want, "<u4")).decode() == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    library, encoder = Tokenizer.from_file(str(PATH)) if not hasattr(test_any_text, "l") else test_any_text.l, getattr(test_any_text, "e", None) or bpe.TrieEncoder(Vocabulary.read(str(PATH)))
    test_any_text.l, test_any_text.e = library, encoder
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids(library, text)


def test_splits_of_every_code_point(library, encoder):
    fast = RankEncoder(Vocabulary.read(str(PATH)))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 40_000):
        texts = [f"a{chr(c)}a 1{chr(c)}1 !{chr(c)}! {chr(c)} b" for c in points[at : at + 40_000 : 7]]
        want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
        assert [fast.encode(t).tolist() for t in texts] == want


def test_invalid_sequences_decode_to_replacement(encoder, library):
    some = [encoder._tokens[bytes([0xE2])], encoder._tokens[b"a"]]
    assert encoder.decode(np.array(some, "<u4")).decode() == library.decode(some, skip_special_tokens=False)


def frame(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again"), (99, None, None), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, __text string")


def test_bpe_operator(spark, library):
    df = frame(spark)
    got = bpe.bpe_encode(df, str(PATH), emit=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    assert got.columns == ["doc_id", "text", "__text", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got.collect():
        want = ids(library, r["text"] or "")
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (want, r["text"] or "", len(want))
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    again = bpe.bpe_decode(got.select("doc_id", "ids"), str(PATH)).collect()
    assert sorted(r["decoded"] for r in again) == sorted((r["text"] or "") for r in df.collect())
    assert bpe.bpe_encode(df.where("false"), str(PATH)).count() == 0


def test_capacity_tree_finds_the_smallest_sufficient_room():
    tree = tokenbin.CapacityTree(10)
    for row, room in enumerate([3, 7, 7, 10]):
        tree.add(room, row)
    assert tree.take(4)[0] == 7
    assert tree.take(8) == (10, 3)
    assert tree.take(8) is None
    assert tree.take(3) == (3, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_packings_hold_all_pieces(lengths):
    rows = tokenbin.best_fit_decreasing(lengths, 40)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in r) <= 40 for r in rows)
    counts = {x: lengths.count(x) for x in lengths}
    plan = bestfit.plan_sequences(counts, 40)
    used = {}
    for n, items in plan:
        assert n > 0 and sum(items) <= 40
        for x in items:
            used[x] = used.get(x, 0) + n
    assert used == counts
    assert sum(n for n, _ in plan) <= len(rows) + 1


def test_cut():
    assert tokenbin.cut(5, 4) == [(0, 1), (1, 4)]
    assert tokenbin.cut(8, 4) == [(0, 4), (4, 4)]
    assert tokenbin.cut(4, 4) == [(0, 4)]


def test_token_rows_round_trip(spark, library, tmp_path):
    packed = tokenbin.pack_token_rows(frame(spark), str(PATH), capacity=64)
    tokenbin.write_token_rows(packed, str(tmp_path / "out"))
    docs, seen = {}, 0
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        row, places = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(row) == len(places) == 64
        ends = r["cu_seqlens"]
        assert ends[0] == 0 and ends[-1] == r["n_tokens"] <= 64
        for doc, piece, start, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], ends[:-1], ends[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            docs.setdefault(doc, []).append((start, piece, row[a:b].tolist()))
            seen += b - a
        assert not row[r["n_tokens"] :].any()
    for k, t in enumerate(TEXTS[1:], 1):
        parts = sorted(docs[k])
        assert [i for _, _, p in parts for i in p] == [*ids(library, t), 50256]
        assert [p for _, p, _ in parts] == list(range(len(parts)))
    assert [p for _, _, p in docs[99]] == [[50256]]
    assert len(docs[0]) == 2
    shards = list((tmp_path / "out").glob("part-*.parquet"))
    assert sum(len(tokenbin.matrices(str(s), 64)[0]) for s in shards) == spark.read.parquet(str(tmp_path / "out")).count()
    assert tokenbin.pack_token_rows(frame(spark).where("false"), str(PATH)).count() == 0


def test_best_fit_places(spark, library):
    df = frame(spark)
    rows = bestfit.best_fit_packing(df, str(PATH), capacity=64).collect()
    tokens = 0
    for k, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        want = np.array([*ids(library, t), 0], "<u4")
        if k == 0:
            assert len(own) == 2  # the row comes twice
            continue
        assert [r["start"] for r in own] == [a for a, _ in tokenbin.cut(len(want), 64)]
        assert all(r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        tokens += r["length"]
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-tokens // 64) + 1
    assert bestfit.best_fit_packing(df.where("false"), str(PATH)).count() == 0


def test_queries_on_a_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_bpe_roundtrip(spark, sf).collect():
        want = np.array(ids(library, docs[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
    assert queries.op3_token_rows(spark, sf).selectExpr("sum(n_tokens)").head()[0] == sum(len(ids(library, t)) + 1 for t in docs.values())


def test_exact_fill_beside_one_that_clashes():
    index = bestfit.ComplementIndex({6: 1, 1: 1, 4: 1, 3: 1})
    assert index.triple(13) == (6, 4, 3)
    assert bestfit.ComplementIndex({6: 1, 1: 1, 4: 1, 3: 1}).pair(7, (6,)) == (4, 3)


LONG = r"""
import sys, random, numpy as np, resource
resource.setrlimit(resource.RLIMIT_AS, (3 << 30, 3 << 30))
sys.path.insert(0, sys.argv[1])
from tokenizers import Tokenizer
from quillgraph.llm import bpe
from quillgraph.llm.tokens import RankEncoder, Vocabulary
v = Vocabulary.read(sys.argv[2])
library, trie, fast = Tokenizer.from_file(sys.argv[2]), bpe.TrieEncoder(v), RankEncoder(v)
r = random.Random(3)
mixed = "".join(r.choice("abcdefghij") for _ in range(1_000_000))
texts = ["a" * 1_000_000, mixed, mixed[:700_000] + "x", "-" * 300_000, " " * 2_000_000, " " * 2_000_000 + "y", "\n" * 2_000_000, "z" * 2_000_000, "é" * 200_000, "\u3000" * 200_000]
for texts in (texts[:5], texts[5:]):
    for text, raw in zip(texts, trie.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want, text[:9]
        assert fast.encode(text).tolist() == want, text[:9]
"""


def test_very_long_words_in_little_memory():
    """Words of 1 MB and runs of 2 million spaces, line breaks and letters: memory grows with the text, not with its square."""
    done = subprocess.run([sys.executable, "-c", LONG, str(Path(__file__).parents[2]), str(PATH)], capture_output=True, text=True, env={"OPENBLAS_NUM_THREADS": "1", "RAYON_NUM_THREADS": "1", "PYTHONPATH": ":".join(sys.path)}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]


def test_long_runs_in_the_operators(spark, library):
    rows = [(1, " " * 1_200_000 + "end"), (2, "a" * 300_000), (3, "plain words here")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    want = {i: np.array([*ids(library, t), 50256], "<u4") for i, t in rows}
    got = {}
    for r in tokenbin.pack_token_rows(df, str(PATH)).collect():
        row, ends = np.frombuffer(r["input_ids"], "<u2"), r["cu_seqlens"]
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], ends[:-1], ends[1:], strict=True):
            got.setdefault(doc, []).append((start, row[a:b]))
    assert {i: np.concatenate([x for _, x in sorted(p, key=lambda x: x[0])]).tolist() for i, p in got.items()} == {i: w.tolist() for i, w in want.items()}
    packed = bestfit.best_fit_packing(df, str(PATH)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in packed} == {i: len(w) for i, w in want.items()}
    strings = spark.createDataFrame([("x", "a b"), (None, None)], "doc_id string, text string")
    assert sorted(d or "" for r in tokenbin.pack_token_rows(strings, str(PATH)).collect() for d in r["doc_ids"]) == ["", "x"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé", max_size=8), max_size=12, unique=True))
def test_the_trie_holds_each_word_once(words):
    found = [(w, t.decode()) for w, t, _ in bpe.Trie(words).edges() if w is not None]
    assert sorted(found) == sorted((w, w) for w in words if w)
    for _, t, begin in bpe.Trie(words).edges():
        assert begin < len(t)
