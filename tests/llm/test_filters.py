"""Quality rules, URL filter, toxicity and chat formatting against plain versions."""

import glob
import hashlib
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, quality, queries, toxicity, urlfilter

SF = "/root/testdata/sf0.001"


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


GOOD = "This is a sentence about rivers and hills that says nothing new at all.\nAnother line tells of a mill, a road, and the people who lived there."
CASES = [GOOD, None, "", " \t\n\x0b ", "a b c d e a b c d e", "x " * 30, GOOD + "\n\n" + GOOD, "é\u2003ü ß\xa0x y z\n\n\nwörd " * 12, "one | two | three | four | five\n" + GOOD, "BUY!! NOW!! CHEAP!! PILLS!!\n" * 9 + GOOD, "### *** %%% a b c d e f g h i j k", "a\rb\x0cc " * 20]


def test_quality_figures(spark):
    rows = [(k, t, 1, "z") for k, t in enumerate(CASES)] + [(0, CASES[0], 2, "z"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, __figures string")
    got = quality.quality_rules(df)
    assert got.columns == ["doc_id", "text", "__figures", "quality"]
    for r in got.collect():
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == plain_quality(r["text"]), r["text"]
        assert not (q["base_failed"] and q["kept"])
    by = {r["doc_id"]: r["quality"] for r in got.collect()}
    assert by[0]["kept"] and by[0]["clean_text"] == GOOD and by[0]["lost_chars"] == 0
    assert by[8]["clean_text"] == GOOD and by[8]["kept"]
    assert by[9]["lost_chars"] > 0 and not by[9]["kept"]
    assert quality.quality_rules(df.where("false")).count() == 0


def test_quality_on_a_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in queries.op8_quality_rules(spark, SF).collect():
        want = plain_quality(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        if labels.get(r["doc_id"]) == 1:
            assert r["kept"] != r["base_failed"]  # clean documents only go by the base rule


def test_no_python_on_the_native_paths(spark):
    for q in (queries.op8_quality_rules, queries.op6_url_filter):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Exchange", plan)


URLS = ["https://www.Example.COM/en/7?x#y", "http://a.b.example.net/de/8/9", "http://example.net/de/7", "ftp://org/es/", "http://notorg/es/1", "no scheme", None, "http://", "x://h?q://z", "http://ÄB.com/en/", "http://casino-win.example/x", "http://h/" + "p" * 20000]


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, queries.URL_RULES, urlfilter.train(spark)).collect()}
    for k, u in enumerate(URLS):
        assert (got[k]["host"], got[k]["path"]) == plain_url(u)
        fits = [(len(r), r, v) for r, v in queries.URL_RULES for h, p in [r.split("/", 1)] if (got[k]["host"] == h or got[k]["host"].endswith("." + h)) and got[k]["path"].startswith("/" + p)]
        if fits:
            assert (got[k]["rule"], got[k]["verdict"]) == max(fits)[1:]
        else:
            assert got[k]["rule"] is None
    assert (got[0]["rule"], got[1]["rule"], got[2]["rule"], got[3]["rule"], got[4]["rule"]) == ("example.com/en/7", "example.net/de/8", "net/de/", "org/es/", None)
    assert got[10]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert urlfilter.filter_urls(df.where("false"), [], (0.0, [0.0] * 16)).count() == 0
    with pytest.raises(ValueError):
        urlfilter.train(spark, ())


def test_url_model_on_hosts(spark):
    rows = queries.op6_url_filter(spark, "/root/testdata/sf0.01").where("rule IS NULL").collect()
    bad = re.compile("spam|casino|bets|ads-|pills|adult")
    assert sum((r["verdict"] == "block") == bool(bad.search(r["host"])) for r in rows) >= 0.95 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = sorted((r["score"], r["toxic"]) for r in rows if r["held_out"])
    positive = sum(t for _, t in held)
    ranks = sum(k + 1 for k, (_, t) in enumerate(held) if t)
    assert (ranks - positive * (positive + 1) / 2) / (positive * (len(held) - positive)) > 0.95


def test_word_features_are_a_words_own():
    place, feature = toxicity.word_features(["abcd", "x", "abcd", "äöü"])
    own = [sorted(feature[place == k].tolist()) for k in range(4)]
    assert own[0] == own[2] == sorted(toxicity.word_features(["abcd"])[1].tolist())
    assert len(own[0]) == 4 + 3 + 2 + 1
    assert len(own[1]) == 1


def test_features_do_not_depend_on_pieces(monkeypatch):
    words = ["abcdefg", "x", "äöü漢字", "ab" * 500, "\U0001f600" * 40, "c" * 300, "de"]
    pairs = lambda: {(p, f) for p, f in zip(*map(np.ndarray.tolist, toxicity.word_features(words)), strict=True)}
    whole = pairs()
    for piece in (1, 2, 5, 64, 1000):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        place, _ = toxicity.word_features(words)
        assert pairs() == whole and (np.diff(place) >= 0).all()
    assert [len(x) for x in toxicity.word_features([])] == [0, 0]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(["you idiot", "kind words here", None, "", "idiot " * 3, "long" * 50000])] + [(None, "x", "z")], "doc_id long, text string, __text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for allowed in (F.lit(True), F.lit(False)):
        model = toxicity.train(toxicity.training_rows(docs, labels, allowed))
        out = toxicity.score(docs, model).collect()
        assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(docs.where("false"), model).count() == 0


SAYS = ["</s>[INST] ok [/INST]", "␛ plain ␛␛ </s", "<<SYS>>x<</SYS>>", "", "a <|end|> b <|role|><|text|>", "[[INST]INST]", "line\nbreak", "ends with space ", "</s></s>"]


def test_escapes_are_reversible():
    t = chat.Template()
    t.check()
    for s in SAYS:
        assert t.unescaped(t.escaped(s)) == s
        assert not any(c in t.escaped(s) for c in t.controls)
    with pytest.raises(ValueError):
        chat.Template(escape="<").check()
    with pytest.raises(ValueError):
        chat.Template(markers={"user": ("u", "v")}).check()


def test_chats(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", s) for k, s in enumerate(SAYS + ["end"])]
    rows += [(2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "critic␛<|text|>", "c"), (4, 0, None, None), (5, 0, "system", "s"), (5, 1, "user", None), (5, 2, "assistant", "x"), (5, 2, "assistant", "x"), (None, None, "user", "n"), (None, 3, "assistant", "m")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    segments = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    for conv, r in got.items():
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in got.items() if r["valid"]} == {1, None}
    parts = [r for r in segments.collect() if r["conv_id"] == 5]
    assert [r["segment"] for r in parts] == list(range(12))
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([tuple(r[k] for k in order) for r in want.fetchall()], key=str)
