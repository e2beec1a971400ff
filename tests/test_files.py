"""Side files as tables, checks of whole tables."""

import json

import pytest

from quillgraph.operators import checks
from quillgraph.operators.enrich import Options, enrich_letter
from quillgraph.operators.recognise import Glossary
from quillgraph.sources import files, store

from .conftest import GLOSSARY, LETTER


def test_side_files(spark, tmp_path):
    r = enrich_letter(LETTER, "brief.xml", Glossary(GLOSSARY), Options())
    (tmp_path / "m.mentions.json").write_text(json.dumps(r.record))
    mentions = files.mentions(spark, str(tmp_path / "m.mentions.json"))
    assert mentions.count() == len(r.record["mentions"])
    m = next(x for x in r.record["mentions"] if x["origin"] == "automatic")
    decision = {k: m[k] for k in ("id", "block", "start", "end", "text", "kind")} | {"decision": "accepted", "note": "", "decidedAt": "2024-01-01T00:00:00Z"}
    review = {"format": "x", "version": 1, "source": {"document": "brief-7"}, "reviewer": "Eva", "decisions": [decision, decision | {"end": 99}]}
    (tmp_path / "r.json").write_text(json.dumps(review))
    good, bad = files.decided(files.reviews(spark, str(tmp_path / "r.json")), mentions)
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "g.json").write_bytes(GLOSSARY)
    assert files.glossary(spark, str(tmp_path / "g.json")).count() == 5
    (tmp_path / "bad.json").write_text('{"XXX": ["a"]}')
    with pytest.raises(Exception, match="a glossary has"):
        files.glossary(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "c.json").write_text('{"resolver": "x", "version": 1, "entries": {"p1": {"kind": "PER", "label": "A", "gnd": "https://d-nb.info/gnd/1", "retrieved": "2024-01-02"}}}')
    assert [(x["id"], x["kind"], str(x["retrieved"])) for x in files.authority_cache(spark, str(tmp_path / "c.json")).collect()] == [("p1", "PER", "2024-01-02")]
    (tmp_path / "t.tsv").write_text('letter\ttext\nx\tsays "so\n')
    assert files.tsv(spark, str(tmp_path / "t.tsv")).collect()[0]["text"] == 'says "so'


def test_selectors_agree(spark):
    r = enrich_letter(LETTER, "brief.xml", Glossary(GLOSSARY), Options())
    pairs = checks.selector_pairs(store.from_statements(spark, r.statements, "g"))
    assert pairs.count() == pairs.where("agree").count() == len(r.record["mentions"])


def test_digests(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert checks.result_digest(a).head() == checks.result_digest(a.orderBy("k", ascending=False).select("v", "k")).head()
    assert checks.result_digest(a).head() != checks.result_digest(a.distinct()).head()
    assert checks.multiset_difference(a, a.distinct()).collect()[0]["a"] == 2
    assert checks.multiset_difference(a, a).count() == 0
    (tmp_path / "x.txt").write_text("1")
    (tmp_path / "y.txt").write_text("2")
    loaded = spark.read.format("binaryFile").load(str(tmp_path))
    assert checks.files_digest(loaded).head()[0] == checks.files_digest(loaded.repartition(2)).head()[0]
