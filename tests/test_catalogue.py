"""Every catalogue query against its SQL, and span operators on small cases."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.functions import text
from quillgraph.operators import samples, spans
from quillgraph.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    made.sql("SET timezone = 'UTC'")
    for p in glob.glob(SF + "/*.parquet"):
        made.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return made


def plain(value):
    if value is None or value != value:
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalogue.ORACLE:
        assert rows
        return
    want = duck.sql(catalogue.ORACLE[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(rows, key=str) == sorted([tuple(plain(r[k]) for k in order) for r in want.fetchall()], key=str)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


SPANS = "k string, start int, end int, kind string, score double"


def test_greedy_selection(spark):
    df = spark.createDataFrame([("a", 0, 5, "PER", 0.9), ("a", 3, 9, "PER", None), ("a", 9, 12, "LOC", 0.1), ("a", 20, 25, "LOC", 0.5), ("a", 20, 26, "LOC", 0.5), ("b", 0, 2, "ORG", 0.3)], SPANS)
    got = {(r["k"], r["start"], r["end"]) for r in spans.greedy(df, ["k"]).collect()}
    assert got == {("a", 3, 9), ("a", 9, 12), ("a", 20, 26), ("b", 0, 2)}


def test_one_to_one_matching_takes_the_largest_overlap_first(spark):
    gold = spark.createDataFrame([("a", 0, 10, "PER", None), ("a", 10, 14, "PER", None), ("b", 0, 3, "PER", None)], SPANS)
    pred = spark.createDataFrame([("a", 0, 3, "PER", None), ("a", 2, 11, "PER", None), ("b", 3, 5, "PER", None)], SPANS)
    got = {(r["k"], r["g_start"], r["p_start"], r["shared"]) for r in spans.match_one_to_one(gold, pred, ["k"], 4).collect()}
    assert got == {("a", 0, 2, 8)}


def test_overlap_join_meets_each_pair_once(spark):
    a = spark.createDataFrame([("x", 0, 100), ("x", 50, 60), ("y", 0, 1)], "k string, start int, end int")
    got = sorted((r["start"], r["r_start"]) for r in spans.overlap_join(a, a, ["k"], 7).where("k = 'x'").collect())
    assert got == [(0, 0), (0, 50), (50, 0), (50, 50)]
    assert spans.exists_overlap(a, a.where("start = 50"), ["k"], ["k", "start"], 7, "left_anti").collect()[0]["k"] == "y"


def test_fragments_and_best(spark):
    df = spark.createDataFrame([("a", "PER", 0, 4, True), ("a", "PER", 2, 9, False), ("a", "LOC", 0, 4, True)], "k string, kind string, start int, end int, at_edge boolean")
    assert {(r["kind"], r["start"]) for r in spans.drop_fragments(df, ["k"], 16).collect()} == {("PER", 2), ("LOC", 0)}


def test_numbering_over_partitions(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS x")
    assert [r["rn"] for r in samples.numbered(df, ["x"], 7).orderBy("x").collect()] == list(range(1, 1001))
    assert samples.evenly_spaced(df, ["x"], 3).orderBy("x").toPandas()["x"].tolist() == [0, 500, 999]
    assert samples.evenly_spaced(df.where("false"), ["x"], 3).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("  Dr. Ärger\t ",), ("Herr  XIV",), ("",)], "t string")
    got = df.selectExpr("t").select(text.squeeze(df["t"]).alias("s"), text.name_like(df["t"]).alias("n"), text.slug(df["t"]).alias("g"), text.quoted_iri(df["t"]).alias("q")).collect()
    assert [r["s"] for r in got] == ["Dr. Ärger", "Herr XIV", ""]
    assert [r["n"] for r in got] == [True, False, False]
    assert text.slug_of("Jena") == "jena-0dd8aa7e1e"
    assert all(r["q"] == text.quote(t) for r, t in zip(got, ["  Dr. Ärger\t ", "Herr  XIV", ""], strict=True))
    assert text.is_iri("https://x.org/a") and not text.is_iri("a b:c") and not text.is_iri("x")
