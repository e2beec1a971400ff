"""Ancestors: any depth, any number of rows."""

import pytest

from quillgraph.operators import network
from quillgraph.plans import catalogue

EDGES = "child string, parent string"


def found(df):
    return sorted((r["node"], r["ancestor"], r["depth"]) for r in df.collect())


def test_paths_of_any_length_are_rows_of_their_own(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "f"), ("x", "f"), ("y", "x")], EDGES)
    up = {"a": "bc", "b": "d", "c": "d", "d": "e", "e": "f", "x": "ff", "y": "x"}

    def walk(node, depth=1):
        for p in up.get(node, ""):
            yield p, depth
            yield from walk(p, depth + 1)

    assert found(network.ancestors(edges)) == sorted((n, p, d) for n in up for p, d in walk(n))
    assert found(network.ancestors(edges.where("child = 'x'"))) == [("x", "f", 1)] * 2
    assert found(network.ancestors(edges.where("false"))) == []


def test_edges_without_an_end_are_kept(spark):
    got = network.ancestors(spark.createDataFrame([("a", None), (None, "a"), ("b", "a"), (None, None)], EDGES)).collect()
    want = [("a", None, 1), (None, "a", 1), ("b", "a", 1), (None, None, 1), (None, None, 2), ("b", None, 2)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", [[("a", "a")], [("a", "b"), ("b", "a")], [("z", "y"), ("y", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "top")]])
def test_a_cycle_is_an_error(spark, rows):
    with pytest.raises(ValueError, match="its own ancestors"):
        network.ancestors(spark.createDataFrame(rows, EDGES))


def test_more_rows_than_spark_lets_a_recursion_give(spark, tmp_path):
    spark.range(600_000).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(25).selectExpr("cast(id AS int) AS n_nationkey", "cast(id % 5 AS int) AS n_regionkey").write.parquet(str(tmp_path / "nation.parquet"))
    counts = {r["depth"]: r["count"] for r in catalogue.QUERIES["ancestor_closure"](spark, str(tmp_path)).groupBy("depth").count().collect()}
    assert counts == {1: 600_025, 2: 600_000}
