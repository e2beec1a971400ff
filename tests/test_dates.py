"""Dates as intervals, on single values and as columns."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import dates
from quillgraph.functions.dates import DateError, Interval, bounds, intersect, interval

GOOD = [
    ("1821", "1821-01-01T00:00:00", "1821-12-31T23:59:59"),
    ("1904-02", "1904-02-01T00:00:00", "1904-02-29T23:59:59"),
    ("1900-02", "1900-02-01T00:00:00", "1900-02-28T23:59:59"),
    (" 1821-03-05 ", "1821-03-05T00:00:00", "1821-03-05T23:59:59"),
    ("1821-03-05T07:08", "1821-03-05T07:08:00", "1821-03-05T07:08:59"),
    ("1821-03-05T07:08:09", "1821-03-05T07:08:09", "1821-03-05T07:08:09"),
    ("1821-03-05T07:08:09.5+02:00", "1821-03-05T07:08:09.5+02:00", "1821-03-05T07:08:09.5+02:00"),
    ("1821-03-05T07:08Z", "1821-03-05T07:08:00Z", "1821-03-05T07:08:59Z"),
    ("0044-03-15", "0044-03-15T00:00:00", "0044-03-15T23:59:59"),
]
BAD = ["", "21", "--03-05", "1821-13", "1821-02-30", "1821-03-05T24:00:00", "1821-03-05T07:08:09.1234567", "1821-03-05T07:08+14:30", "März 1821", "1821-3-5"]


@pytest.mark.parametrize(("value", "begin", "end"), GOOD)
def test_bounds(value, begin, end):
    assert bounds(value) == (begin, end)


@pytest.mark.parametrize("value", BAD)
def test_not_a_date(value):
    with pytest.raises(DateError):
        bounds(value)


def test_columns_agree(spark):
    df = spark.createDataFrame([(v,) for v, *_ in GOOD] + [(v,) for v in BAD] + [(None,)], "v string")
    got = {r["v"]: r["b"] for r in df.select("v", dates.bounds_column(F.col("v")).alias("b")).collect()}
    for value, begin, end in GOOD:
        assert tuple(got[value]) == (begin, end)
    assert all(got[v] is None for v in [*BAD, None])


def test_attributes():
    assert interval({"when": "1821"}).begin == "1821-01-01T00:00:00"
    assert interval({"when-iso": "1821"}).end == "1821-12-31T23:59:59"
    assert interval({"notBefore": "1821-03"}) == Interval("1821-03-01T00:00:00", None)
    assert interval({"to": "1821-03"}).end == "1821-03-31T23:59:59"
    assert interval({}) is None
    with pytest.raises(DateError):
        interval({"notBefore": "1822", "notAfter": "1821"})
    with pytest.raises(DateError):
        interval({"from": "1821-03-05T01:00Z", "to": "1822"})


def test_intersection_keeps_lexical_forms():
    a, b = Interval("1821-03-05T01:00:00+02:00", None), Interval("1821-03-04T23:30:00Z", "1821-03-06T00:00:00Z")
    assert intersect([a, b]) == Interval("1821-03-04T23:30:00Z", "1821-03-06T00:00:00Z")
    with pytest.raises(DateError):
        intersect([a, Interval("1821-01-01T00:00:00", None)])
    with pytest.raises(DateError):
        intersect([Interval("1822-01-01T00:00:00", None), Interval(None, "1821-01-01T00:00:00")])
    assert intersect([]) is None


def test_intersection_columns(spark):
    df = spark.createDataFrame([("x", "1821-01-01T00:00:00", "1821-12-31T23:59:59"), ("x", "1821-03-01T00:00:00", None), ("y", "1821-01-01T00:00:00Z", "1820-01-01T00:00:00"), ("z", "1822-01-01T00:00:00", "1821-01-01T00:00:00")], "k string, b string, e string")
    got = {r["k"]: (r["begin"], r["end"], r["error"]) for r in df.groupBy("k").agg(*dates.intersection(F.col("b"), F.col("e"))).collect()}
    assert got["x"] == ("1821-03-01T00:00:00", "1821-12-31T23:59:59", None)
    assert got["y"][2] == "zones"
    assert got["z"][2] == "empty"
