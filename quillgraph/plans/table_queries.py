"""Queries over orders, lines and events: dates, numbering, intervals, sets, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates
from ..operators import scores, spans
from .registry import query
from .star import read


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS value, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') || 'T00:00:00' AS "begin", strftime(last_day(o_orderdate::DATE), '%Y-%m-%d') || 'T23:59:59' AS "end" FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y') || '-01-01T00:00:00', strftime(o_orderdate, '%Y') || '-12-31T23:59:59' FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00', strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:59' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last instant of values of year, month and day precision."""
    pattern = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    valued = read(spark, sf_dir, "orders").select("o_orderkey", pattern.alias("value"))
    return valued.withColumn("b", dates.bounds_column(F.col("value"))).select("o_orderkey", "value", F.col("b.begin").alias("begin"), F.col("b.end").alias("end"))


@query("""WITH i AS (SELECT l_orderkey, strftime(l_shipdate - INTERVAL 20 DAY, '%Y-%m-%d') || 'T00:00:00' AS b, strftime(l_shipdate + INTERVAL 20 DAY, '%Y-%m-%d') || 'T23:59:59' AS e FROM lineitem)
SELECT l_orderkey, max(b) AS "begin", min(e) AS "end", CASE WHEN max(b) > min(e) THEN 'empty' END AS error FROM i GROUP BY l_orderkey""")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all intervals of a key have in common; an empty intersection is an error, kept as data."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.date_format(F.expr("l_shipdate - INTERVAL 20 DAYS"), "yyyy-MM-dd"), F.lit("T00:00:00")).alias("b"), F.concat(F.date_format(F.expr("l_shipdate + INTERVAL 20 DAYS"), "yyyy-MM-dd"), F.lit("T23:59:59")).alias("e"))
    return lines.groupBy("l_orderkey").agg(*dates.intersection(F.col("b"), F.col("e")))


@query("""WITH s AS (SELECT l_orderkey, min(l_shipdate) FILTER (l_returnflag = 'A') AS sent, min(l_shipdate) FILTER (l_returnflag = 'R') AS received FROM lineitem GROUP BY 1)
SELECT o_orderkey, strftime(coalesce(sent, received), '%Y-%m-%d') AS day, CASE WHEN sent IS NOT NULL THEN 'sent' WHEN received IS NOT NULL THEN 'received' ELSE 'none' END AS source FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def date_source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of sending, else of receipt, else none; the choice is kept."""
    dated = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("sent"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("received"))
    joined = read(spark, sf_dir, "orders").select("o_orderkey").join(dated, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    source = F.when(F.col("sent").isNotNull(), "sent").when(F.col("received").isNotNull(), "received").otherwise("none")
    return joined.select("o_orderkey", F.date_format(F.coalesce("sent", "received"), "yyyy-MM-dd").alias("day"), source.alias("source"))


@query("SELECT event_id, event_type || '-' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS event FROM events")
def event_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events by kind, in order."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("-"), F.row_number().over(order).cast("string")).alias("event"))


_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_KEY)}) AS number FROM lineitem")
def mention_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of mentions in order of block and position."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_KEY)).cast("long")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", number.alias("number"))


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of seconds by user: (event_id, user_id, kind, start, end, score)."""
    start = F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200
    width = (F.col("value") * 600).cast("long") + 1
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), start.alias("start"), (start + width).alias("end"), (F.col("value") / 100).alias("score"))


_SPANS = """e AS (SELECT event_id, user_id, event_type AS kind, floor(epoch(ts))::BIGINT - 1704067200 AS start, floor(epoch(ts))::BIGINT - 1704067200 + trunc(value * 600)::BIGINT + 1 AS "end", value / 100 AS score FROM events)"""


@query(f"""WITH {_SPANS} SELECT user_id, reached AS gap_start, start AS gap_end FROM (
  SELECT user_id, start, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e) WHERE start > reached""")
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that no span of a user covers."""
    return spans.gaps(event_spans(spark, sf_dir), ["user_id"])


@query(f"""WITH {_SPANS} SELECT a.event_id, count(b.event_id)::BIGINT AS purchases FROM e a JOIN e b ON a.user_id = b.user_id AND a.start < b."end" AND b.start < a."end" AND b.kind = 'purchase'
WHERE a.kind = 'error' GROUP BY a.event_id UNION ALL SELECT a.event_id, 0 FROM e a WHERE a.kind = 'error' AND NOT EXISTS (SELECT 1 FROM e b WHERE a.user_id = b.user_id AND a.start < b."end" AND b.start < a."end" AND b.kind = 'purchase')""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error spans with the purchases that overlap them, and those without any (semi and anti parts)."""
    e = event_spans(spark, sf_dir)
    errors, bought = e.where("kind = 'error'"), e.where("kind = 'purchase'").select("event_id", "user_id", "start", "end")
    pairs = spans.overlap_join(errors, bought, ["user_id"], 20_000).groupBy("event_id").agg(F.count("r_event_id").alias("purchases"))
    alone = spans.exists_overlap(errors, bought, ["user_id"], ["event_id"], 20_000, "left_anti").select("event_id", F.lit(0).cast("long").alias("purchases"))
    return pairs.unionByName(alone)


@query()
def greedy_nonoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the spans of a user those that overlap no better one."""
    return spans.greedy(event_spans(spark, sf_dir), ["user_id"])


@query()
def overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as gold and clicks as predictions, matched one to one by the largest overlap."""
    e = event_spans(spark, sf_dir)
    return spans.match_one_to_one(e.where("kind = 'view'"), e.where("kind = 'click'"), ["user_id"], 20_000)


@query(f"""WITH {_SPANS}, g AS (SELECT DISTINCT user_id, start, "end", CASE WHEN kind = 'view' THEN 'A' ELSE 'B' END AS kind FROM e WHERE kind IN ('view', 'purchase')),
p AS (SELECT DISTINCT user_id, start, "end", CASE WHEN kind = 'click' THEN 'A' ELSE 'B' END AS kind FROM e WHERE kind IN ('click', 'signup')),
w AS (SELECT p.* FROM p ANTI JOIN g USING (user_id, start, "end", kind)),
m AS (SELECT w.user_id, w.start, w."end", w.kind, max((g.kind = w.kind)::INT) AS same FROM w JOIN g ON g.user_id = w.user_id AND w.start < g."end" AND g.start < w."end" GROUP BY ALL)
SELECT category, count(*)::BIGINT AS n FROM (SELECT CASE WHEN same = 1 THEN 'boundary' WHEN same = 0 THEN 'type' ELSE 'spurious' END AS category FROM w LEFT JOIN m USING (user_id, start, "end", kind)
  UNION ALL SELECT 'missed' FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = g.user_id AND p.start < g."end" AND g.start < p."end")) GROUP BY category""")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of errors of predicted spans."""
    e = event_spans(spark, sf_dir)
    gold = e.where("kind IN ('view', 'purchase')").withColumn("kind", F.when(F.col("kind") == "view", "A").otherwise("B"))
    guess = e.where("kind IN ('click', 'signup')").withColumn("kind", F.when(F.col("kind") == "click", "A").otherwise("B"))
    return scores.error_classes(gold, guess, ["user_id"], 20_000).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment AS kind, count(*)::BIGINT AS total, count(*) FILTER (n > 0)::BIGINT AS resolved, count(*) FILTER (n = 0)::BIGINT AS unresolved, count(*) FILTER (urgent > 0)::BIGINT AS urgent
FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY c_mktsegment""")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved and unresolved entities by kind."""
    each = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    joined = read(spark, sf_dir, "customer").join(each, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count(F.lit(1)).alias("total"), F.count("n").alias("resolved"), F.count_if(F.col("n").isNull()).alias("unresolved"), F.count_if(F.col("urgent") > 0).alias("urgent"))


@query("""WITH a AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber >= 3)
SELECT 'only_a' AS part, count(*)::BIGINT AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_b', count(*)::BIGINT FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
UNION ALL SELECT 'common', count(*)::BIGINT FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b)""")
def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset difference both ways and intersection, from one count of either side's copies."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber")
    counted = lines.groupBy("l_suppkey", "l_returnflag").agg(F.count_if(F.col("l_linenumber") <= 4).alias("a"), F.count_if(F.col("l_linenumber") >= 3).alias("b"))
    total = counted.agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("only_a"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("only_b"), F.sum(F.least("a", "b")).alias("common"))
    return total.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(p, F.lit(0)).cast("long").alias("n")) for p in ("only_a", "only_b", "common")])).alias("x")).select("x.*")


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that come more than once."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, min(event_id) AS least_id FROM events GROUP BY user_id")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label of each entity in order."""
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("event_id").alias("least_id"))


@query("SELECT user_id, event_type, max(value) AS value, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY 1, 2")
def best_score_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal keys the row of the best score, the smallest id among equals."""
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("SELECT event_type, (props->>'k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of JSON."""
    parsed = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return parsed.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH y AS (SELECT l_suppkey, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), lo AS (SELECT min(y) AS y FROM y)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS supplier, a.n AS before, b.n AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change
FROM (SELECT y.* FROM y JOIN lo ON y.y = lo.y) a FULL JOIN (SELECT y.* FROM y JOIN lo ON y.y = lo.y + 1) b ON a.l_suppkey = b.l_suppkey""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side, whatever either lacks."""
    counted = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    low = counted.agg(F.min("y")).head()[0] or 0
    a = counted.where(F.col("y") == low).select("l_suppkey", F.col("n").alias("before"))
    b = counted.where(F.col("y") == low + 1).select("l_suppkey", F.col("n").alias("after"))
    return a.join(b, "l_suppkey", "full").select(F.col("l_suppkey").alias("supplier"), "before", "after", (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("change"))
