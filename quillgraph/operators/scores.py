"""Evaluation: multiset matches, precision and recall by group and in all, error classes, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import overlap_join


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where it isn't defined."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def multiset_matches(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Counts of gold, predicted and common rows by ``group`` (one of keys); equal rows match as often as both sides have them."""
    each = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    counted = each.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return counted.groupBy(group).agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum(F.least("g", "p")).alias("common"))


def with_totals(counts: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """``counts`` by group, and a row for all with the group ``all``."""
    rolled = counts.rollup(group).agg(*[F.sum(m).cast("long").alias(m) for m in measures], F.grouping(group).alias("__all"))
    return rolled.select(F.when(F.col("__all") == 1, "all").otherwise(F.col(group)).alias(group), *measures)


def prf(counts: DataFrame, group: str) -> DataFrame:
    """Precision, recall and F1 by group and in all, from gold, predicted and common counts."""
    total = with_totals(counts, group, ["gold", "predicted", "common"])
    p, r = ratio(F.col("common"), F.col("predicted")), ratio(F.col("common"), F.col("gold"))
    return total.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def error_classes(gold: DataFrame, predicted: DataFrame, keys: Sequence[str], width: int = 64) -> DataFrame:
    """(keys, start, end, kind, category) of errors.

    A prediction without an equal gold span is boundary if a gold span of its kind overlaps it, type if one of another kind does, else
    spurious; a gold span that no prediction overlaps is missed.
    """
    cols = [*keys, "start", "end", "kind"]
    g, p = gold.select(*cols).distinct(), predicted.select(*cols).distinct()
    wrong = p.join(g, cols, "left_anti")
    met = overlap_join(wrong, g, list(keys), width).groupBy(*cols).agg(F.max((F.col("kind") == F.col("r_kind")).cast("int")).alias("same"))
    judged = wrong.join(met, cols, "left").withColumn("category", F.when(F.col("same") == 1, "boundary").when(F.col("same") == 0, "type").otherwise("spurious")).drop("same")
    found = overlap_join(g, p, list(keys), width).select(*cols).distinct()
    missed = g.join(found, cols, "left_anti").withColumn("category", F.lit("missed"))
    return judged.unionByName(missed)
