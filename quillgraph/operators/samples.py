"""Samples and orders that are defined by position: even spacing, every nth, quotas in turn, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, order: Sequence[str], buckets: int = 64, by: Column | None = None) -> DataFrame:
    """``df`` with ``rn`` (from 1) in the order of ``order``, without bringing all rows to one task.

    Rows are ranged over partitions; each partition numbers its own, after the counts of those before it (one number for each).
    """
    ranged = df.repartitionByRange(buckets, *order).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    # At most ``buckets`` rows are broadcast.
    joined = local.join(F.broadcast(before), "__part")
    return joined.withColumn("rn", (F.col("__local") + F.col("__before")).cast("long")).drop("__part", "__local", "__before")


def evenly_spaced(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows at even distances in an order, the ends included; halves round to even."""
    rows = numbered(df, order)
    n = df.count()
    if k < 1 or not n:
        return rows.where("false")
    if n <= k:
        return rows
    # Python rounds halves to even, as is asked for.
    wanted = sorted({round(i * (n - 1) / (k - 1)) + 1 if k > 1 else 1 for i in range(k)})
    return rows.where(F.col("rn").isin(wanted))


def every_nth(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first of each ``n`` rows."""
    return numbered(df, order).where((F.col("rn") - 1) % n == 0)


def in_turn(df: DataFrame, category: str, order: Sequence[str], k: int) -> DataFrame:
    """``k`` rows, taking one of each category in turn; adds ``turn``, a row's number within its category."""
    own = df.withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("turn") <= k)
    return own.orderBy("turn", category).limit(k)


def quartile_cuts(df: DataFrame, value: str) -> tuple:
    """Values at a quarter, half and three quarters of the sorted rows (index n * q // 4, from 0)."""
    n = df.where(F.col(value).isNotNull()).count()
    if not n:
        return (None, None, None)
    at = [n * q // 4 + 1 for q in (1, 2, 3)]
    got = {r["rn"]: r[value] for r in numbered(df.where(F.col(value).isNotNull()).select(value), [value]).where(F.col("rn").isin(at)).collect()}  # three rows
    return tuple(got[x] for x in at)


def binned(df: DataFrame, value: str, cuts: Sequence) -> DataFrame:
    """Adds ``bin`` from 1: one more than the number of cuts below the value."""
    number = F.lit(1)
    for cut in cuts:
        number = number + (F.col(value) > F.lit(cut)).cast("int")
    return df.withColumn("bin", number)
