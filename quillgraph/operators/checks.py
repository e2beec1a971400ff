"""Checks of whole tables: equality as multisets, digests, exact sets of ids, files against a manifest, selectors against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import OA, RDF


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with how often either side has them where this differs (columns a, b); none if the tables are equal as multisets."""
    names = a.columns
    both = a.select(*names, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*names, F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy(*names).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a <> b")


def result_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest) that tells multisets of rows apart whatever their order: sums of 64-bit halves of each row's SHA-256."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = F.sha2(text, 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", part(1), part(16)).alias("digest"))


def set_mismatch(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side) of ids that only one side has: missing or unexpected."""
    missing = wanted.select(key).distinct().join(found, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(found.select(key).distinct().join(wanted, key, "left_anti").withColumn("side", F.lit("unexpected")))


def manifest_mismatch(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(letter, problem) of files (letter, sha256) and a manifest of the same: missing, unexpected or changed."""
    joined = files.select("letter", F.col("sha256").alias("is")).join(manifest.select("letter", F.col("sha256").alias("should")), "letter", "full")
    problem = F.when(F.col("is").isNull(), "missing").when(F.col("should").isNull(), "unexpected").when(F.col("is") != F.col("should"), "changed")
    return joined.select("letter", problem.alias("problem")).where("problem IS NOT NULL")


def files_digest(files: DataFrame, order: Sequence[str] = ("path",)) -> DataFrame:
    """One row: the SHA-256 of all files' SHA-256 in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.sha2("content", 256).alias("h"))))
    return files.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["h"]), ""), 256).alias("digest"))


def selector_pairs(quads: DataFrame) -> DataFrame:
    """(graph, annotation, block, start, end, exact, agree): position and quotation selectors of one target side by side.

    They agree if they name the same block and the quotation is as long as the position says.
    """
    q = quads.select("graph", "s", "p", "o").distinct()
    of = lambda p, s, o: q.where(F.col("p") == p).select("graph", F.col("s").alias(s), F.col("o").alias(o))
    outer = of(OA + "hasTarget", "annotation", "target").join(of(OA + "hasSelector", "target", "outer"), ["graph", "target"]).join(of(OA + "refinedBy", "outer", "inner"), ["graph", "outer"]).join(of(RDF + "value", "outer", "block"), ["graph", "outer"])
    position = outer.join(of(OA + "start", "inner", "start"), ["graph", "inner"]).join(of(OA + "end", "inner", "end"), ["graph", "inner"])
    quotation = outer.join(of(OA + "exact", "inner", "exact"), ["graph", "inner"]).select("graph", "target", F.col("block").alias("qblock"), "exact")
    both = position.join(quotation, ["graph", "target"])
    agree = (F.col("block") == F.col("qblock")) & (F.length("exact") == F.col("end").cast("int") - F.col("start").cast("int"))
    return both.select("graph", "annotation", "block", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "exact", agree.alias("agree"))
