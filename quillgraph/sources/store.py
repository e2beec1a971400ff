"""A store of statements: Parquet by predicate, appended file by file, as a set."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .turtle import parse

SCHEMA = "graph string, s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"
STATEMENT = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]


def scan_turtle(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Statements of Turtle files, with the file's path as graph; blank nodes are a file's own.

    Their names hold a hash of path and content, so loading a file again gives the same statements.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                own = hashlib.sha256(path.encode() + b"\0" + bytes(content)).hexdigest()[:16]
                rows = [(path, *x) for x in parse(bytes(content).decode(), f"{own}.", path)]
                yield pd.DataFrame(rows, columns=["graph", *STATEMENT])

    return files.mapInPandas(run, SCHEMA)


def from_statements(spark: SparkSession, statements: list[tuple], graph: str = "") -> DataFrame:
    """A small graph held by the driver as a DataFrame."""
    return spark.createDataFrame([(graph, *x) for x in statements], SCHEMA)


def union_graph(quads: DataFrame) -> DataFrame:
    """The set of statements over all graphs."""
    return quads.select(*STATEMENT).dropDuplicates()


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append(spark: SparkSession, path: str, quads: DataFrame) -> tuple[int, int]:
    """Add what a store doesn't have; (statements before, after). The store is made if there is none."""
    fresh = quads.dropDuplicates()
    before = 0
    if exists(spark, path):
        old = open_store(spark, path)
        before = old.count()
        null_safe = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ["graph", *STATEMENT]]
        new = fresh.select(*null_safe).join(old.select(*null_safe), ["graph", *STATEMENT], "left_anti")
        fresh = new.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) if c in ("o_dt", "o_lang") else F.col(c) for c in ["graph", *STATEMENT]])
    # Rows of a predicate lie together, so that a bound predicate reads few files and row groups.
    fresh.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.mode("append").parquet(path)
    return before, open_store(spark, path).count()
