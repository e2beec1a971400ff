"""A corpus pipeline over ``documents`` (counted as part of the llm subpackage): filters, near-duplicates, repeats, packing.

Each stage takes what the one before kept, as a table with the columns of documents, and returns such a table; the last returns
the places of all pieces in packed sequences. Every stage works on whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bestfit, nearcopies, quality, substring, toxicity
from quillgraph.llm.common import materialize, table
from quillgraph.llm.queries import TOXIC_FROM, toxicity_model, vocabulary_path
from quillgraph.ship import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(df: DataFrame, text: F.Column, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with a new text and its length."""
    changed = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return df.select(*[changed.get(c, F.col(f"`{c}`")) for c in columns])


def _stage(function: Stage) -> Stage:
    """The stage, after the package has been sent to the executors."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, docs, sf_dir)

    return run_stage


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: lines that fail go, documents that fail go."""
    judged = quality.quality_rules(docs).where("quality.kept")
    return _with_text(judged, F.col("quality.clean_text"), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity, learnt from those of its input that have a label and are not held out; documents that score TOXIC_FROM or more go."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out_col="__score").where(F.col("__score") < TOXIC_FROM).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups of texts whose five-word shingles are similar by 0.8 or more: the document of the smallest id stays."""
    return nearcopies.keep_first(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has go; no document does, though it may be left empty."""
    passed = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    return _with_text(substring.remove_repeats(docs, passed=passed, layout=True), F.col("kept"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    return bestfit.best_fit_packing(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", _stage(clean)),
    ("toxicity", _stage(drop_toxic)),
    ("simhash_near_dedup", _stage(drop_near_duplicates)),
    ("substring_dedup", _stage(drop_repeats)),
    ("best_fit_packing", _stage(pack)),
]
#: SQL can't express learnt scores or 64-bit hashes; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
