"""Intermediate tables in the folder that a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set on the context. Where neither is, a local session gets a temporary one; a cluster, whose machines would not share it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    inner = spark.sparkContext._jsc.sc().getCheckpointDir()
    if inner.isDefined():
        return str(inner.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="quill-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that iterations neither repeat nor lose what came before."""
    at = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
