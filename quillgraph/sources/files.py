"""Side files as tables: glossaries, authority caches, mentions, reviews, manifests. What doesn't fit its schema raises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MENTIONS = (
    "document string, software struct<name:string,version:string>, input struct<file:string,sha256:string,url:string>, tei_url string, settings map<string,string>, blocks array<string>, "
    "mentions array<struct<id:int,block:int,start:int,end:int,text:string,kind:string,origin:string,source:string,score:double,inline:boolean,xpath:string,entities:array<string>,refs:array<string>,unresolved:array<string>>>, warnings array<string>"
)
REVIEW = (
    "format string, version int, source struct<document:string,inputSha256:string,mentionsSha256:string,graphSha256:string>, reviewer string, "
    "decisions array<struct<id:int,block:int,start:int,end:int,text:string,kind:string,decision:string,note:string,decidedAt:string>>"
)
ENTRY = "struct<kind:string,label:string,pmb:string,gnd:string,geonames:string,wikidata:string,source:string,retrieved:string>"


def _whole(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def _checked(value: F.Column, ok: F.Column, message: str) -> F.Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(kind, term, sha256) of a glossary; other kinds, or terms without text, raise."""
    rows = _whole(spark, path).select("sha256", F.explode(F.from_json("text", "map<string,array<string>>")).alias("kind", "terms")).select("sha256", "kind", F.explode("terms").alias("term"))
    good = F.col("kind").isin("PER", "LOC", "ORG") & (F.trim("term") != "")
    return rows.select(_checked(F.col("kind"), good, "a glossary has terms for PER, LOC and ORG").alias("kind"), "term", "sha256")


def authority_cache(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, label, gnd, geonames, wikidata, source, retrieved) of a cache file."""
    parsed = _whole(spark, path).select(F.from_json("text", f"resolver string, version int, entries map<string,{ENTRY}>").alias("c"))
    rows = parsed.select(F.explode("c.entries").alias("id", "e"))
    return rows.select("id", _checked(F.col("e.kind"), F.col("e.kind").isin("PER", "LOC", "ORG"), "a cache entry has a known kind").alias("kind"), "e.label", "e.gnd", "e.geonames", "e.wikidata", "e.source", F.col("e.retrieved").try_cast("date").alias("retrieved"))


def mentions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(document, sha256 of the file, columns of a mention), one row for each mention."""
    parsed = _whole(spark, paths).select("sha256", F.from_json("text", MENTIONS).alias("m"))
    return parsed.select(F.col("m.document").alias("document"), "sha256", F.explode("m.mentions").alias("x")).select("document", "sha256", "x.*")


def reviews(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(document, reviewer, columns of a decision), one row for each decision."""
    parsed = _whole(spark, paths).select(F.from_json("text", REVIEW).alias("r"))
    return parsed.select(F.col("r.source.document").alias("document"), "r.reviewer", F.explode("r.decisions").alias("d")).select("document", "reviewer", "d.*")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header, parted by tabs; all columns are strings."""
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def decided(reviews_: DataFrame, mentions_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with their mention, decisions that fit none). A decision fits if document, id, place, text and kind do."""
    keys = ["document", "id", "block", "start", "end", "text", "kind"]
    suggestions = mentions_.where("origin = 'automatic'").select(*keys, "entities", "score")
    return reviews_.join(suggestions, keys), reviews_.join(suggestions, keys, "left_anti")
