"""Graph and text views over the driver's tables.

Documents are orders; entities are suppliers (groups), nations (places) and parts (things); a document refers to the suppliers and parts of
its lines and to the nations of these suppliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE, REFERS, LABEL = "rdf:type", "crm:P67", "rdfs:label"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"urn:{kind}:"), F.col(key).cast("string"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, entity): what each document refers to, as a set."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    each = lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"], "left").select(
        F.col("l_orderkey").alias("o_orderkey"), F.explode(F.array(iri("supplier", "l_suppkey"), iri("part", "l_partkey"), iri("nation", "s_nationkey"))).alias("entity")
    )
    return each.where("entity IS NOT NULL").distinct()


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, o_kind): the graph as a set of statements; each branch has one predicate, so a bound predicate leaves one branch."""

    def typed(df: DataFrame, subject: Column, cls: str, label: Column | None) -> DataFrame:
        rows = [F.struct(subject.alias("s"), F.lit(TYPE).alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind"))]
        out = df.select(rows[0].alias("q")).select("q.*")
        if label is not None:
            out = out.unionByName(df.select(subject.alias("s"), F.lit(LABEL).alias("p"), label.alias("o"), F.lit("literal").alias("o_kind")))
        return out

    orders = typed(read(spark, sf_dir, "orders"), iri("order", "o_orderkey"), "Document", None)
    suppliers = typed(read(spark, sf_dir, "supplier"), iri("supplier", "s_suppkey"), "Group", F.col("s_name"))
    parts = typed(read(spark, sf_dir, "part"), iri("part", "p_partkey"), "Thing", F.col("p_name"))
    nations = typed(read(spark, sf_dir, "nation"), iri("nation", "n_nationkey"), "Place", F.col("n_name"))
    refers = references(spark, sf_dir).select(iri("order", "o_orderkey").alias("s"), F.lit(REFERS).alias("p"), F.col("entity").alias("o"), F.lit("iri").alias("o_kind"))
    return orders.unionByName(suppliers).unionByName(parts).unionByName(nations).unionByName(refers)


#: The same graph for DuckDB.
REFERENCES_SQL = """SELECT DISTINCT l_orderkey AS o_orderkey, unnest(['urn:supplier:' || l_suppkey, 'urn:part:' || l_partkey, 'urn:nation:' || s_nationkey]) AS entity
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey"""
QUADS_SQL = f"""SELECT 'urn:order:' || o_orderkey AS s, '{TYPE}' AS p, 'Document' AS o, 'iri' AS o_kind FROM orders
  UNION ALL SELECT 'urn:supplier:' || s_suppkey, '{TYPE}', 'Group', 'iri' FROM supplier
  UNION ALL SELECT 'urn:supplier:' || s_suppkey, '{LABEL}', s_name, 'literal' FROM supplier
  UNION ALL SELECT 'urn:part:' || p_partkey, '{TYPE}', 'Thing', 'iri' FROM part
  UNION ALL SELECT 'urn:part:' || p_partkey, '{LABEL}', p_name, 'literal' FROM part
  UNION ALL SELECT 'urn:nation:' || n_nationkey, '{TYPE}', 'Place', 'iri' FROM nation
  UNION ALL SELECT 'urn:nation:' || n_nationkey, '{LABEL}', n_name, 'literal' FROM nation
  UNION ALL SELECT 'urn:order:' || o_orderkey, '{REFERS}', entity, 'iri' FROM ({REFERENCES_SQL}) r WHERE entity IS NOT NULL"""
