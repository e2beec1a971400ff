"""Queries written in SPARQL and as shapes over the graph view, streams' batch forms, and small operators; SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import context, name_like, quoted_iri, squeeze
from ..operators import checks, network, reconcile, scores
from ..streaming.append import sessions, windowed_counts
from . import shacl, sparql
from .graph_queries import _nation_letters
from .registry import query
from .star import LABEL, QUADS_SQL, REFERENCES_SQL, REFERS, TYPE, quads, read

T, R, L = "http://example.org/type", "http://example.org/refersTo", "http://example.org/label"
_NAMES = {TYPE: T, REFERS: R, LABEL: L}


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph view with the columns of a store."""
    name = F.coalesce(*[F.when(F.col("p") == k, v) for k, v in _NAMES.items()])
    none = F.lit(None).cast("string")
    return quads(spark, sf_dir).select(F.lit("").alias("graph"), "s", F.lit("iri").alias("s_kind"), name.alias("p"), "o", "o_kind", none.alias("o_dt"), none.alias("o_lang"))


_HEAD = f"PREFIX : <http://example.org/> PREFIX supplier: <urn:supplier:> # type {T}\n"


@query(f"""WITH r AS ({REFERENCES_SQL}), named AS (
  SELECT 'urn:supplier:' || s_suppkey AS entity, 'Group' AS class, s_name AS label FROM supplier UNION ALL SELECT 'urn:nation:' || n_nationkey, 'Place', n_name FROM nation)
SELECT 'urn:order:' || o_orderkey AS doc, entity, class, label FROM r JOIN named USING (entity)""")
def sparql_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and places of documents, as a query text."""
    text = _HEAD + "SELECT ?doc ?entity ?class ?label WHERE { ?doc :type <Document> ; :refersTo ?entity . ?entity :type ?class ; :label ?label . FILTER(?class IN (<Group>, <Place>)) }"
    return sparql.query(spark, statements(spark, sf_dir), text)


@query(f"""WITH r AS ({REFERENCES_SQL}) SELECT 'urn:order:' || o_orderkey AS doc, s_name AS label FROM r JOIN supplier ON entity = 'urn:supplier:' || s_suppkey WHERE entity = 'urn:supplier:7'""")
def sparql_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with a bound variable."""
    text = _HEAD + "SELECT ?doc ?entity ?label WHERE { ?doc :refersTo ?entity . ?entity :label ?label }"
    return sparql.query(spark, statements(spark, sf_dir), text, {"entity": "urn:supplier:7"}).select("doc", "label")


@query(f"""WITH r AS ({REFERENCES_SQL}), shared AS (SELECT entity, count(DISTINCT o_orderkey) AS n FROM r WHERE entity LIKE 'urn:supplier:%' GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1)
SELECT entity, s_name AS label, n::VARCHAR AS n FROM shared JOIN supplier ON entity = 'urn:supplier:' || s_suppkey""")
def sparql_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of several documents: a sub-SELECT with HAVING, and an aggregate."""
    text = _HEAD + """SELECT ?entity ?label ?n WHERE {
      { SELECT ?entity (COUNT(DISTINCT ?d) AS ?n) WHERE { ?d :type <Document> ; :refersTo ?entity FILTER(REGEX(STR(?entity), "^urn:supplier:[0-9]+$")) } GROUP BY ?entity HAVING (COUNT(DISTINCT ?d) > 1) }
      ?entity :label ?label }"""
    return sparql.query(spark, statements(spark, sf_dir), text)


@query(f"""WITH r AS MATERIALIZED ({REFERENCES_SQL}), parts AS (SELECT o_orderkey, entity FROM r WHERE starts_with(entity, 'urn:part:')),
gone AS (SELECT o_orderkey FROM r WHERE entity = 'urn:nation:3')
SELECT 'urn:order:' || o.o_orderkey AS doc, p.entity AS part FROM orders o ANTI JOIN gone USING (o_orderkey) LEFT JOIN parts p ON p.o_orderkey = o.o_orderkey""")
def sparql_optional_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OPTIONAL with a filter inside, and MINUS."""
    text = _HEAD + """SELECT ?doc ?part WHERE { ?doc :type <Document> OPTIONAL { ?doc :refersTo ?part FILTER(STRSTARTS(STR(?part), "urn:part:")) } MINUS { ?doc :refersTo <urn:nation:3> } }"""
    return sparql.query(spark, statements(spark, sf_dir), text)


@query("""SELECT label, count(*)::VARCHAR AS n FROM (SELECT s_name AS label FROM supplier UNION ALL SELECT p_name FROM part UNION ALL SELECT n_name FROM nation) x WHERE label LIKE '%ring%' OR label LIKE 'NATION_1%' GROUP BY label ORDER BY label LIMIT 20""")
def sparql_union_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION, GROUP BY, ORDER BY, LIMIT."""
    text = _HEAD + """SELECT ?label (COUNT(?s) AS ?n) WHERE { { ?s :label ?label FILTER(CONTAINS(?label, "ring")) } UNION { ?s :label ?label FILTER(STRSTARTS(?label, "NATION_1")) } } GROUP BY ?label ORDER BY ?label LIMIT 20"""
    return sparql.query(spark, statements(spark, sf_dir), text)


_SHAPES = (
    shacl.Shape("DocumentShape", (shacl.Property(R, (shacl.MinCount(1), shacl.MaxCount(12))),), "A document refers to one to twelve entities.", classes=("Document",)),
    shacl.Shape("NoNationThree", (shacl.Not(shacl.Property(R, (shacl.HasValue("<urn:nation:3>"),))),), "No document refers to nation 3.", subjects_of=(R,)),
    shacl.Shape("EntityShape", (shacl.Or((shacl.Class("Group"), shacl.Class("Place"))),), "What is referred to is a group or a place.", objects_of=(R,)),
)


@query(f"""WITH q AS ({QUADS_SQL}), n AS (SELECT d.s, count(r.o) AS n FROM q d LEFT JOIN q r ON r.s = d.s AND r.p = '{REFERS}' WHERE d.p = '{TYPE}' AND d.o = 'Document' GROUP BY d.s)
SELECT s AS focus, 'DocumentShape' AS shape FROM n WHERE n NOT BETWEEN 1 AND 12
UNION ALL SELECT DISTINCT s, 'NoNationThree' FROM q WHERE p = '{REFERS}' AND o = 'urn:nation:3'
UNION ALL SELECT DISTINCT o, 'EntityShape' FROM q WHERE p = '{REFERS}' AND o LIKE 'urn:part:%'""")
def shapes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of shapes over the graph view."""
    s = statements(spark, sf_dir).withColumn("p", F.when(F.col("p") == T, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type").otherwise(F.col("p")))
    return shacl.validate(s, "source", _SHAPES).select("focus", "shape")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and kind; the same plan serves a stream."""
    return windowed_counts(read(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""WITH o AS (SELECT user_id, ts, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 2 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps under two hours."""
    return sessions(read(spark, sf_dir, "events"), "2 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH l AS (SELECT c_mktsegment AS kind, CASE WHEN c_acctbal >= 5000 THEN 'https://d-nb.info/gnd/' || c_custkey END AS gnd, CASE WHEN c_acctbal < 1000 THEN 'https://www.wikidata.org/wiki/Q' || c_custkey END AS wd FROM customer)
SELECT kind, count(*)::BIGINT AS total, count(coalesce(gnd, wd))::BIGINT AS resolved, (count(*) - count(coalesce(gnd, wd)))::BIGINT AS unresolved, count(gnd)::BIGINT AS gnd, 0::BIGINT AS geonames, count(wd)::BIGINT AS wikidata FROM l GROUP BY kind""")
def authority_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of entities by a table of authority links."""
    customer = read(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    link = lambda start: F.concat(F.lit(start), key)
    gnd, wikidata = F.when(F.col("c_acctbal") >= 5000, link("https://d-nb.info/gnd/")), F.when(F.col("c_acctbal") < 1000, link("https://www.wikidata.org/wiki/Q"))
    known = customer.select(key.alias("id"), gnd.alias("gnd"), F.lit(None).cast("string").alias("geonames"), wikidata.alias("wikidata"))
    return reconcile.coverage(customer.select(key.alias("id"), F.col("c_mktsegment").alias("kind")), known)


@query("""WITH letters AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT n_nationkey AS node, ((SELECT count(*) FROM letters WHERE a = n_nationkey) + (SELECT count(*) FROM letters WHERE b = n_nationkey))::BIGINT AS degree FROM nation""")
def degree_with_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of all nodes, those without an edge included."""
    _, sent, got = _nation_letters(spark, sf_dir)
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000").select(F.col("o_orderkey").alias("letter"))
    pairs = sent.join(urgent, "letter").join(got, "letter").select(sent["person"].alias("src"), got["person"].alias("dst")).distinct()
    return network.degrees(pairs, read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")))


@query(r"""SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS squeezed, nullif(substr(text, 1, 10), '') AS prefix, nullif(substr(text, 21, 10), '') AS suffix FROM benchmark""")
def normalised_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space normalised, and the context of a span."""
    rows = read(spark, sf_dir, "benchmark").withColumn("c", context(F.col("text"), F.lit(10), F.lit(20), 10))
    return rows.select("item_id", squeeze(F.col("text")).alias("squeezed"), "c.prefix", "c.suffix")


@query("""SELECT p_partkey, replace(p_name, ' ', '%20') AS quoted, regexp_matches(p_name, '[^ ]{2,}') AS named FROM part""")
def quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as path segments, and whether they are like names."""
    return read(spark, sf_dir, "part").select("p_partkey", quoted_iri(F.col("p_name")).alias("quoted"), name_like(F.col("p_name")).alias("named"))


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, count(DISTINCT l_suppkey)::BIGINT AS suppliers, median(l_quantity) AS mid, min(l_quantity) AS low, max(l_quantity) AS high,
  round(coalesce(count(*) FILTER (l_discount > 0.05) / nullif(count(*), 0), 0), 9)::DOUBLE AS share FROM lineitem GROUP BY 1, 2""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, least and greatest of a measure, and a share that is 0 where it isn't defined."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.median("l_quantity").alias("mid"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(scores.ratio(F.count_if(F.col("l_discount") > 0.05), F.count(F.lit(1))), 9).alias("share")
    )


@query("""WITH a AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT o_custkey, o_orderpriority, count(*) FILTER (s = 'a')::BIGINT AS a, count(*) FILTER (s = 'b')::BIGINT AS b FROM (SELECT *, 'a' AS s FROM a UNION ALL SELECT *, 'b' FROM b) x GROUP BY 1, 2)
SELECT * FROM c WHERE a <> b""")
def result_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two results differ as multisets."""
    orders = read(spark, sf_dir, "orders")
    part = lambda k: orders.where(F.col("o_orderstatus") == k).select("o_custkey", "o_orderpriority")
    return checks.multiset_difference(part("F"), part("O"))


@query("""SELECT doc_id, side FROM (SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang <> 'de') x
UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM documents WHERE lang <> 'de' EXCEPT SELECT doc_id FROM labels) y)""")
def exact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of two tables has."""
    return checks.set_mismatch(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id"), "doc_id")


@query("""SELECT coalesce(f.letter, m.letter) AS letter, CASE WHEN f.h IS NULL THEN 'missing' WHEN m.h IS NULL THEN 'unexpected' ELSE 'changed' END AS problem
FROM (SELECT doc_id AS letter, sha256(text) AS h FROM documents WHERE lang <> 'fr') f
FULL JOIN (SELECT doc_id AS letter, CASE WHEN source = 'src2' THEN sha256(text || '.') ELSE sha256(text) END AS h FROM documents WHERE lang <> 'es') m ON f.letter = m.letter WHERE f.h IS DISTINCT FROM m.h""")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a manifest of their digests: what is missing, unexpected or changed."""
    docs = read(spark, sf_dir, "documents")
    digest = lambda text: F.sha2(text.cast("binary"), 256).alias("sha256")
    files = docs.where("lang <> 'fr'").select(F.col("doc_id").alias("letter"), digest(F.col("text")))
    changed = F.when(F.col("source") == "src2", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return checks.manifest_mismatch(files, docs.where("lang <> 'es'").select(F.col("doc_id").alias("letter"), digest(changed)))
