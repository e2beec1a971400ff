"""Queries over the graph view: patterns, unions, references, networks, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators import network
from .registry import query
from .star import LABEL, QUADS_SQL, REFERENCES_SQL, REFERS, TYPE, quads, read, references

_Q1 = f"""WITH q AS ({QUADS_SQL})
SELECT d.s AS doc, r.o AS entity, c.o AS class, l.o AS label
FROM q d JOIN q r ON r.s = d.s AND r.p = '{REFERS}' JOIN q c ON c.s = r.o AND c.p = '{TYPE}' JOIN q l ON l.s = r.o AND l.p = '{LABEL}'
WHERE d.p = '{TYPE}' AND d.o = 'Document' AND c.o IN ('Group', 'Place')"""


def _pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quads(spark, sf_dir)
    docs = q.where((F.col("p") == TYPE) & (F.col("o") == "Document")).select(F.col("s").alias("doc"))
    refers = q.where(F.col("p") == REFERS).select(F.col("s").alias("doc"), F.col("o").alias("entity"))
    classes = q.where((F.col("p") == TYPE) & F.col("o").isin("Group", "Place")).select(F.col("s").alias("entity"), F.col("o").alias("class"))
    labels = q.where(F.col("p") == LABEL).select(F.col("s").alias("entity"), F.col("o").alias("label"))
    return refers.join(docs, "doc").join(classes.join(labels, "entity"), "entity").select("doc", "entity", "class", "label")


@query(_Q1 + " ORDER BY doc, entity")
def q1_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and places of each document: type, reference, class and label patterns over the set of statements."""
    return _pattern(spark, sf_dir).orderBy("doc", "entity")


@query(_Q1 + " AND d.s = 'urn:order:7' ORDER BY doc, entity")
def q1_refs_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the document bound; the binding reaches the scans as a filter."""
    return _pattern(spark, sf_dir).where(F.col("doc") == "urn:order:7").orderBy("doc", "entity")


@query(f"""WITH r AS ({REFERENCES_SQL}), shared AS (
  SELECT entity FROM r WHERE regexp_matches(entity, '^urn:supplier:') GROUP BY entity HAVING count(DISTINCT o_orderkey) > 1)
SELECT r.entity, s_name AS label, 'urn:order:' || o_orderkey AS doc FROM r JOIN shared USING (entity) JOIN supplier ON entity = 'urn:supplier:' || s_suppkey ORDER BY 1, 2, 3""")
def q3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that more than one document refers to: an aggregate decides, then its members are expanded."""
    refers = references(spark, sf_dir).where(F.col("entity").rlike("^urn:supplier:"))
    shared = refers.groupBy("entity").agg(F.countDistinct("o_orderkey").alias("n")).where("n > 1").select("entity")
    names = read(spark, sf_dir, "supplier").select(F.concat(F.lit("urn:supplier:"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_name").alias("label"))
    return refers.join(shared, "entity", "left_semi").join(names, "entity").select("entity", "label", F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")).alias("doc")).orderBy("entity", "label", "doc")


@query(QUADS_SQL)
def quads_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements of the view."""
    return quads(spark, sf_dir)


@query(f"SELECT p, count(*)::BIGINT AS n FROM ({QUADS_SQL}) q GROUP BY p UNION ALL SELECT 'all', count(*)::BIGINT FROM ({QUADS_SQL}) q")
def triple_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by predicate and in all, in one pass."""
    rolled = quads(spark, sf_dir).rollup("p").agg(F.count(F.lit(1)).alias("n"), F.grouping("p").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "all").otherwise(F.col("p")).alias("p"), "n")


@query("SELECT l_suppkey % 10 AS grp, count(*)::BIGINT AS bag, count(DISTINCT (l_orderkey, l_suppkey))::BIGINT AS set FROM lineitem GROUP BY 1")
def union_vs_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as a bag and as a set: pairs are counted once each, after they are made distinct in each task."""
    pairs = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy((F.col("l_suppkey") % 10).alias("grp")).agg(F.sum("n").alias("bag"), F.count(F.lit(1)).alias("set"))


@query("""SELECT o_orderkey, count(DISTINCT l_suppkey)::BIGINT AS resolved, (count(l_suppkey) = 0) AS unresolved
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def ref_resolve_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved per document; documents without any are kept and flagged."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(F.countDistinct("l_suppkey").alias("resolved"), (F.count("l_suppkey") == 0).alias("unresolved"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected ids that a cache doesn't have."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey")
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities for which a pattern holds at all."""
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("""SELECT c_custkey, coalesce(s_name, CASE WHEN n_nationkey < 20 THEN n_name END, c_mktsegment) AS authority,
  CASE WHEN s_name IS NOT NULL THEN 'own' WHEN n_nationkey < 20 THEN 'cache' ELSE 'reference' END AS source
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def authority_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register's own id comes before the cache's, and this before a direct reference."""
    customer, supplier = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    nation = read(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    joined = customer.join(supplier, F.col("c_custkey") == F.col("s_suppkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    source = F.when(F.col("s_name").isNotNull(), "own").when(F.col("n_name").isNotNull(), "cache").otherwise("reference")
    return joined.select("c_custkey", F.coalesce("s_name", "n_name", "c_mktsegment").alias("authority"), source.alias("source"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS entity FROM lineitem)
SELECT x.entity AS a, y.entity AS b, count(*)::BIGINT AS weight FROM m x JOIN m y ON x.doc = y.doc AND x.entity < y.entity GROUP BY 1, 2""")
def comention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers in the same orders."""
    return network.comention_edges(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("entity")))


_LETTERS = """WITH letters AS (
  SELECT DISTINCT o_orderkey AS letter, c_nationkey AS src, s_nationkey AS dst, strftime(o_orderdate, '%Y-%m-%d') AS day
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)"""


def _nation_letters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    lines, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    letters = orders.select(F.col("o_orderkey").alias("letter"), day.alias("begin"), day.alias("end"), F.lit("sent").alias("source"))
    sent = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("letter"), F.col("c_nationkey").alias("person"))
    got = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("letter"), F.col("s_nationkey").alias("person"))
    return letters, sent, got


@query(_LETTERS + """ SELECT src, dst, count(DISTINCT letter)::BIGINT AS weight, string_agg(letter || ' ' || day, ';' ORDER BY letter) AS letters FROM letters GROUP BY src, dst""")
def corresp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondence of nations: weight and the letters, in order."""
    edges = network.correspondence_edges(*_nation_letters(spark, sf_dir))
    listed = F.array_join(F.transform("letters", lambda x: F.concat(x["letter"].cast("string"), F.lit(" "), x["begin"])), ";")
    return edges.select("src", "dst", "weight", listed.alias("letters"))


@query(f"""WITH r AS ({REFERENCES_SQL})
SELECT 'urn:order:' || o_orderkey AS doc, r.entity, CASE WHEN s_name IS NOT NULL THEN 'Group' WHEN p_name IS NOT NULL THEN 'Thing' END AS classes
FROM r LEFT JOIN supplier ON r.entity = 'urn:supplier:' || s_suppkey LEFT JOIN part ON r.entity = 'urn:part:' || p_partkey
WHERE coalesce(s_name, p_name) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT 'urn:part:' || p_partkey AS prefix FROM part WHERE p_size = 1) x WHERE starts_with(r.entity, x.prefix))""")
def bipartite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their entities with allowed classes, without entities that begin with the IRI of a part of size 1."""
    prefixes = read(spark, sf_dir, "part").where("p_size = 1").select(F.concat(F.lit("urn:part:"), F.col("p_partkey").cast("string")).alias("prefix"))
    typed = quads(spark, sf_dir).where((F.col("p") == TYPE) & F.col("o").isin("Group", "Thing"))
    classes = typed.groupBy(F.col("s").alias("entity")).agg(F.array_join(F.array_sort(F.collect_set("o")), ";").alias("classes"))
    outside = network.outside_prefixes(classes, prefixes)
    return references(spark, sf_dir).join(outside, "entity").select(F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")).alias("doc"), "entity", "classes")


@query(_LETTERS + """, ends AS (SELECT DISTINCT src, dst FROM letters)
SELECT node, count(*)::BIGINT AS degree FROM (SELECT src AS node FROM ends UNION ALL SELECT dst FROM ends) e GROUP BY node ORDER BY degree DESC, node LIMIT 10""")
def degree_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nodes of the highest total degree; a loop counts twice."""
    edges = network.correspondence_edges(*_nation_letters(spark, sf_dir))
    return network.degrees(edges).orderBy(F.desc("degree"), "node").limit(10)


@query()
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the network of orders and their parts. Recursive SQL is too slow for it; a test compares small graphs by hand."""
    lines = read(spark, sf_dir, "lineitem")
    edges = lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return network.components(edges)


@query()
def betweenness_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nations of the highest betweenness where single letters count for little: edges of at least the mean weight."""
    edges = network.correspondence_edges(*_nation_letters(spark, sf_dir)).select("src", "dst", "weight")
    mean = edges.agg(F.avg("weight")).head()[0] or 0.0
    top = network.betweenness(edges.where(F.col("weight") >= mean), directed=True)
    return top.select("node", F.round("betweenness", 10).alias("betweenness")).orderBy(F.desc("betweenness"), "node").limit(10)


@query("""SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://(www|m)[.][^/]+/[a-z]+/', 0) AS prefix FROM pages) x
  WHERE prefix <> '' AND starts_with(p.url, x.prefix))""")
def prefix_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages outside what hosts with www or m have in a language."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    prefixes = pages.select(F.regexp_extract("url", "^[a-z]+://(www|m)[.][^/]+/[a-z]+/", 0).alias("prefix")).where("prefix <> ''").distinct()
    return network.outside_prefixes(pages.withColumnRenamed("url", "entity"), prefixes).select("page_id", F.col("entity").alias("url"))


@query("""WITH RECURSIVE edge AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM edge UNION ALL SELECT up.node, e.parent, depth + 1 FROM up JOIN edge e ON e.child = up.ancestor)
SELECT node, ancestor, depth FROM up""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each node of the place hierarchy."""
    pairs = [("customer", "c", "c_custkey", "n", "c_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    customers, nations = (
        read(spark, sf_dir, table).select(F.concat(F.lit(x), F.col(child).cast("string")).alias("child"), F.concat(F.lit(y), F.col(parent).cast("string")).alias("parent"))
        for table, x, child, y, parent in pairs
    )
    return network.ancestors(customers.unionByName(nations))


@query("""WITH n AS (SELECT o_orderkey, count(l_linenumber) AS lines, count(DISTINCT l_linenumber) AS numbers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'urn:order:' || o_orderkey AS focus, 'LineShape' AS shape, 'min' AS message FROM n WHERE lines < 1
UNION ALL SELECT 'urn:order:' || o_orderkey, 'LineShape', 'max' FROM n WHERE lines > 9
UNION ALL SELECT 'urn:order:' || o_orderkey, 'NumberShape', 'distinct' FROM n WHERE numbers < lines""")
def shape_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of how many values a focus may have; a focus without any counts as zero."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("lines"), F.countDistinct("l_linenumber").alias("numbers"))
    each = read(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["lines", "numbers"])
    found = F.array(
        F.when(F.col("lines") < 1, F.struct(F.lit("LineShape").alias("shape"), F.lit("min").alias("message"))),
        F.when(F.col("lines") > 9, F.struct(F.lit("LineShape").alias("shape"), F.lit("max").alias("message"))),
        F.when(F.col("numbers") < F.col("lines"), F.struct(F.lit("NumberShape").alias("shape"), F.lit("distinct").alias("message"))),
    )
    listed = each.select(F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string")).alias("focus"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v"))
    return listed.select("focus", "v.shape", "v.message")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'range' AS message FROM lineitem WHERE NOT (l_discount BETWEEN 0 AND 0.09 AND l_quantity >= 2)
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 'in' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""")
def shape_range_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of value ranges and value lists."""
    lines = read(spark, sf_dir, "lineitem")
    found = F.array(F.when(~(F.col("l_discount").between(0, 0.09) & (F.col("l_quantity") >= 2)), F.lit("range")), F.when(~F.col("l_returnflag").isin("A", "N"), F.lit("in")))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("message"))


@query("""SELECT o_orderkey, count(*)::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT o_orderdate <= l_shipdate GROUP BY 1""")
def shape_pair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one property of a focus is not at most another: lines shipped before their order's date."""
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).where(~(F.col("o_orderdate") <= F.col("l_shipdate"))).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH focus AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
f AS (SELECT k, max((l_returnflag = 'R')::INT) AS returned, max((l_linestatus = 'O')::INT) AS open, max((s_nationkey IS NOT NULL AND s_nationkey < 5)::INT) AS near
  FROM focus JOIN lineitem ON l_orderkey = k LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY k)
SELECT k AS focus, (returned = 0 OR open = 1) AS either, (near = 0) AS never, (returned = 1 AND open = 0 AND near = 1) AS violates FROM f""")
def shape_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjunction, negation and a class test on values, per focus."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus")
    near = read(spark, sf_dir, "supplier").where("s_nationkey < 5").select("s_suppkey", F.lit(True).alias("is_near"))
    flags = lines.join(near, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy(F.col("l_orderkey").alias("focus")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_linestatus") == "O").alias("open"), F.bool_or(F.coalesce("is_near", F.lit(False))).alias("near")
    )
    return flags.select("focus", (~F.col("returned") | F.col("open")).alias("either"), (~F.col("near")).alias("never"), (F.col("returned") & ~F.col("open") & F.col("near")).alias("violates"))


@query("""SELECT s_suppkey, 'urn:candidate:group/' || left(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-'), 48) || '-' || left(sha256(lower(s_name)), 10) AS iri FROM supplier""")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of candidates from their labels."""
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("urn:candidate:group/"), slug("s_name")).alias("iri"))
