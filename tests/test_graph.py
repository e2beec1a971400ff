"""Turtle, stores, SPARQL, shapes."""

import pytest

from quillgraph.model import PREFIXES, vocabulary_statements
from quillgraph.plans import shacl, sparql
from quillgraph.plans.star import LABEL, REFERS, TYPE, quads
from quillgraph.sources import store, turtle
from quillgraph.sources.turtle import TurtleError

EX = "http://ex.org/"
TEXT = """@prefix ex: <http://ex.org/> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
ex:d1 a ex:Doc ; ex:ref ex:p1, ex:p2 ; ex:n 3 . # comment
ex:d2 a ex:Doc ; ex:ref ex:p1 ; ex:n 4.5 ; ex:ok true .
ex:p1 a ex:Person ; rdfs:label "Anna"@de, "Ann" . ex:p2 a ex:Place ; rdfs:label "Wien \\"W\\"\\n" ; ex:in ex:p3 . ex:p3 ex:in ex:p4 .
ex:a1 ex:target [ ex:sel [ ex:v "x" ], [ ex:v "y" ] ; ex:src ex:d1 ] ; ex:list ( 1 2 ) .
"""
HEAD = "PREFIX ex: <http://ex.org/> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> "


def test_turtle_round_trip_is_stable():
    prefixes = {"ex": EX}
    once = turtle.write(turtle.parse(TEXT, "a."), prefixes)
    assert turtle.write(turtle.parse(once, "b."), prefixes) == once
    assert len(turtle.parse(TEXT)) == len(turtle.parse(once))
    assert turtle.write(vocabulary_statements(), PREFIXES).startswith("@prefix crm:")


@pytest.mark.parametrize("bad", ["x:a x:b x:c .", "<a> <b>", "<a> <b> <c>", '<a> <b> "x', "<a> [ <b> <c> .", "@prefix x <y> ."])
def test_broken_turtle(bad):
    with pytest.raises(TurtleError):
        turtle.parse(bad)


def test_store_appends_as_a_set(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TEXT)
    db = str(tmp_path / "db")
    scan = store.scan_turtle(spark, str(tmp_path / "a.ttl"))
    n = scan.count()
    assert store.append(spark, db, scan) == (0, n)
    assert store.append(spark, db, scan) == (n, n)
    (tmp_path / "b.ttl").write_text("<http://ex.org/z> <http://ex.org/n> 1 . [] <http://ex.org/n> 2 .")
    assert store.append(spark, db, store.scan_turtle(spark, [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl")])) == (n, n + 2)


@pytest.fixture(scope="module")
def graph(spark):
    return store.from_statements(spark, turtle.parse(TEXT, "f."), "g1").cache()


CASES = [
    ("SELECT ?d ?e ?c ?l WHERE { ?d a ex:Doc ; ex:ref ?e . ?e a ?c ; rdfs:label ?l FILTER(?c IN (ex:Person)) } ORDER BY ?d ?l", [("d1", "p1", "Person", "Ann"), ("d1", "p1", "Person", "Anna"), ("d2", "p1", "Person", "Ann"), ("d2", "p1", "Person", "Anna")]),
    ('SELECT ?e ?doc WHERE { { SELECT ?e WHERE { ?b a ex:Doc ; ex:ref ?e FILTER(REGEX(STR(?e), "p[0-9]+$")) } GROUP BY ?e HAVING (COUNT(DISTINCT ?b) > 1) } ?doc ex:ref ?e } ORDER BY ?doc', [("p1", "d1"), ("p1", "d2")]),
    ("SELECT DISTINCT ?p ?x WHERE { ?p rdfs:label ?l OPTIONAL { ?p ex:in ?x } } ORDER BY ?p", [("p1", None), ("p2", "p3")]),
    ("SELECT (COUNT(?e) AS ?n) ?d WHERE { ?d ex:ref ?e } GROUP BY ?d ORDER BY DESC(?n)", [("2", "d1"), ("1", "d2")]),
    ("SELECT ?v WHERE { ?a ex:target [ ex:sel [ ex:v ?v ] ] } ORDER BY DESC(?v)", [("y",), ("x",)]),
    ("SELECT ?x WHERE { ex:p2 ex:in+ ?x } ORDER BY ?x", [("p3",), ("p4",)]),
    ("SELECT ?x WHERE { ?x ^ex:in/^ex:in ex:p2 } ", [("p4",)]),
    ("SELECT ?x WHERE { { ?x a ex:Person } UNION { ?x a ex:Place } MINUS { ?x ex:in ?y } }", [("p1",)]),
    ("SELECT ?d ?m WHERE { ?d ex:n ?n BIND(?n * 2 AS ?m) FILTER(?n > 3.5 && ?n != 7) }", [("d2", "9")]),
    ("SELECT ?l WHERE { VALUES ?e { ex:p1 } ?e rdfs:label ?l FILTER(LANG(?l) = 'de') }", [("Anna",)]),
    ("SELECT ?d WHERE { ?d a ex:Doc FILTER NOT EXISTS { ?d ex:ref ex:p2 } }", [("d2",)]),
    ("SELECT ?d WHERE { ?d a ex:Doc FILTER EXISTS { ?d ex:ref ex:p2 } }", [("d1",)]),
    ("SELECT ?g ?d WHERE { GRAPH ?g { ?d ex:n ?n } } ORDER BY DESC(?n) LIMIT 1", [("g1", "d2")]),
    ("SELECT ?d WHERE { ?d ex:n ?n } ORDER BY ?n OFFSET 1", [("d2",)]),
    ("SELECT (SUM(?n) AS ?s) (AVG(?n) AS ?a) (MIN(?n) AS ?lo) (MAX(?n) AS ?hi) WHERE { ?d ex:n ?n }", [("7.5", "3.75", "3", "4.5")]),
    ("SELECT (IF(BOUND(?x), 'y', 'n') AS ?b) (COALESCE(?x, ?p) AS ?c) WHERE { ?p a ex:Person OPTIONAL { ?p ex:in ?x } }", [("n", "p1")]),
    ("SELECT (GROUP_CONCAT(?v; SEPARATOR='|') AS ?vs) WHERE { ?s ex:v ?v }", [("x|y",)]),
    ("SELECT ?x WHERE { ?x ex:none ?y }", []),
]


@pytest.mark.parametrize(("text", "rows"), CASES)
def test_sparql(spark, graph, text, rows):
    got = sparql.query(spark, graph, HEAD + text)
    assert [tuple(v.removeprefix(EX) if isinstance(v, str) else v for v in r) for r in got.collect()] == rows


def test_bindings(spark, graph):
    q = HEAD + "SELECT ?d ?l WHERE { ?d ex:ref ?e . ?e rdfs:label ?l }"
    assert {r["d"] for r in sparql.query(spark, graph, q, {"?d": EX + "d2"}).collect()} == {EX + "d2"}
    assert sparql.query(spark, graph, q, {"l": "Ann"}).count() == 2
    assert sparql.query(spark, graph, q, {"l": "Anna"}).count() == 0  # a tagged literal isn't an untyped one
    with pytest.raises(sparql.SparqlError, match="not selected"):
        sparql.query(spark, graph, q, {"e": EX + "p1"})
    bound = sparql.query(spark, graph, q, {"d": EX + "d2"})
    assert EX + "d2" in bound._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bad", ["ASK { ?s ?p ?o }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p }", "SELECT WHERE { ?s ?p ?o }", "SELECT ?s WHERE { ?s x:p ?o }", "SELECT ?s WHERE { ?s ?p ?o", "SELECT ?x WHERE { SERVICE <http://a/> { ?x ?y ?z } }", "SELECT ?p (COUNT(?s) AS ?n) WHERE { ?s ?p ?o }"])
def test_rejected_queries(spark, graph, bad):
    with pytest.raises(sparql.SparqlError):
        sparql.query(spark, graph, bad)


def test_sparql_equals_the_plan_by_hand(spark):
    sf = "/root/testdata/sf0.001"
    q = quads(spark, sf)
    typed = q.selectExpr("'' AS graph", "s", "'iri' AS s_kind", f"CASE p WHEN '{TYPE}' THEN 'http://t' WHEN '{REFERS}' THEN 'http://r' WHEN '{LABEL}' THEN 'http://l' END AS p", "o", "o_kind", "CAST(NULL AS string) AS o_dt", "CAST(NULL AS string) AS o_lang")
    text = "SELECT ?d ?e ?c ?l WHERE { ?d <http://t> <Document> ; <http://r> ?e . ?e <http://t> ?c ; <http://l> ?l . FILTER(?c IN (<Group>, <Place>)) }"
    from quillgraph.plans.graph_queries import q1_refs

    assert sorted(map(tuple, sparql.query(spark, typed, text).collect())) == sorted(map(tuple, q1_refs(spark, sf).collect()))


BAD = """@prefix oa: <http://www.w3.org/ns/oa#> . @prefix crm: <http://www.cidoc-crm.org/cidoc-crm/> . @prefix q: <https://example.org/quillgraph/vocab#> .
@prefix x: <http://x/> . @prefix prov: <http://www.w3.org/ns/prov#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
x:good a oa:Annotation ; q:origin q:automatic ; prov:wasGeneratedBy x:run ; q:confidence 0.5 ; oa:hasTarget [ oa:hasSource x:f ; oa:hasSelector x:s ] .
x:bare a oa:Annotation ; q:origin q:automatic ; q:confidence 1.5 .
x:two a oa:Annotation ; oa:hasTarget [ oa:hasSource x:f, x:g ; oa:hasSelector x:s ] .
x:run a prov:Activity ; q:engine "glossary" .
x:c a q:Candidate, crm:E21_Person . x:k a q:Candidate . x:d crm:P67_refers_to x:c, x:k .
x:e a crm:E7_Activity ; crm:P14_carried_out_by x:p . x:e2 a crm:E7_Activity ; crm:P2_has_type q:sending ; crm:P14_carried_out_by x:p .
x:t a crm:E52_Time-Span ; crm:P82a_begin_of_the_begin "1900-01-02T00:00:00"^^xsd:dateTime ; crm:P82b_end_of_the_end "1900-01-01T00:00:00"^^xsd:dateTime .
x:u a crm:E52_Time-Span ; crm:P82a_begin_of_the_begin "1900-01-02T00:00:00"^^xsd:dateTime .
x:v a oa:Annotation ; oa:motivatedBy oa:assessing ; oa:hasTarget x:good ; oa:hasBody q:accepted .
"""


def test_shapes(spark):
    q = store.from_statements(spark, turtle.parse(BAD, "g."))
    found = lambda p: [(r["shape"], r["focus"].removeprefix("http://x/")) for r in shacl.validate(q, p).collect()]
    both = [("AutomaticProvenanceShape", "bare"), ("ConfidenceShape", "bare"), ("EventShape", "e"), ("MentionTargetShape", "bare"), ("MentionTargetShape", "two"), ("RunShape", "run"), ("TimeSpanShape", "t")]
    assert found("source") == sorted([*both, ("CandidateShape", "c"), ("P67SourceShape", "c"), ("P67SourceShape", "k")])
    assert found("reviewed") == sorted([*both, ("P67ReviewedShape", "k"), ("AssessingShape", "v")])
    with pytest.raises(ValueError):
        shacl.validate(q, "other")
