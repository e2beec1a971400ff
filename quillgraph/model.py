"""Names and schemas that all parts share."""

from __future__ import annotations

# Public namespaces.
CRM = "http://www.cidoc-crm.org/cidoc-crm/"
DCTERMS = "http://purl.org/dc/terms/"
OA = "http://www.w3.org/ns/oa#"
PROV = "http://www.w3.org/ns/prov#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TEI = "http://www.tei-c.org/ns/1.0"
XML = "http://www.w3.org/XML/1998/namespace"

#: The vocabulary of this engine's own terms; a deployment may set another.
OWN = "https://example.org/quillgraph/vocab#"
PREFIXES = {"crm": CRM, "dcterms": DCTERMS, "oa": OA, "prov": PROV, "rdf": RDF, "rdfs": RDFS, "xsd": XSD, "q": OWN}

KINDS = ("PER", "LOC", "ORG")
CLASSES = {"PER": CRM + "E21_Person", "LOC": CRM + "E53_Place", "ORG": CRM + "E74_Group"}

#: Terms of the own vocabulary: name, kind, English label.
TERMS = (
    ("Candidate", "Class", "a name that was recognised but not confirmed"),
    ("Run", "Class", "one run of the engine over a document"),
    ("origin", "Property", "whether a mention is editorial or automatic"),
    ("editorial", "Individual", "marked up by an editor"),
    ("automatic", "Individual", "found by the engine"),
    ("suggestedClass", "Property", "the class a candidate would have"),
    ("confidence", "Property", "score of an automatic mention"),
    ("unresolved", "Property", "a reference that leads nowhere"),
    ("engine", "Property", "recogniser of a run"),
    ("softwareVersion", "Property", "version of the engine of a run"),
    ("setting", "Property", "a setting of a run"),
    ("sending", "Individual", "type of the event of sending"),
    ("receiving", "Individual", "type of the event of receiving"),
    ("certainty", "Property", "certainty of a date, as stated"),
    ("evidence", "Property", "evidence of a date, as stated"),
    ("accepted", "Individual", "verdict: the suggestion holds"),
    ("rejected", "Individual", "verdict: the suggestion doesn't hold"),
    ("note", "Property", "a reviewer's note"),
)


def vocabulary_statements() -> list[tuple]:
    """The vocabulary as statements."""
    kinds = {"Class": RDFS + "Class", "Property": RDF + "Property", "Individual": RDFS + "Resource"}
    out = []
    for name, kind, label in TERMS:
        out.append((OWN + name, "iri", RDF + "type", kinds[kind], "iri", None, None))
        out.append((OWN + name, "iri", RDFS + "label", label, "literal", None, "en"))
    return out
