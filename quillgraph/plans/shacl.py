"""Shape checks over statements: shapes are data, checks are joins and aggregations.

A constraint is worked out for a set of nodes at once and gives whether it holds for each; logical constraints combine these.
Two profiles: ``source`` for graphs as they are built, ``reviewed`` for graphs with verdicts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import PATTERN, micros
from ..model import CRM, DCTERMS, OA, OWN, PROV, RDF, XSD
from .sparql import lexical, number, term_of


@dataclass(frozen=True)
class Class:
    """The node has this type."""

    iri: str


@dataclass(frozen=True)
class In:
    values: tuple[str, ...]


@dataclass(frozen=True)
class HasValue:
    value: str


@dataclass(frozen=True)
class MinCount:
    n: int


@dataclass(frozen=True)
class MaxCount:
    n: int


@dataclass(frozen=True)
class MinInclusive:
    x: float


@dataclass(frozen=True)
class MaxInclusive:
    x: float


@dataclass(frozen=True)
class LessThanOrEquals:
    path: str


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Property:
    path: str
    constraints: tuple


@dataclass(frozen=True)
class Shape:
    name: str
    constraints: tuple
    message: str
    classes: tuple[str, ...] = ()
    objects_of: tuple[str, ...] = ()
    subjects_of: tuple[str, ...] = ()
    profile: str | None = None


def iri(value: str) -> str:
    return f"<{value}>"


_automatic = Not(Property(OWN + "origin", (HasValue(iri(OWN + "automatic")),)))
_assessing = Property(OA + "motivatedBy", (HasValue(iri(OA + "assessing")),))
_target = And((Property(OA + "hasSource", (MinCount(1), MaxCount(1))), Property(OA + "hasSelector", (MinCount(1),))))
_typed = (Class(CRM + "E21_Person"), Class(CRM + "E53_Place"), Class(CRM + "E74_Group"))
SHAPES: tuple[Shape, ...] = (
    Shape("CandidateShape", (Property(RDF + "type", (Not(In(tuple(iri(c.iri) for c in _typed))),)),), "A candidate carries no CRM class.", classes=(OWN + "Candidate",), profile="source"),
    Shape("P67SourceShape", (Not(Class(OWN + "Candidate")),), "No reference leads to a candidate in a source graph.", objects_of=(CRM + "P67_refers_to",), profile="source"),
    Shape("P67ReviewedShape", (Or((Not(Class(OWN + "Candidate")), *_typed)),), "A reference leads to a candidate only if it has a CRM class.", objects_of=(CRM + "P67_refers_to",), profile="reviewed"),
    Shape(
        "MentionTargetShape",
        (Or((And((_assessing, Property(OA + "hasTarget", (MinCount(1), MaxCount(1), Class(OA + "Annotation"))))), And((Not(_assessing), Property(OA + "hasTarget", (MinCount(1), MaxCount(1), _target)))))),),
        "An annotation has one target with one source and a selector; a verdict has one annotation as target.",
        classes=(OA + "Annotation",),
        subjects_of=(OWN + "origin",),
    ),
    Shape("AutomaticProvenanceShape", (Or((_automatic, Property(PROV + "wasGeneratedBy", (MinCount(1),)), Property(PROV + "wasAttributedTo", (MinCount(1),)))),), "An automatic mention has a run or an earlier application.", classes=(OA + "Annotation",)),
    Shape("ConfidenceShape", (Or((_automatic, Property(OWN + "confidence", (MaxCount(1), MinInclusive(0), MaxInclusive(1))))),), "An automatic mention has one confidence at most, from 0 to 1.", classes=(OA + "Annotation",)),
    Shape(
        "EventShape",
        (Property(CRM + "P2_has_type", (MinCount(1), MaxCount(1), In((iri(OWN + "sending"), iri(OWN + "receiving"))))), Property(CRM + "P14_carried_out_by", (MinCount(1),))),
        "An event is one of sending or receiving and has someone who carried it out.",
        classes=(CRM + "E7_Activity",),
    ),
    Shape("TimeSpanShape", (Property(CRM + "P82a_begin_of_the_begin", (LessThanOrEquals(CRM + "P82b_end_of_the_end"),)),), "A time-span doesn't begin after its end.", classes=(CRM + "E52_Time-Span",)),
    Shape("RunShape", (Property(OWN + "engine", (MinCount(1),)), Property(OWN + "softwareVersion", (MinCount(1),))), "A run names its engine and version.", classes=(PROV + "Activity",)),
    Shape(
        "AssessingShape",
        (Or((Not(_assessing), And((Property(DCTERMS + "creator", (MinCount(1), MaxCount(1))), Property(DCTERMS + "created", (MinCount(1), MaxCount(1))), Property(OA + "hasBody", (MinCount(1), MaxCount(1), In((iri(OWN + "accepted"), iri(OWN + "rejected"))))))))),),
        "A verdict has a creator, a time and one of the known values.",
        classes=(OA + "Annotation",),
        profile="reviewed",
    ),
)


class Validator:
    def __init__(self, quads: DataFrame):
        rows = quads.select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang").distinct()
        self.statements = rows.select(term_of("s", "s_kind").alias("node"), "p", term_of("o", "o_kind", "o_dt", "o_lang").alias("value"))

    def values(self, path: str) -> DataFrame:
        return self.statements.where(F.col("p") == path).select("node", "value")

    def of_class(self, cls: str) -> DataFrame:
        return self.statements.where((F.col("p") == RDF + "type") & (F.col("value") == iri(cls))).select("node")

    def targets(self, shape: Shape) -> DataFrame:
        found = [self.of_class(c) for c in shape.classes]
        found += [self.values(p).select(F.col("value").alias("node")) for p in shape.objects_of]
        found += [self.values(p).select("node") for p in shape.subjects_of]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out.distinct()

    def holds(self, c: object, nodes: DataFrame) -> DataFrame:
        """(node, ok) for each of ``nodes`` (node, distinct)."""
        if isinstance(c, (And, Or)):
            out = nodes.withColumn("ok", F.lit(isinstance(c, And)))
            for part in c.parts:
                got = self.holds(part, nodes).withColumnRenamed("ok", "__ok")
                both = F.col("ok") & F.col("__ok") if isinstance(c, And) else F.col("ok") | F.col("__ok")
                out = out.join(got, "node").select("node", both.alias("ok"))
            return out
        if isinstance(c, Not):
            return self.holds(c.inner, nodes).select("node", (~F.col("ok")).alias("ok"))
        if isinstance(c, Class):
            member = self.of_class(c.iri).withColumn("__in", F.lit(True))
            return nodes.join(member, "node", "left").select("node", F.coalesce("__in", F.lit(False)).alias("ok"))
        if isinstance(c, (In, HasValue, MinInclusive, MaxInclusive)):
            return nodes.select("node", self.simple(c, F.col("node")).alias("ok"))
        if isinstance(c, Property):
            return self.property(c, nodes)
        raise TypeError(f"unknown constraint {c!r}")

    @staticmethod
    def simple(c: object, value: Column) -> Column:
        if isinstance(c, In):
            return value.isin(*c.values)
        if isinstance(c, HasValue):
            return value == c.value
        x = number(value)
        return F.coalesce(x >= c.x if isinstance(c, MinInclusive) else x <= c.x, F.lit(False))

    def property(self, c: Property, nodes: DataFrame) -> DataFrame:
        values = nodes.join(self.values(c.path), "node")
        counted = nodes.join(values.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))
        ok = F.lit(True)
        checks: list[DataFrame] = []
        for k in c.constraints:
            if isinstance(k, MinCount):
                ok = ok & (F.col("n") >= k.n)
            elif isinstance(k, MaxCount):
                ok = ok & (F.col("n") <= k.n)
            elif isinstance(k, HasValue):
                checks.append(values.groupBy("node").agg(F.bool_or(F.col("value") == k.value).alias("x")))
                ok = ok & F.coalesce(F.col(f"x{len(checks)}"), F.lit(False))
            else:
                checks.append(self.each_value(k, values))
                ok = ok & F.coalesce(F.col(f"x{len(checks)}"), F.lit(True))
        out = counted
        for at, check in enumerate(checks, 1):
            out = out.join(check.select("node", F.col("x").alias(f"x{at}")), "node", "left")
        return out.select("node", ok.alias("ok"))

    def each_value(self, k: object, values: DataFrame) -> DataFrame:
        """(node, x): whether all of a node's values meet the constraint."""
        if isinstance(k, LessThanOrEquals):
            other = values.join(self.values(k.path).withColumnRenamed("value", "other"), "node")
            a, b = lexical(F.col("value")), lexical(F.col("other"))
            x, y = number(F.col("value")), number(F.col("other"))
            dated = a.rlike(PATTERN) & b.rlike(PATTERN) & (a.rlike(r"T.*(Z|[+-]\d\d:\d\d)$") == b.rlike(r"T.*(Z|[+-]\d\d:\d\d)$"))
            good = F.when(x.isNotNull() & y.isNotNull(), x <= y).when(dated, micros(a) <= micros(b))
            return other.groupBy("node").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("x"))
        inner = self.holds(k, values.select(F.col("value").alias("node")).distinct()).select(F.col("node").alias("value"), "ok")
        return values.join(inner, "value").groupBy("node").agg(F.bool_and("ok").alias("x"))


def validate(quads: DataFrame, profile: str = "source", shapes: Sequence[Shape] = SHAPES) -> DataFrame:
    """(focus, shape, message) of violations, in order of shape, focus and message; none if the graph conforms."""
    if profile not in ("source", "reviewed"):
        raise ValueError("profile is source or reviewed")
    validator, found = Validator(quads), None
    for shape in shapes:
        if shape.profile not in (None, profile):
            continue
        nodes = validator.targets(shape)
        bad = validator.holds(And(shape.constraints), nodes).where(~F.col("ok"))
        part = bad.select(lexical(F.col("node")).alias("focus"), F.lit(shape.name).alias("shape"), F.lit(shape.message).alias("message"))
        found = part if found is None else found.unionByName(part)
    return found.orderBy("shape", "focus", "message")


__all__ = ["SHAPES", "Shape", "Validator", "XSD", "validate"]
