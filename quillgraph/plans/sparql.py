"""SPARQL SELECT over a set of statements, compiled to DataFrames.

A term is one string while a query runs: ``<iri>``, ``_:id``, or a literal ``"lexical"`` with ``@lang`` or ``^^<datatype>``; joins on
variables are plain equality joins on strings. Bound terms and bindings are filters on the stored columns of each scan, so they reach
Parquet. Patterns of a group are joined in an order that starts at the most bound and stays connected. Variables that may be
unbound (after OPTIONAL or UNION) join by compatibility.

Supported: PREFIX, BASE, SELECT with expressions, DISTINCT, REDUCED, blank-node property lists, FILTER, OPTIONAL, UNION, MINUS, BIND,
VALUES, EXISTS, sub-SELECT, GROUP BY, HAVING, aggregates, ORDER BY, LIMIT, OFFSET, GRAPH, property paths (/ | ^ + * ?). Other query
forms and SERVICE are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_iri
from ..sources.scratch import keep
from ..sources.turtle import RDF, XSD, _unescaped

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\r\n]*)
  | (?P<string>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
  | (?P<iri><[^\x00-\x20<>"{}|^`\\]*>)
  | (?P<var>[?$]\w+)
  | (?P<bnode>_:[\w][\w.\-]*(?<!\.))
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<name>(?:[A-Za-zÀ-￿][\w.\-]*)?:(?:[\w:%](?:[\w.\-:%]|\\.)*(?<!\.))?)
  | (?P<word>[A-Za-z_]\w*)
  | (?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/|^+?=<>!\-])""",
    re.X | re.S,
)
_AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT")


class SparqlError(ValueError):
    """A query that can't be parsed or isn't supported."""


@dataclass
class Select:
    variables: list[tuple[str, object]] = field(default_factory=list)  # name and expression or None
    every: bool = False
    distinct: bool = False
    where: list = field(default_factory=list)
    group: list[tuple[object, str]] = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    """Query text to a Select. Patterns: ('triple', s, p, o), ('filter', e), ('optional', g), ('union', gs), ('minus', g), ('bind', e, v), ('values', vs, rows), ('select', q), ('graph', t, g), ('group', g)."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            match = _TOKEN.match(text, at)
            if not match:
                raise SparqlError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if match.lastgroup != "space":
                self.tokens.append((match.lastgroup, match[0]))
            at = match.end()
        self.at, self.prefixes, self.base, self.fresh = 0, {}, "", 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def take(self, text: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if text is not None and token[1].upper() != text.upper():
            raise SparqlError(f"expected {text!r}, found {token[1]!r}")
        self.at += 1
        return token

    def accept(self, text: str) -> bool:
        if self.peek()[1].upper() == text.upper() and self.peek()[0] in ("mark", "word"):
            self.at += 1
            return True
        return False

    def new(self) -> str:
        self.fresh += 1
        return f"?__{self.fresh}"

    def query(self) -> Select:
        while self.word("PREFIX", "BASE"):
            if self.take()[1].upper() == "PREFIX":
                kind, name = self.take()
                if kind != "name" or not name.endswith(":") or self.peek()[0] != "iri":
                    raise SparqlError(f"not a prefix: {name!r}")
                self.prefixes[name[:-1]] = self.take()[1][1:-1]
            else:
                self.base = self.take()[1][1:-1]
        if not self.word("SELECT"):
            raise SparqlError("only SELECT queries are supported")
        query = self.select()
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r} after the query")
        return query

    def select(self) -> Select:
        self.take("SELECT")
        q = Select()
        q.distinct = self.accept("DISTINCT")
        self.accept("REDUCED")
        while True:
            kind, text = self.peek()
            if kind == "var":
                self.take()
                q.variables.append((text[1:], None))
            elif text == "(":
                self.take()
                value = self.expression()
                self.take("AS")
                q.variables.append((self.take()[1][1:], value))
                self.take(")")
            elif text == "*" and not q.variables:
                self.take()
                q.every = True
                break
            else:
                break
        if not q.variables and not q.every:
            raise SparqlError("nothing is selected")
        self.accept("WHERE")
        q.where = self.group()
        if self.accept("GROUP"):
            self.take("BY")
            while self.peek()[0] == "var" or self.peek()[1] == "(" or self.peek()[0] == "word" and not self.word("HAVING", "ORDER", "LIMIT", "OFFSET"):
                if self.peek()[0] == "var":
                    name = self.take()[1]
                    q.group.append((("var", name[1:]), name[1:]))
                elif self.accept("("):
                    value = self.expression()
                    name = self.take()[1][1:] if self.accept("AS") else self.new()[1:]
                    self.take(")")
                    q.group.append((value, name))
                else:
                    q.group.append((self.primary(), self.new()[1:]))
        if self.accept("HAVING"):
            while self.peek()[1] == "(" or self.peek()[0] == "word" and not self.word("ORDER", "LIMIT", "OFFSET"):
                q.having.append(self.primary())
        if self.accept("ORDER"):
            self.take("BY")
            while self.peek()[0] in ("var",) or self.peek()[1] == "(" or self.peek()[0] == "word" and not self.word("LIMIT", "OFFSET"):
                down = self.word("DESC")
                if self.word("ASC", "DESC"):
                    self.take()
                q.order.append((self.primary(), not down))
        while self.word("LIMIT", "OFFSET"):
            what = self.take()[1].upper()
            number = int(self.take()[1])
            if what == "LIMIT":
                q.limit = number
            else:
                q.offset = number
        return q

    def group(self) -> list:
        self.take("{")
        out: list = []
        if self.word("SELECT"):
            out.append(("select", self.select()))
            self.take("}")
            return out
        while not self.accept("}"):
            if self.peek()[0] == "end":
                raise SparqlError("a group isn't closed")
            if self.accept("."):
                continue
            if self.accept("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.accept("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.accept("MINUS"):
                out.append(("minus", self.group()))
            elif self.accept("BIND"):
                self.take("(")
                value = self.expression()
                self.take("AS")
                out.append(("bind", value, self.take()[1][1:]))
                self.take(")")
            elif self.accept("VALUES"):
                out.append(self.values())
            elif self.accept("GRAPH"):
                name = self.term()
                out.append(("graph", name, self.group()))
            elif self.word("SERVICE"):
                raise SparqlError("SERVICE isn't supported")
            elif self.peek()[1] == "{":
                groups = [self.group()]
                while self.accept("UNION"):
                    groups.append(self.group())
                out.append(("union", groups) if len(groups) > 1 else ("group", groups[0]))
            else:
                self.triples(out)
        return out

    def constraint(self) -> object:
        return self.primary()

    def values(self) -> tuple:
        single = self.peek()[0] == "var"
        names = [self.take()[1][1:]] if single else []
        if not single:
            self.take("(")
            while not self.accept(")"):
                names.append(self.take()[1][1:])
        self.take("{")
        rows = []
        while not self.accept("}"):
            if single:
                rows.append([None if self.accept("UNDEF") else self.term()])
            else:
                self.take("(")
                row = []
                while not self.accept(")"):
                    row.append(None if self.accept("UNDEF") else self.term())
                rows.append(row)
        return ("values", names, rows)

    def triples(self, out: list) -> None:
        subject = self.node(out)
        if subject.startswith("?__") and self.peek()[1] in (".", "}"):
            return
        self.properties(subject, out)

    def properties(self, subject: str, out: list) -> None:
        while True:
            verb = self.path()
            while True:
                out.append(("triple", subject, verb, self.node(out)))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek()[1] in (".", "}", "]"):
                return

    def node(self, out: list) -> str:
        if self.accept("["):
            name = self.new()
            if not self.accept("]"):
                self.properties(name, out)
                self.take("]")
            return name
        if self.accept("("):
            items = []
            while not self.accept(")"):
                items.append(self.node(out))
            names = [self.new() for _ in items]
            for k, item in enumerate(items):
                out.append(("triple", names[k], ("iri", f"<{RDF}first>"), item))
                out.append(("triple", names[k], ("iri", f"<{RDF}rest>"), names[k + 1] if k + 1 < len(names) else f"<{RDF}nil>"))
            return names[0] if names else f"<{RDF}nil>"
        if self.peek()[0] == "bnode":
            return "?__b" + re.sub(r"\W", "_", self.take()[1][2:])
        return self.term()

    def term(self) -> str:
        kind, text = self.take()
        if kind == "var":
            return text
        if kind == "iri":
            value = text[1:-1]
            return f"<{self.base + value if self.base and not re.match(r'[A-Za-z][A-Za-z0-9+.-]*:', value) else value}>"
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"prefix {prefix!r} is not declared")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        if kind == "string":
            value = '"' + _unescaped(text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]) + '"'
            if self.peek()[0] == "lang":
                return value + self.take()[1].lower()
            if self.accept("^^"):
                datatype = self.term()
                return value if datatype == f"<{XSD}string>" else f"{value}^^{datatype}"
            return value
        if kind == "number" or text in "+-" and self.peek()[0] == "number":
            number = text if kind == "number" else text + self.take()[1]
            datatype = "double" if re.search("[eE]", number) else "decimal" if "." in number else "integer"
            return f'"{number}"^^<{XSD}{datatype}>'
        if kind == "word" and text.lower() in ("true", "false"):
            return f'"{text.lower()}"^^<{XSD}boolean>'
        raise SparqlError(f"not a term: {text!r}")

    # -- paths ----------------------------------------------------------------------------------------------------------------

    def path(self) -> tuple:
        parts = [self.sequence()]
        while self.accept("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self) -> tuple:
        parts = [self.step()]
        while self.accept("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("then", parts)

    def step(self) -> tuple:
        if self.accept("^"):
            return ("back", self.step())
        if self.accept("("):
            inner = self.path()
            self.take(")")
        elif self.peek() == ("word", "a"):
            self.take()
            inner = ("iri", f"<{RDF}type>")
        elif self.peek()[0] == "var":
            inner = ("var", self.take()[1])
        else:
            term = self.term()
            if not term.startswith("<"):
                raise SparqlError(f"not a predicate: {term}")
            inner = ("iri", term)
        while self.peek()[1] in ("+", "*", "?") and inner[0] != "var":
            inner = ({"+": "plus", "*": "star", "?": "maybe"}[self.take()[1]], inner)
        return inner

    # -- expressions ----------------------------------------------------------------------------------------------------------

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.accept("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.relation()
        while self.accept("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.sum()
        text = self.peek()[1]
        if text in ("=", "!=", "<", ">", "<=", ">="):
            self.take()
            return ("compare", text, left, self.sum())
        negated = self.word("NOT") and self.peek(1)[1].upper() == "IN"
        if negated:
            self.take()
        if self.accept("IN"):
            self.take("(")
            items = []
            while not self.accept(")"):
                items.append(self.expression())
                self.accept(",")
            return ("not", ("in", left, items)) if negated else ("in", left, items)
        return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek()[1] in ("+", "-"):
            left = ("math", self.take()[1], left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while self.peek()[1] in ("*", "/"):
            left = ("math", self.take()[1], left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.accept("!"):
            return ("not", self.unary())
        if self.accept("-"):
            return ("math", "-", ("term", f'"0"^^<{XSD}integer>'), self.unary())
        return self.primary()

    def primary(self) -> tuple:
        kind, text = self.peek()
        if self.accept("("):
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "var":
            return ("var", self.take()[1][1:])
        name = text.upper()
        if kind == "word" and name in ("NOT", "EXISTS"):
            negated = self.accept("NOT")
            self.take("EXISTS")
            inner = ("exists", self.group())
            return ("not", inner) if negated else inner
        if kind == "word" and name in _AGGREGATES:
            self.take()
            self.take("(")
            distinct = self.accept("DISTINCT")
            what = None if self.accept("*") else self.expression()
            separator = " "
            if self.accept(";"):
                self.take("SEPARATOR")
                self.take("=")
                separator = _unescaped(self.take()[1][1:-1])
            self.take(")")
            return ("aggregate", name, distinct, what, separator)
        if kind == "word" and text.lower() not in ("true", "false"):
            self.take()
            self.take("(")
            arguments = []
            while not self.accept(")"):
                arguments.append(self.expression())
                self.accept(",")
            return ("call", name, arguments)
        term = self.term()
        if term.startswith("<") and self.peek()[1] == "(":
            raise SparqlError(f"function {term} isn't supported")
        return ("term", term)


# -- terms as columns -----------------------------------------------------------------------------------------------------------

_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'
_NUMERIC = ("integer", "decimal", "double", "float", "nonNegativeInteger", "positiveInteger", "int", "long", "short", "byte", "unsignedInt", "unsignedLong", "negativeInteger", "nonPositiveInteger")


def term_of(value: str, kind: str, datatype: str | None = None, lang: str | None = None) -> Column:
    """A term from stored columns."""
    v, k = F.col(value), F.col(kind)
    literal = F.concat(F.lit('"'), v, F.lit('"'))
    if datatype:
        plain = F.coalesce(F.col(datatype), F.lit("")).isin("", XSD + "string")
        literal = F.when(F.col(lang).isNotNull(), F.concat(literal, F.lit("@"), F.col(lang))).when(~plain, F.concat(literal, F.lit("^^<"), F.col(datatype), F.lit(">"))).otherwise(literal)
    return F.when(k == "iri", F.concat(F.lit("<"), v, F.lit(">"))).when(k == "bnode", F.concat(F.lit("_:"), v)).otherwise(literal)


def split_term(term: str) -> tuple[str, str, str | None, str | None]:
    """Value, kind, datatype, language of a constant term."""
    if term.startswith("<"):
        return term[1:-1], "iri", None, None
    if term.startswith("_:"):
        return term[2:], "bnode", None, None
    value, lang, datatype = re.match(_LITERAL, term).groups()
    return value, "literal", datatype, lang


def lexical(term: Column) -> Column:
    """The string of a term: an IRI's text, a literal's lexical form."""
    return F.when(term.startswith('"'), F.regexp_extract(term, _LITERAL, 1)).when(term.startswith("<"), F.substr(term, F.lit(2), F.length(term) - 2)).otherwise(term)


def number(term: Column) -> Column:
    """The value of a numeric literal, else null."""
    datatype = F.regexp_extract(term, _LITERAL, 3)
    return F.when(datatype.isin(*[XSD + n for n in _NUMERIC]), F.regexp_extract(term, _LITERAL, 1).try_cast("double"))


def truth(term: Column) -> Column:
    """The effective boolean value; null where there is none."""
    datatype, text = F.regexp_extract(term, _LITERAL, 3), F.regexp_extract(term, _LITERAL, 1)
    return F.when(~term.startswith('"'), F.lit(None)).when(datatype == XSD + "boolean", text.isin("true", "1")).when(number(term).isNotNull(), number(term) != 0).when(datatype == "", text != "")


def as_number(value: Column) -> Column:
    """A numeric literal from a double: an integer if it is whole."""
    whole = value == F.floor(value)
    return F.when(whole, F.concat(F.lit('"'), F.format_string("%.0f", value), F.lit(f'"^^<{XSD}integer>'))).otherwise(F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{XSD}decimal>')))


def as_boolean(value: Column) -> Column:
    return F.when(value, F.lit(f'"true"^^<{XSD}boolean>')).when(~value, F.lit(f'"false"^^<{XSD}boolean>'))


def as_text(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


@dataclass
class Solutions:
    """A DataFrame of terms by variable; ``sure`` are the variables that are bound in every row."""

    df: DataFrame
    sure: frozenset[str]

    @property
    def names(self) -> list[str]:
        return self.df.columns


class Compiler:
    def __init__(self, spark: SparkSession, quads: DataFrame, bindings: dict[str, str]):
        self.spark, self.quads, self.bindings = spark, quads, bindings
        self.graph: str | None = None

    # -- patterns ------------------------------------------------------------------------------------------------------------

    def statements(self) -> DataFrame:
        return self.quads

    def constant(self, term: str) -> str | None:
        """The term that a pattern's place is bound to, if any."""
        return term if not term.startswith("?") else self.bindings.get(term[1:])

    def scan(self, s: str, verb: tuple, o: str) -> Solutions:
        kind = verb[0]
        if kind in ("iri", "var"):
            p = verb[1]
            rows = self.statements()
            for place, term in (("s", s), ("p", p), ("o", o)):
                fixed = self.constant(term)
                if fixed is None:
                    continue
                value, k, datatype, lang = split_term(fixed)
                if place != "o" and k == "literal":
                    return self.empty([t[1:] for t in (s, p, o) if t.startswith("?")])
                rows = rows.where(F.col(place) == value)
                if place != "p":
                    rows = rows.where(F.col(f"{place}_kind") == k)
                if place == "o" and k == "literal":
                    typed = F.coalesce(F.col("o_dt"), F.lit(XSD + "string"))
                    rows = rows.where((typed == (datatype or XSD + "string")) if lang is None else (F.lower("o_lang") == lang))
                    rows = rows.where(F.col("o_lang").isNull()) if lang is None else rows
            columns = {"s": term_of("s", "s_kind"), "p": F.concat(F.lit("<"), F.col("p"), F.lit(">")), "o": term_of("o", "o_kind", "o_dt", "o_lang")}
            named: dict[str, Column] = {}
            if self.graph and self.graph.startswith("?"):
                named[self.graph[1:]] = F.concat(F.lit("<"), F.col("graph"), F.lit(">"))
            same = []
            for place, term in (("s", s), ("p", p), ("o", o)):
                if term.startswith("?"):
                    if term[1:] in named:
                        same.append(named[term[1:]] == columns[place])
                    else:
                        named[term[1:]] = columns[place]
            for condition in same:
                rows = rows.where(condition)
            if not named:  # a statement without variables: there or not
                return Solutions(rows.limit(1).select(F.lit(1).alias("__unit")), frozenset())
            return Solutions(rows.select(*[c.alias(n) for n, c in named.items()]).distinct(), frozenset(named))
        return self.path(s, verb, o)

    def path(self, s: str, verb: tuple, o: str) -> Solutions:
        """A property path as pairs (start, end), then bound to its ends."""
        pairs = self.pairs(verb)
        for place, term in (("a", s), ("b", o)):
            fixed = self.constant(term)
            if fixed is not None:
                pairs = pairs.where(F.col(place) == fixed)
        if s.startswith("?") and s == o:
            return Solutions(pairs.where("a = b").select(F.col("a").alias(s[1:])), frozenset([s[1:]]))
        named = [F.col(place).alias(term[1:]) for place, term in (("a", s), ("b", o)) if term.startswith("?")]
        if not named:
            return Solutions(pairs.limit(1).select(F.lit(1).alias("__unit")), frozenset())
        return Solutions(pairs.select(*named), frozenset(t[1:] for t in (s, o) if t.startswith("?")))

    def pairs(self, verb: tuple) -> DataFrame:
        kind = verb[0]
        if kind == "iri":
            return self.scan("?a", verb, "?b").df.select("a", "b")
        if kind == "back":
            return self.pairs(verb[1]).select(F.col("b").alias("a"), F.col("a").alias("b"))
        if kind == "or":
            parts = [self.pairs(v) for v in verb[1]]
            out = parts[0]
            for x in parts[1:]:
                out = out.unionByName(x)
            return out
        if kind == "then":
            out = self.pairs(verb[1][0])
            for v in verb[1][1:]:
                out = out.withColumnRenamed("b", "m").join(self.pairs(v).withColumnRenamed("a", "m"), "m").select("a", "b")
            return out
        if kind in ("plus", "star", "maybe"):
            one = keep(self.pairs(verb[1]).distinct(), "path")
            if kind == "maybe":
                return one.unionByName(self.nodes()).distinct()
            reached, new = one, one
            while True:  # newly reached pairs only are followed further
                more = new.withColumnRenamed("b", "m").join(one.withColumnRenamed("a", "m"), "m").select("a", "b").distinct()
                new = keep(more.join(reached, ["a", "b"], "left_anti"), "path")
                if new.isEmpty():
                    break
                reached = keep(reached.unionByName(new), "path")
            return reached if kind == "plus" else reached.unionByName(self.nodes()).distinct()
        raise SparqlError(f"path {kind} isn't supported")

    def nodes(self) -> DataFrame:
        every = self.statements().select(F.explode(F.array(term_of("s", "s_kind"), term_of("o", "o_kind", "o_dt", "o_lang"))).alias("a")).distinct()
        return every.select("a", F.col("a").alias("b"))

    def empty(self, names: list[str]) -> Solutions:
        names = list(dict.fromkeys(names)) or ["__unit"]
        return Solutions(self.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)), frozenset(names))

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(F.lit(1).alias("__unit")), frozenset())

    # -- joins ----------------------------------------------------------------------------------------------------------------

    def join(self, a: Solutions, b: Solutions, how: str = "inner", condition: object = None) -> Solutions:
        if how == "inner" and a.names == ["__unit"] and a.df is not None and not b.names == ["__unit"]:
            a, b = b, a
        left = a.df.select(*[F.col(c) for c in a.names])
        right = b.df.select(*[F.col(c).alias(f"__r_{c}") for c in b.names])
        shared = [c for c in a.names if c in b.names and c != "__unit"]
        on = []
        for c in shared:
            x, y = F.col(c), F.col(f"__r_{c}")
            on.append(x == y if c in a.sure and c in b.sure else x.isNull() | y.isNull() | (x == y))
        if condition is not None:
            seen = {c: F.coalesce(F.col(c), F.col(f"__r_{c}")) if c in shared else F.col(c) for c in a.names} | {c: F.col(f"__r_{c}") for c in b.names if c not in a.names}
            on.append(F.coalesce(self.boolean(condition, seen), F.lit(False)))
        joined = left.join(right, on, how) if on else left.join(right, F.lit(True), how)
        if how in ("left_semi", "left_anti"):
            return Solutions(joined, a.sure)
        out = []
        for c in a.names:
            both = c in shared and not (c in a.sure)
            out.append(F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) if both else F.col(c))
        out += [F.col(f"__r_{c}").alias(c) for c in b.names if c not in a.names]
        sure = a.sure | b.sure if how == "inner" else a.sure
        return Solutions(joined.select(*out), frozenset(sure))

    def basic(self, triples: list[tuple]) -> Solutions | None:
        """Triple patterns, joined from the most bound on, each next one connected if any is."""
        left = list(triples)
        out: Solutions | None = None
        weight = lambda t: sum(w for place, w in ((t[1], 4), (t[2][1] if t[2][0] in ("iri", "var") else "<>", 1), (t[3], 3)) if self.constant(place) is not None)
        is_type = lambda t: t[2] == ("iri", f"<{RDF}type>")
        names: set[str] = set()
        while left:
            free = [t for t in left if not names or names & self.variables(t)] or left
            best = max(free, key=lambda t: (weight(t), not is_type(t)))
            left.remove(best)
            found = self.scan(best[1], best[2], best[3])
            out = found if out is None else self.join(out, found)
            names |= self.variables(best)
        return out

    @staticmethod
    def variables(t: tuple) -> set[str]:
        places = [t[1], t[3], *([t[2][1]] if t[2][0] == "var" else [])]
        return {x[1:] for x in places if x.startswith("?")}

    def group(self, elements: list) -> Solutions:
        out: Solutions | None = None
        filters = [e[1] for e in elements if e[0] == "filter"]
        pending: list[tuple] = []

        def flush() -> None:
            nonlocal out, pending
            if pending:
                found = self.basic(pending)
                out = found if out is None else self.join(out, found)
                pending = []

        for e in elements:
            if e[0] == "triple":
                pending.append(e)
                continue
            if e[0] == "filter":
                continue
            flush()
            if e[0] == "optional":
                inner = [x for x in e[1] if x[0] != "filter"]
                conditions = [x[1] for x in e[1] if x[0] == "filter"]
                condition = None
                for c in conditions:
                    condition = c if condition is None else ("and", condition, c)
                out = self.join(out or self.unit(), self.group(inner), "left", condition)
            elif e[0] == "union":
                out = self.with_(out, self.union([self.group(g) for g in e[1]]))
            elif e[0] == "group":
                out = self.with_(out, self.group(e[1]))
            elif e[0] == "minus":
                other = self.group(e[1])
                if out is not None and set(out.names) & set(other.names) - {"__unit"}:
                    out = self.join(out, other, "left_anti")
            elif e[0] == "bind":
                base = out or self.unit()
                row = {c: F.col(c) for c in base.names}
                out = Solutions(base.df.withColumn(e[2], self.term(e[1], row)), base.sure)
            elif e[0] == "values":
                rows = [[None if x is None else x for x in row] for row in e[2]]
                frame = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in e[1]))
                out = self.with_(out, Solutions(frame, frozenset(n for k, n in enumerate(e[1]) if all(r[k] is not None for r in rows))))
            elif e[0] == "select":
                out = self.with_(out, self.select(e[1]))
            elif e[0] == "graph":
                outer, before = self.graph, self.quads
                self.graph = e[1]
                fixed = self.constant(e[1])
                if fixed is not None:
                    self.quads = self.quads.where(F.col("graph") == split_term(fixed)[0])
                out = self.with_(out, self.group(e[2]))
                self.graph, self.quads = outer, before
        flush()
        out = out or self.unit()
        for f in filters:
            out = self.filtered(out, f)
        return out

    def with_(self, out: Solutions | None, found: Solutions) -> Solutions:
        return found if out is None else self.join(out, found)

    @staticmethod
    def union(parts: list[Solutions]) -> Solutions:
        df, sure = parts[0].df, parts[0].sure
        for part in parts[1:]:
            df, sure = df.unionByName(part.df, allowMissingColumns=True), sure & part.sure
        return Solutions(df.drop("__unit") if len(df.columns) > 1 else df, frozenset(sure))

    def filtered(self, out: Solutions, f: tuple) -> Solutions:
        if f[0] == "and":
            return self.filtered(self.filtered(out, f[1]), f[2])
        negated, inner = (True, f[1]) if f[0] == "not" else (False, f)
        if inner[0] == "exists":
            return self.join(out, self.group(inner[1]), "left_anti" if negated else "left_semi")
        df = out.df.where(F.coalesce(self.boolean(f, {c: F.col(c) for c in out.names}), F.lit(False)))
        return Solutions(df, out.sure)

    # -- expressions ----------------------------------------------------------------------------------------------------------

    def boolean(self, e: tuple, row: dict[str, Column]) -> Column:
        kind = e[0]
        if kind == "and":
            return self.boolean(e[1], row) & self.boolean(e[2], row)
        if kind == "or":
            return self.boolean(e[1], row) | self.boolean(e[2], row)
        if kind == "not":
            return ~self.boolean(e[1], row)
        if kind == "compare":
            a, b = self.term(e[2], row), self.term(e[3], row)
            x, y = number(a), number(b)
            if e[1] in ("=", "!="):
                # Numbers compare by value, other terms by identity.
                equal = (a == b) | F.coalesce(x == y, F.lit(False))
                return equal if e[1] == "=" else ~equal
            by_value = {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e[1]]
            p, q = lexical(a), lexical(b)
            by_text = {"<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[e[1]]
            both = a.startswith('"') & b.startswith('"')
            return F.when(x.isNotNull() & y.isNotNull(), by_value).when(both & x.isNull() & y.isNull(), by_text)
        if kind == "in":
            out = F.lit(False)
            for item in e[2]:
                out = out | self.boolean(("compare", "=", e[1], item), row)
            return out
        if kind == "call":
            name, args = e[1], e[2]
            text = lambda k: lexical(self.term(args[k], row))
            if name == "BOUND":
                return row[args[0][1]].isNotNull() if args[0][1] in row else F.lit(False)
            if name == "REGEX":
                flags = args[2][1].strip('"') if len(args) > 2 else ""
                pattern = args[1][1]
                if not pattern.startswith('"'):
                    raise SparqlError("REGEX needs a constant pattern")
                return text(0).rlike(f"(?U{flags.replace('i', 'iu')})" + split_term(pattern)[0])
            if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
                return {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](text(0), text(1))
            if name in ("ISIRI", "ISURI"):
                return self.term(args[0], row).startswith("<")
            if name == "ISBLANK":
                return self.term(args[0], row).startswith("_:")
            if name == "ISLITERAL":
                return self.term(args[0], row).startswith('"')
            if name == "ISNUMERIC":
                return number(self.term(args[0], row)).isNotNull()
            if name == "SAMETERM":
                return self.term(args[0], row) == self.term(args[1], row)
            if name == "LANGMATCHES":
                wanted = F.lower(text(1))
                have = F.lower(text(0))
                return F.when(wanted == "*", have != "").otherwise((have == wanted) | have.startswith(F.concat(wanted, F.lit("-"))))
        if kind == "exists":
            raise SparqlError("EXISTS is supported as a whole filter or a part of a conjunction")
        return truth(self.term(e, row))

    def term(self, e: tuple, row: dict[str, Column]) -> Column:
        kind = e[0]
        if kind == "column":
            return e[1]
        if kind == "var":
            return row.get(e[1], F.lit(None).cast("string"))
        if kind == "term":
            return F.lit(e[1])
        if kind == "math":
            x, y = number(self.term(e[2], row)), number(self.term(e[3], row))
            return as_number({"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[e[1]])
        if kind in ("and", "or", "not", "compare", "in"):
            return as_boolean(self.boolean(e, row))
        if kind == "call":
            return self.call(e[1], e[2], row)
        raise SparqlError(f"{kind} isn't supported here")

    def call(self, name: str, args: list, row: dict[str, Column]) -> Column:
        t = lambda k: self.term(args[k], row)
        text = lambda k: lexical(t(k))
        if name == "STR":
            return as_text(text(0))
        if name == "LANG":
            return F.when(t(0).startswith('"'), as_text(F.regexp_extract(t(0), _LITERAL, 2)))
        if name == "DATATYPE":
            found = F.regexp_extract(t(0), _LITERAL, 3)
            tagged = F.regexp_extract(t(0), _LITERAL, 2) != ""
            return F.when(t(0).startswith('"'), F.concat(F.lit("<"), F.when(tagged, F.lit(RDF + "langString")).when(found == "", F.lit(XSD + "string")).otherwise(found), F.lit(">")))
        if name in ("IRI", "URI"):
            return F.concat(F.lit("<"), text(0), F.lit(">"))
        if name == "COALESCE":
            return F.coalesce(*[self.term(a, row) for a in args])
        if name == "IF":
            return F.when(self.boolean(args[0], row), t(1)).otherwise(t(2))
        if name == "CONCAT":
            return as_text(F.concat(*[text(k) for k in range(len(args))]))
        if name in ("UCASE", "LCASE"):
            return as_text((F.upper if name == "UCASE" else F.lower)(text(0)))
        if name == "STRLEN":
            return as_number(F.length(text(0)).cast("double"))
        if name == "SUBSTR":
            start = number(t(1)).cast("int")
            return as_text(F.substr(text(0), start, number(t(2)).cast("int")) if len(args) > 2 else F.substr(text(0), start))
        if name == "REPLACE":
            return as_text(F.regexp_replace(text(0), text(1), text(2)))
        if name == "STRBEFORE":
            return as_text(F.when(F.contains(text(0), text(1)), F.split_part(text(0), text(1), F.lit(1))).otherwise(""))
        if name == "STRAFTER":
            at = F.position(text(1), text(0))
            return as_text(F.when(at > 0, F.substr(text(0), at + F.length(text(1)))).otherwise(""))
        if name == "ENCODE_FOR_URI":
            from ..functions.text import quoted_iri

            return as_text(quoted_iri(text(0)))
        if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
            return as_number({"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda x: F.floor(x + 0.5)}[name](number(t(0))).cast("double"))
        if name in ("YEAR", "MONTH", "DAY"):
            part = {"YEAR": 1, "MONTH": 2, "DAY": 3}[name]
            return as_number(F.regexp_extract(text(0), r"^(\d{4})-(\d{2})-(\d{2})", part).try_cast("double"))
        if name in ("MD5", "SHA1", "SHA256"):
            return as_text({"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda x: F.sha2(x, 256)}[name](text(0)))
        if name in ("BOUND", "REGEX", "CONTAINS", "STRSTARTS", "STRENDS", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC", "SAMETERM", "LANGMATCHES"):
            return as_boolean(self.boolean(("call", name, args), row))
        raise SparqlError(f"function {name} isn't supported")

    # -- select ---------------------------------------------------------------------------------------------------------------

    def aggregate(self, e: tuple, row: dict[str, Column]) -> Column:
        _, name, distinct, what, separator = e
        if what is None:
            return as_number((F.count_distinct(F.struct(*row.values())) if distinct else F.count(F.lit(1))).cast("double"))
        value = self.term(what, row)
        if name == "COUNT":
            return as_number((F.count_distinct(value) if distinct else F.count(value)).cast("double"))
        if name in ("SUM", "AVG"):
            x = number(value)
            whole = {"SUM": F.sum_distinct if distinct else F.sum, "AVG": F.avg}[name](x)
            return as_number(F.coalesce(whole, F.lit(0.0)))
        if name in ("MIN", "MAX"):
            key = F.struct(number(value).alias("n"), lexical(value).alias("t"))
            return (F.min_by if name == "MIN" else F.max_by)(value, F.when(value.isNotNull(), key))
        if name == "SAMPLE":
            return F.min(value)
        texts = F.collect_set(lexical(value)) if distinct else F.collect_list(lexical(value))
        return as_text(F.array_join(F.array_sort(texts), separator))

    def lifted(self, e: object, found: dict[str, tuple]) -> object:
        """The expression with its aggregates replaced by names."""
        if isinstance(e, tuple):
            if e and e[0] == "aggregate":
                name = next((n for n, x in found.items() if x == e), None) or f"__agg{len(found)}"
                found[name] = e
                return ("var", name)
            return tuple(self.lifted(x, found) for x in e)
        return [self.lifted(x, found) for x in e] if isinstance(e, list) else e

    def select(self, q: Select, outermost: bool = False) -> Solutions:
        out = self.group(q.where)
        row = {c: F.col(c) for c in out.names}
        aggregates: dict[str, tuple] = {}
        variables = [(n, None if e is None else self.lifted(e, aggregates)) for n, e in q.variables]
        having = [self.lifted(e, aggregates) for e in q.having]
        order = [(self.lifted(e, aggregates), up) for e, up in q.order]
        if q.group or aggregates:
            if q.every:
                raise SparqlError("SELECT * can't be grouped")
            keys = [self.term(e, row).alias(n) for e, n in q.group]
            computed = [self.aggregate(e, row).alias(n) for n, e in aggregates.items()] or [F.count(F.lit(1)).alias("__n")]
            grouped = out.df.groupBy(*keys).agg(*computed)
            known = {n for _, n in q.group}
            for n, e in variables:
                if e is None and n not in known:
                    raise SparqlError(f"?{n} is neither grouped nor aggregated")
            out = Solutions(grouped, frozenset(known | set(aggregates)) & (out.sure | frozenset(aggregates)))
            row = {c: F.col(c) for c in out.names}
            for e in having:
                out = Solutions(out.df.where(F.coalesce(self.boolean(e, row), F.lit(False))), out.sure)
        df, sure = out.df, set(out.sure)
        for n, e in variables:
            if e is not None:
                df = df.withColumn(n, self.term(e, {c: F.col(c) for c in df.columns}))
        names = [n for n, _ in variables] if not q.every else [c for c in df.columns if not c.startswith("__")]
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        if q.distinct:
            df = df.select(*names).distinct()
        if order:
            known = {c: F.col(c) for c in df.columns}
            keys = []
            for e, up in order:
                value = self.term(e, known)
                rank = F.when(value.isNull(), 0).when(value.startswith("_:"), 1).when(value.startswith("<"), 2).otherwise(3)
                keys += [(k.asc_nulls_first() if up else k.desc_nulls_last()) for k in (rank, number(value), lexical(value))]
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df.select(*names), frozenset(n for n in names if n in sure))


def query(spark: SparkSession, quads: DataFrame, text: str, bindings: dict[str, str] | None = None) -> DataFrame:
    """Run a SELECT; columns are in the order of SELECT, values are strings (an IRI's text, a literal's lexical form), null if unbound.

    ``quads`` has the columns of a store (graph optional for queries without GRAPH). ``bindings`` fix selected variables: an absolute IRI
    means that IRI, any other text an untyped literal.
    """
    parsed = Parser(text).query()
    fixed = {}
    for name, value in (bindings or {}).items():
        name = name.lstrip("?$")
        if not parsed.every and name not in [n for n, _ in parsed.variables]:
            raise SparqlError(f"?{name} is bound but not selected")
        fixed[name] = f"<{value}>" if is_iri(value) else f'"{value}"'
    compiler = Compiler(spark, quads, fixed)
    out = compiler.select(parsed, outermost=True).df
    for name, term in fixed.items():
        if name in out.columns:
            out = out.where(F.col(name) == term)
    return out.select(*[lexical(F.col(c)).alias(c) for c in out.columns])
