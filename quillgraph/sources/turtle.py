"""Turtle: a reader of one document's statements and a writer with the same bytes for the same graph."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import urljoin

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
#: A statement: subject, its kind (iri or bnode), predicate, object, its kind (iri, bnode or literal), datatype, language.
Statement = tuple[str, str, str, str, str, str | None, str | None]

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\r\n]*)
  | (?P<long>\"\"\"(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
  | (?P<string>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
  | (?P<iri><[^\x00-\x20<>"{}|^`\\]*(?:\\u[0-9A-Fa-f]{4}[^\x00-\x20<>"{}|^`\\]*)*>)
  | (?P<bnode>_:[\w][\w.\-]*(?<!\.))
  | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
  | (?P<name>(?:[A-Za-z\u00c0-\uffff][\w.\-]*)?:(?:[\w:%](?:[\w.\-:%]|\\.)*(?<!\.)|(?:\\.)+)?)
  | (?P<word>[A-Za-z]+)
  | (?P<mark>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_SHORT = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


class TurtleError(ValueError):
    """Text that is not Turtle."""


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _SHORT.get(m[1], m[1]), text) if "\\" in text else text


class Reader:
    """Parses one document; blank nodes get ``prefix``, so that those of two documents never meet."""

    def __init__(self, text: str, prefix: str = "", base: str = ""):
        self._tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            match = _TOKEN.match(text, at)
            if not match:
                raise TurtleError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            if match.lastgroup != "space":
                self._tokens.append((match.lastgroup, match[0]))
            at = match.end()
        self._at, self._prefix, self._base, self._count = 0, prefix, base, 0
        self.prefixes: dict[str, str] = {}
        self.statements: list[Statement] = []

    def _peek(self) -> tuple[str, str]:
        return self._tokens[self._at] if self._at < len(self._tokens) else ("end", "")

    def _next(self, wanted: str | None = None) -> tuple[str, str]:
        token = self._peek()
        if wanted is not None and token[1] != wanted:
            raise TurtleError(f"expected {wanted!r}, found {token[1]!r}")
        self._at += 1
        return token

    def read(self) -> list[Statement]:
        while self._peek()[0] != "end":
            kind, text = self._peek()
            if kind == "at" and text in ("@prefix", "@base") or kind == "word" and text.lower() in ("prefix", "base"):
                self._directive()
            else:
                if text == "[":
                    subject = self._blank_list()
                    if self._peek()[1] != ".":
                        self._properties(subject)
                else:
                    self._properties(self._subject())
                self._next(".")
        return self.statements

    def _directive(self) -> None:
        text = self._next()[1]
        if text.lower().endswith("prefix"):
            kind, name = self._next()
            if kind != "name" or not name.endswith(":") or self._peek()[0] != "iri":
                raise TurtleError(f"not a prefix: {name!r}")
            self.prefixes[name[:-1]] = self._iri(self._next()[1])
        else:
            self._base = self._iri(self._next()[1])
        if text.startswith("@"):
            self._next(".")

    def _iri(self, text: str) -> str:
        value = _unescaped(text[1:-1])
        return urljoin(self._base, value) if self._base and not re.match(r"[A-Za-z][\w+.\-]*:", value) else value

    def _named(self, text: str) -> str:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            raise TurtleError(f"prefix {prefix!r} is not declared")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def _fresh(self) -> str:
        self._count += 1
        return f"{self._prefix}g{self._count}"

    def _subject(self) -> tuple[str, str]:
        kind, text = self._peek()
        if text == "(":
            return self._collection()
        self._at += 1
        if kind == "iri":
            return self._iri(text), "iri"
        if kind == "name":
            return self._named(text), "iri"
        if kind == "bnode":
            return f"{self._prefix}n{text[2:]}", "bnode"
        raise TurtleError(f"not a subject: {text!r}")

    def _blank_list(self) -> tuple[str, str]:
        self._next("[")
        node = (self._fresh(), "bnode")
        if self._peek()[1] != "]":
            self._properties(node)
        self._next("]")
        return node

    def _collection(self) -> tuple[str, str]:
        self._next("(")
        items = []
        while self._peek()[1] != ")":
            items.append(self._object())
        self._next(")")
        nodes = [(self._fresh(), "bnode") for _ in items]
        for k, (node, item) in enumerate(zip(nodes, items, strict=True)):
            self._add(node, RDF + "first", item)
            self._add(node, RDF + "rest", (*nodes[k + 1], None, None) if k + 1 < len(nodes) else (RDF + "nil", "iri", None, None))
        return nodes[0] if nodes else (RDF + "nil", "iri")

    def _properties(self, subject: tuple[str, str]) -> None:
        while True:
            kind, text = self._next()
            if kind == "word" and text == "a":
                predicate = RDF + "type"
            elif kind == "iri":
                predicate = self._iri(text)
            elif kind == "name":
                predicate = self._named(text)
            else:
                raise TurtleError(f"not a predicate: {text!r}")
            self._add(subject, predicate, self._object())
            while self._peek()[1] == ",":
                self._at += 1
                self._add(subject, predicate, self._object())
            if self._peek()[1] != ";":
                return
            while self._peek()[1] == ";":
                self._at += 1
            if self._peek()[1] in (".", "]"):
                return

    def _object(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self._peek()
        if text == "[":
            return (*self._blank_list(), None, None)
        if text == "(":
            return (*self._collection(), None, None)
        if kind in ("iri", "name", "bnode"):
            return (*self._subject(), None, None)
        self._at += 1
        if kind in ("string", "long"):
            value = _unescaped(text[3:-3] if kind == "long" else text[1:-1])
            after = self._peek()
            if after[0] == "at":
                self._at += 1
                return value, "literal", None, after[1][1:].lower()
            if after[1] == "^^":
                self._at += 1
                return value, "literal", self._subject()[0], None
            return value, "literal", None, None
        if kind == "number":
            datatype = "double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"
            return text, "literal", XSD + datatype, None
        if kind == "word" and text in ("true", "false"):
            return text, "literal", XSD + "boolean", None
        raise TurtleError(f"not an object: {text!r}")

    def _add(self, subject: tuple[str, str], predicate: str, value: tuple) -> None:
        self.statements.append((*subject, predicate, *value))


def parse(text: str, prefix: str = "", base: str = "") -> list[Statement]:
    return Reader(text, prefix, base).read()


# -- writing ----------------------------------------------------------------------------------------------------------------


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


class Writer:
    """Deterministic Turtle: subjects, predicates and objects in order; blank nodes used once are nested."""

    def __init__(self, statements: Iterable[Statement], prefixes: dict[str, str]):
        self._prefixes = dict(sorted(prefixes.items()))
        self._by: dict[tuple[str, str], dict[str, set[tuple]]] = {}
        uses: dict[str, int] = {}
        for s, sk, p, o, ok, dt, lang in set(statements):
            self._by.setdefault((s, sk), {}).setdefault(p, set()).add((o, ok, dt, lang))
            if ok == "bnode":
                uses[o] = uses.get(o, 0) + 1
        self._nested = {o for o, n in uses.items() if n == 1 and (o, "bnode") in self._by and not self._loops(o)}
        self._names: dict[str, str] = {}

    def _loops(self, node: str) -> bool:
        todo, seen = [node], set()
        while todo:
            for values in self._by.get((todo.pop(), "bnode"), {}).values():
                for o, kind, _, _ in values:
                    if o == node:
                        return True
                    if kind == "bnode" and o not in seen:
                        seen.add(o)
                        todo.append(o)
        return False

    def _iri(self, value: str) -> str:
        best = max(((ns, name) for name, ns in self._prefixes.items() if value.startswith(ns)), key=lambda x: len(x[0]), default=None)
        if best and re.fullmatch(r"[A-Za-z0-9_](?:[\w\-]*[\w\-])?", value[len(best[0]) :]):
            return f"{best[1]}:{value[len(best[0]) :]}"
        return f"<{value}>"

    def _key(self, node: tuple, depth: int = 0) -> tuple:
        """An order of objects that doesn't depend on names of blank nodes."""
        o, kind, dt, lang = node
        if kind != "bnode" or depth > 6:
            return (kind, o if kind != "bnode" else "", dt or "", lang or "")
        inside = sorted((p, sorted(self._key(v, depth + 1) for v in values)) for p, values in self._by.get((o, "bnode"), {}).items())
        return (kind, repr(inside), "", "")

    def _object(self, node: tuple, indent: int) -> str:
        o, kind, dt, lang = node
        if kind == "iri":
            return self._iri(o)
        if kind == "bnode":
            if o in self._nested:
                return "[ " + self._body((o, "bnode"), indent + 4) + " ]"
            return "_:" + self._names.setdefault(o, f"b{len(self._names) + 1}")
        return _quoted(o) + (f"@{lang}" if lang else f"^^{self._iri(dt)}" if dt and dt != XSD + "string" else "")

    def _body(self, subject: tuple[str, str], indent: int) -> str:
        lines = []
        for p in sorted(self._by[subject], key=lambda p: (p != RDF + "type", p)):
            name = "a" if p == RDF + "type" else self._iri(p)
            lines.append(f"{name} " + ", ".join(self._object(v, indent) for v in sorted(self._by[subject][p], key=self._key)))
        return f" ;\n{' ' * indent}".join(lines)

    def text(self) -> str:
        out = [f"@prefix {name}: <{ns}> ." for name, ns in self._prefixes.items()]
        blank = lambda s: (s[1] == "bnode", s[0] if s[1] == "iri" else repr(self._key((*s, None, None))))
        for subject in sorted(self._by, key=blank):
            if subject[1] == "bnode" and subject[0] in self._nested:
                continue
            name = self._iri(subject[0]) if subject[1] == "iri" else "_:" + self._names.setdefault(subject[0], f"b{len(self._names) + 1}")
            out.append(f"\n{name} {self._body(subject, 4)} .")
        return "\n".join(out) + "\n"


def write(statements: Iterable[Statement], prefixes: dict[str, str]) -> str:
    return Writer(statements, prefixes).text()
