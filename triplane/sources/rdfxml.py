"""RDF/XML documents, parsed whole like Turtle."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from triplane.functions.iris import resolve_iri
from triplane.functions.terms import BLANK, IRI, RDF, Term, literal
from triplane.plans.ast import QueryError

_R = "{" + RDF + "}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_SYNTAX = {_R + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "li")}
_NOT_PROPERTIES = _SYNTAX | {_XML + "lang", _XML + "base"}


def _iri(name: str) -> Term:
    return Term(IRI, name[1:].replace("}", "", 1) if name.startswith("{") else name)


class _Reader:
    def __init__(self, scope: str):
        self.scope, self.count = scope, 0
        self.out: list[tuple[Term, Term, Term]] = []

    def fresh(self) -> Term:
        self.count += 1
        return Term(BLANK, f"{self.scope}x{self.count}")

    def node(self, e: ET.Element, base: str, lang: str) -> Term:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if (about := e.get(_R + "about")) is not None:
            s = Term(IRI, resolve_iri(base, about))
        elif (name := e.get(_R + "ID")) is not None:
            s = Term(IRI, resolve_iri(base, "#" + name))
        elif (label := e.get(_R + "nodeID")) is not None:
            s = Term(BLANK, f"{self.scope}n{label}")
        else:
            s = self.fresh()
        if e.tag != _R + "Description":
            self.out.append((s, Term(IRI, RDF + "type"), _iri(e.tag)))
        self.attributes(s, e, lang)
        items = 0
        for p in e:
            tag = p.tag
            if tag == _R + "li":
                items += 1
                tag = f"{_R}_{items}"
            self.property(s, tag, p, base, lang)
        return s

    def attributes(self, s: Term, e: ET.Element, lang: str) -> None:
        for name, value in e.attrib.items():
            if name == _R + "type":
                self.out.append((s, Term(IRI, RDF + "type"), Term(IRI, value)))
            elif name not in _NOT_PROPERTIES and name.startswith("{") and not name.startswith(_XML):
                self.out.append((s, _iri(name), literal(value, lang=lang or None)))

    def property(self, s: Term, tag: str, e: ET.Element, base: str, lang: str) -> None:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        how = e.get(_R + "parseType")
        if how == "Resource":
            o = self.fresh()
            for p in e:
                self.property(o, p.tag, p, base, lang)
        elif how == "Collection":
            cells = [(self.fresh(), self.node(x, base, lang)) for x in e]
            nil = Term(IRI, RDF + "nil")
            for (cell, item), after in zip(cells, [c for c, _ in cells[1:]] + [nil], strict=True):
                self.out += [(cell, Term(IRI, RDF + "first"), item), (cell, Term(IRI, RDF + "rest"), after)]
            o = cells[0][0] if cells else nil
        elif how is not None:
            inner = (e.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in e)
            o = literal(inner, RDF + "XMLLiteral")
        elif (resource := e.get(_R + "resource")) is not None:
            o = Term(IRI, resolve_iri(base, resource))
            self.attributes(o, e, lang)
        elif (label := e.get(_R + "nodeID")) is not None:
            o = Term(BLANK, f"{self.scope}n{label}")
        elif len(e):
            if len(e) > 1:
                raise QueryError(f"several values in {tag}")
            o = self.node(e[0], base, lang)
        elif (kind := e.get(_R + "datatype")) is not None:
            o = literal(e.text or "", resolve_iri(base, kind))
        elif any(a not in _NOT_PROPERTIES for a in e.attrib):
            o = self.fresh()
            self.attributes(o, e, lang)
        else:
            o = literal(e.text or "", lang=lang or None)
        self.out.append((s, _iri(tag), o))


def parse_rdfxml(text: str, scope: str = "", base: str = "") -> Iterator[tuple[Term, Term, Term]]:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as error:
        raise QueryError(f"not XML: {error}") from error
    reader = _Reader(scope)
    base, lang = root.get(_XML + "base", base), root.get(_XML + "lang", "")
    for e in root if root.tag == _R + "RDF" else [root]:
        reader.node(e, base, lang)
    yield from reader.out
