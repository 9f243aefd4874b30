import pytest

from triplane.functions.iris import resolve_iri
from triplane.functions.terms import IRI, XSD, Term
from triplane.plans.ast import Call, Const, QueryError, Unsupported, Var
from triplane.plans.parser import parse


def only_filter(text):
    return parse(f"SELECT ?x WHERE {{ ?x ?p ?y FILTER({text}) }}").where.filters[0]


def test_abbreviations_share_subject_and_predicate():
    q = parse("PREFIX a: <urn:a/> SELECT * { ?s a:p ?x , ?y ; a a:T ; . [ a:q _:b ] a:r (1 2) }")
    triples = q.where.parts[0].triples
    assert [t.s for t in triples[:3]] == [Var("s")] * 3
    assert triples[2].p.term.lex.endswith("#type")
    assert len(triples) == 3 + 1 + 4 + 1
    assert q.variables is None


def test_precedence():
    assert only_filter("?a || ?b && ?c") == Call("or", (Var("a"), Call("and", (Var("b"), Var("c")))))
    e = only_filter("1 + ?a * 2 < 3")
    assert e.name == "<" and e.args[0].name == "+" and e.args[0].args[1].name == "*"
    assert only_filter("!BOUND(?a) && ?b").name == "and"


@pytest.mark.parametrize(
    ("text", "term"),
    [
        ("5", Term(5, "5", XSD + "integer")),
        ("5.5", Term(5, "5.5", XSD + "decimal")),
        ("5e1", Term(5, "5e1", XSD + "double")),
        ("true", Term(4, "true", XSD + "boolean")),
        ('"a\\n\\u0041"', Term(2, "a\nA")),
        ("'''it's'''", Term(2, "it's")),
        ('"x"@EN-gb', Term(7, "x", "en-gb")),
        (f'"x"^^<{XSD}string>', Term(3, "x", XSD + "string")),
        ("<urn:x>", Term(IRI, "urn:x")),
    ],
)
def test_terms(text, term):
    q = parse(f"SELECT * {{ ?s ?p {text} }}")
    assert q.where.parts[0].triples[0].o == Const(term)


def test_base_and_modifiers():
    q = parse("BASE <http://h/a/> SELECT DISTINCT ?x { ?x <b> ?y } ORDER BY DESC(?y) ?x LIMIT 3 OFFSET 2")
    assert q.where.parts[0].triples[0].p.term.lex == "http://h/a/b"
    assert (q.distinct, q.limit, q.offset, [d for _, d in q.order]) == (True, 3, 2, [True, False])


@pytest.mark.parametrize(
    "text",
    [
        "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }",
        "DESCRIBE <urn:x>",
        "SELECT * { GRAPH <urn:g> { ?s ?p ?o } }",
        "SELECT * { ?s ?p ?o MINUS { ?s ?p 1 } }",
        "SELECT * { { SELECT ?x { ?x ?y ?z } } }",
        "SELECT (1 AS ?x) { ?s ?p ?o }",
        "SELECT * { ?s ?p ?o FILTER(STRLEN(?o) > 1) }",
        "PREFIX xsd: <urn:x> SELECT * { ?s ?p ?o FILTER(xsd:integer(?o) > 1) }",
        "SELECT ?s { ?s ?p ?o } GROUP BY ?s",
        "SELECT ?s FROM <urn:g> { ?s ?p ?o }",
    ],
)
def test_unsupported(text):
    with pytest.raises(Unsupported):
        parse(text)


@pytest.mark.parametrize("text", ["", "SELECT", "SELECT ?x { ?x ?p }", "SELECT ?x { ?x a:b ?y }", "SELECT ?x { ?x ?p ?y", "ASK { ?x 5 ?y }", "SELECT ?x { ?x ?p ?y FILTER(BOUND(1)) }", "ASK { ?x ?p ?y } nonsense"])
def test_malformed(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize(
    ("base", "reference", "iri"),
    [("http://a/b/c?q", "d", "http://a/b/d"), ("http://a/b/c", "../d", "http://a/d"), ("http://a/b/c", "/d", "http://a/d"), ("http://a", "d", "http://a/d"), ("http://a/b?q", "#f", "http://a/b?q#f"),
     ("http://a/b", "//h/x", "http://h/x"), ("urn:p/", "x", "urn:p/x"), ("http://a/b", "urn:x", "urn:x"), ("", "x", "x"), ("http://a/b/c", "./", "http://a/b/"), ("http://a/b?q", "", "http://a/b?q")],
)
def test_resolved_references(base, reference, iri):
    assert resolve_iri(base, reference) == iri


def test_turtle_holds_the_tokens_of_one_statement():
    from itertools import islice

    from triplane.sources.turtle import TurtleParser

    parser = TurtleParser("<urn:s> <urn:p> 1 .\n" * 1000)
    triples, most = parser.triples_of_document(), 0
    while list(islice(triples, 100)):
        most = max(most, len(parser.tokens))
    assert most < 10


def test_documents_come_in_pieces(monkeypatch):
    import pandas as pd

    from triplane.sources import files

    class Files:
        def select(self, *_):
            return self

        def mapInPandas(self, parsed, _):
            return [len(x) for x in parsed([pd.DataFrame({"path": ["a"], "content": [b"<urn:s> <urn:p> 1 .\n" * 10]})])]

    monkeypatch.setattr(files, "ROWS", 4)
    assert files.documents(Files(), "turtle") == [4, 4, 2]
