"""Turtle documents. The syntax isn't splittable, so a file is parsed whole, files in parallel."""

from __future__ import annotations

from collections.abc import Iterator

from triplane.functions.terms import BLANK, IRI, Term
from triplane.plans.ast import Const, QueryError, Slot, Triple, Var
from triplane.plans.parser import Parser, tokens


class TurtleParser(Parser):
    """Turtle's terms are the query language's; only directives and the frame around statements differ."""

    def __init__(self, text: str, base: str = ""):
        super().__init__("")
        self.coming = tokens(text)
        self.base = base

    def peek(self) -> tuple[str, str]:
        """Tokens are made as they are asked for, and those of finished statements go: a document has millions."""
        while self.at >= len(self.tokens):
            if (token := next(self.coming, None)) is None:
                return "end", ""
            self.tokens.append(token)
        return self.tokens[self.at]

    def triples_of_document(self) -> Iterator[Triple]:
        while self.peek()[0] != "end":
            del self.tokens[: self.at]
            self.at = 0
            kind, text = self.peek()
            if kind == "lang" and text in ("@prefix", "@base") or self.is_word("prefix", "base"):
                self.next()
                if text.lower().endswith("prefix"):
                    name = self.next()[1]
                    if not name.endswith(":"):
                        raise QueryError(f"not a prefix: {name!r}")
                    self.prefixes[name[:-1]] = self.iri_text()
                else:
                    self.base = self.iri_text()
                if kind == "lang":
                    self.expect(".")
                continue
            out: list[Triple] = []
            bare = self.is_punct("[")
            subject = self.node(out)
            if not (bare and self.is_punct(".")):
                self.properties(subject, out)
            self.expect(".")
            yield from out


def _term(slot: Slot, scope: str) -> Term:
    if isinstance(slot, Const):
        return slot.term
    assert isinstance(slot, Var)
    if not slot.anonymous:
        raise QueryError("a document has no variables")
    return Term(BLANK, scope + slot.name.replace("._", "n").replace(".", "g"))


def parse_turtle(text: str, scope: str = "", base: str = "") -> Iterator[tuple[Term, Term, Term]]:
    for t in TurtleParser(text, base).triples_of_document():
        s, p, o = (_term(x, scope) for x in t.slots)
        if s.cat > IRI:
            raise QueryError(f"a literal as subject: {s}")
        yield s, p, o


__all__ = ["TurtleParser", "parse_turtle"]
