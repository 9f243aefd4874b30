"""Parsed queries: expressions, graph patterns and the query itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from triplane.functions.terms import Term


class QueryError(ValueError):
    """The query is malformed."""


class Unsupported(QueryError):
    """The query asks for something outside the supported language."""


@dataclass(frozen=True)
class Var:
    """A variable; those that stand for blank nodes of the query start with a dot and are never projected."""

    name: str

    @property
    def anonymous(self) -> bool:
        return self.name.startswith(".")


@dataclass(frozen=True)
class Const:
    term: Term


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Expression, ...]


Expression = Var | Const | Call
Slot = Var | Const


@dataclass(frozen=True)
class Triple:
    s: Slot
    p: Slot
    o: Slot

    @property
    def slots(self) -> tuple[Slot, Slot, Slot]:
        return self.s, self.p, self.o

    def variables(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in self.slots if isinstance(x, Var)))


@dataclass(frozen=True)
class Block:
    """Triple patterns in a row."""

    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Group:
    parts: tuple[Part, ...]
    filters: tuple[Expression, ...]


@dataclass(frozen=True)
class Optional:
    group: Group


@dataclass(frozen=True)
class Alternatives:
    groups: tuple[Group, ...]


Part = Block | Group | Optional | Alternatives


@dataclass
class Query:
    form: str  # select or ask
    where: Group
    variables: list[str] | None = None  # None: all
    distinct: bool = False
    order: list[tuple[Expression, bool]] = field(default_factory=list)  # expression, descending
    limit: int | None = None
    offset: int = 0


def expression_variables(e: Expression) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    return set().union(*map(expression_variables, e.args)) if isinstance(e, Call) else set()


def conjuncts(e: Expression) -> list[Expression]:
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, Call) and e.name == "and" else [e]
