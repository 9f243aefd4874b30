"""Algebra to DataFrames. All physical choices are Catalyst's; the planner orders patterns and keeps columns typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.functions.expressions import compile_expression, ebv
from triplane.functions.terms import Ex, format_term, lexical
from triplane.operators.joins import difference, inner_join, left_join, union
from triplane.operators.modifiers import distinct, distinct_ordered, order_columns, project, slice_
from triplane.operators.solutions import Solutions, column_name, empty, unit
from triplane.plans.algebra import Bgp, Difference, Filter, Join, LeftJoin, Node, Nothing, Union, order_patterns, rewrite, translate
from triplane.plans.ast import Call, Const, Expression, Query, Triple, Var, conjuncts, expression_variables
from triplane.plans.parser import parse
from triplane.sources.base import TripleSource


def _needed(expressions: tuple[Expression, ...] | list[Expression]) -> set[str]:
    return set().union(*map(expression_variables, expressions)) if expressions else set()


def _all(expressions: tuple[Expression, ...], env: dict[str, Ex]) -> Column:
    out = None
    for e in expressions:
        c = ebv(compile_expression(e, env))
        out = c if out is None else out & c
    return out


def _same_terms(conditions: tuple[Expression, ...]) -> list[tuple[str, str]]:
    """Pairs of variables that a solution must bind to one term, as far as conditions say so."""
    calls = [e for c in conditions for e in conjuncts(c) if isinstance(e, Call) and e.name == "sameterm"]
    return [(e.args[0].name, e.args[1].name) for e in calls if all(isinstance(a, Var) for a in e.args) and e.args[0] != e.args[1]]


class Planner:
    def __init__(self, source: TripleSource):
        self.source = source

    def solutions(self, node: Node) -> Solutions:
        source = self.source
        match node:
            case Bgp(()):
                return unit(source.spark)
            case Bgp(triples):
                return self.basic(list(dict.fromkeys(triples)))
            case Nothing(names):
                return empty(source.spark, set(names))
            case Join(left, right):
                return inner_join(self.solutions(left), self.solutions(right))
            case LeftJoin(left, right, condition) | Difference(left, right, condition):
                a, b = self.solutions(left), self.solutions(right)
                used = _needed(condition)
                a, b = source.decode(a, used), source.decode(b, used)
                on = (lambda env: _all(condition, env)) if condition else None
                return left_join(a, b, on) if isinstance(node, LeftJoin) else difference(a, b, on)
            case Union(left, right):
                return union(self.solutions(left), self.solutions(right))
            case Filter(child, conditions):
                found = self.basic(list(dict.fromkeys(child.triples)), _same_terms(conditions)) if isinstance(child, Bgp) and child.triples else self.solutions(child)
                s = source.decode(found, _needed(conditions))
                return s.where(_all(conditions, s.env()))
        raise AssertionError(node)

    def basic(self, triples: list[Triple], equal: list[tuple[str, str]] = ()) -> Solutions:
        """equal: variables that a filter on the result makes the same term."""
        stars = self.source.stars(triples)
        variables = lambda star: {v for t in star for v in t.variables()}
        constants = lambda star: sum(isinstance(x, Const) for t in star for x in (t.s, t.o))
        subjects = lambda star: {t.s.name for t in star if isinstance(t.s, Var)}
        ordered = order_patterns(stars, self.source.estimate, variables, constants) if len(stars) > 1 else stars
        out, single = self.source.match(ordered[0]), subjects(ordered[0])
        for star in ordered[1:]:
            found = self.source.match(star, out.kinds)
            shared = out.variables & found.variables
            pairs = [] if shared else [(v, w) for a, b in equal for v, w in ((a, b), (b, a)) if v in out.certain and w in found.certain and out.kinds[v] == found.kinds[w]]
            keys = shared | {v for p in pairs for v in p}
            single |= subjects(star)
            # no side has a row a key where no key is a subject
            out = inner_join(out, found, bool(keys) and not keys & single, pairs)
        return out


def plan(source: TripleSource, query: Query) -> Solutions:
    """The query's solutions, modified and projected; for ASK one row with a boolean."""
    planner = Planner(source)
    node = rewrite(translate(query.where), source.known)
    s = planner.solutions(node)
    if query.form == "ask":
        found = s.df.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        return Solutions(found, {}, frozenset())
    every = translate(query.where).variables()
    variables = query.variables if query.variables is not None else _in_order(query, every)
    if query.order:
        # ids sort like their terms, so only keys that compute something need the terms
        computed = [e for e, _ in query.order if not isinstance(e, Var)]
        s = planner.source.decode(s, _needed(computed))
        env = s.env()
        keys = [(compile_expression(e, env), down) for e, down in query.order]
        if query.distinct:
            inside = all(isinstance(e, Var) and e.name in variables for e, _ in query.order)
            if inside:
                p = distinct(project(s, variables))
                df = p.df.orderBy(*order_columns([(Ex(p.kinds[e.name], F.col(column_name(e.name))), down) for e, down in query.order]))
            else:
                p, df = project(s, variables), distinct_ordered(s, variables, keys)
        else:
            p, df = project(s, variables), s.df.orderBy(*order_columns(keys))
        out = slice_(df, query.limit, query.offset)
        cols = [column_name(v) for v in variables if v in s.kinds]
        return project(Solutions(out.select(*cols) if cols else out, {v: s.kinds[v] for v in variables if v in s.kinds}, p.certain), variables)
    p = project(s, variables)
    if query.distinct:
        p = distinct(p)
    return Solutions(slice_(p.df, query.limit, query.offset), p.kinds, p.certain)


def _in_order(query: Query, every: set[str]) -> list[str]:
    """All named variables in the order of their first mention."""
    from triplane.plans.ast import Alternatives, Block, Group, Optional

    seen: dict[str, None] = {}

    def walk(group: Group) -> None:
        for part in group.parts:
            if isinstance(part, Block):
                for t in part.triples:
                    seen.update(dict.fromkeys(t.variables()))
            elif isinstance(part, Optional):
                walk(part.group)
            elif isinstance(part, Alternatives):
                for g in part.groups:
                    walk(g)
            else:
                walk(part)

    walk(query.where)
    return [v for v in seen if v in every and not v.startswith(".")]


def run(source: TripleSource, text: str, form: str = "native") -> DataFrame:
    """A query's result, a column for each variable. form: ``native`` gives values (IRIs and dynamic terms as text), ``terms``
    gives N-Triples notation."""
    query = parse(text)
    s = plan(source, query)
    if query.form == "ask":
        return s.df
    s = decoded(source, query, s)
    return s.df.select(*[_output(s.term(v), form).alias(v) for v in s.kinds])


def decoded(source: TripleSource, query: Query, s: Solutions) -> Solutions:
    """A plan's solutions with their terms, in the query's order."""
    names = list(s.kinds)
    s = source.decode(s, set(names)) if not query.order else _decode_in_order(source, s)
    return Solutions(s.df, {v: s.kinds[v] for v in names}, s.certain)


def _decode_in_order(source: TripleSource, s: Solutions) -> Solutions:
    """Decoding joins, which need not keep an order: the place of each row is kept and sorted by."""
    if all(k.name != "id" for k in s.kinds.values()):
        return s
    placed = Solutions(s.df.withColumn("place", F.monotonically_increasing_id()), s.kinds, s.certain)
    out = source.decode(placed, set(s.kinds))
    return Solutions(out.df.orderBy("place"), out.kinds, out.certain)


def _output(x: Ex, form: str) -> Column:
    if form == "terms":
        return format_term(x)
    return lexical(x) if x.kind.name in ("iri", "bnode", "dyn", "lang") else x.col
