"""Results as text or in the SPARQL results XML format."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.functions.terms import BLANK, IRI, LANG, SIMPLE, Ex, format_term, to_dyn
from triplane.operators.solutions import Solutions
from triplane.plans.ast import Query
from triplane.plans.parser import parse
from triplane.plans.planner import decoded, plan, run
from triplane.sources.base import TripleSource


def text_lines(source: TripleSource, text: str) -> DataFrame:
    """One column ``value``: a line for each solution, terms in N-Triples notation between spaces, nothing for an unbound
    variable; YES or NO for ASK. Writing it as text stays distributed."""
    query = parse(text)
    s = plan(source, query)
    if query.form == "ask":
        return s.df.select(F.when(F.col("ask"), "YES").otherwise("NO").alias("value"))
    s = decoded(source, query, s)
    terms = [F.coalesce(format_term(s.term(v)), F.lit("")) for v in s.kinds]
    return s.df.select(F.concat_ws(" ", *terms).alias("value") if terms else F.lit("").alias("value"))


def write_text(source: TripleSource, text: str, path: str, mode: str = "errorifexists") -> None:
    text_lines(source, text).write.mode(mode).text(path)


def _xml(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _binding(name: str, x: Ex) -> Column:
    """The binding of a variable, nothing where it is unbound."""
    term = to_dyn(x)
    text, tag, cat = _xml(term["lex"]), F.replace(_xml(term["tag"]), F.lit('"'), F.lit("&quot;")), term["cat"]
    literal = F.when(cat == SIMPLE, F.concat(F.lit("<literal>"), text)).when(cat == LANG, F.concat(F.lit('<literal xml:lang="'), tag, F.lit('">'), text)).otherwise(F.concat(F.lit('<literal datatype="'), tag, F.lit('">'), text))
    body = F.when(cat == BLANK, F.concat(F.lit("<bnode>"), text, F.lit("</bnode>"))).when(cat == IRI, F.concat(F.lit("<uri>"), text, F.lit("</uri>"))).otherwise(F.concat(literal, F.lit("</literal>")))
    return F.coalesce(F.when(x.col.isNotNull(), F.concat(F.lit(f"<binding name={quoteattr(name)}>"), body, F.lit("</binding>"))), F.lit(""))


def xml_results(source: TripleSource, text: str) -> DataFrame:
    """One column ``value``: the ``result`` element of each solution of a SELECT query, in the query's order."""
    query = parse(text)
    return _results(decoded(source, query, plan(source, query)))


def _results(s: Solutions) -> DataFrame:
    return s.df.select(F.concat(F.lit("<result>"), *[_binding(v, s.term(v)) for v in s.kinds], F.lit("</result>")).alias("value"))


def xml_chunks(source: TripleSource, text: str) -> Iterator[str]:
    """The XML document in pieces. The query is parsed and planned before the first piece, so its errors come at once; rows
    are fetched a partition at a time and never held together on the driver."""
    query = parse(text)
    s = plan(source, query)
    return _ask(bool(s.df.first()["ask"])) if query.form == "ask" else _rows(query, decoded(source, query, s))


_OPEN = '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n'


def _ask(found: bool) -> Iterator[str]:
    yield f"{_OPEN}<head></head>\n<boolean>{'true' if found else 'false'}</boolean>\n</sparql>\n"


def _rows(query: Query, s: Solutions) -> Iterator[str]:
    names = list(s.kinds)
    yield _OPEN + "<head>" + "".join(f"<variable name={quoteattr(v)}/>" for v in names) + "</head>\n"
    yield f'<results distinct="{str(query.distinct).lower()}" ordered="{str(bool(query.order)).lower()}">\n'
    for row in _results(s).toLocalIterator():
        yield row["value"] + "\n"
    yield "</results>\n</sparql>\n"


__all__ = ["run", "text_lines", "write_text", "xml_chunks", "xml_results"]
