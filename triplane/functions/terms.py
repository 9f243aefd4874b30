"""RDF terms: categories, datatypes, and terms as columns.

Within a DataFrame a variable is one column. Its ``Kind`` says what the column holds:

* static kinds hold the native value (BIGINT, DOUBLE, STRING, ...), so filters reach the scan and joins compare natively;
* ``dyn`` holds a struct that can be any term; ``id`` holds a store's dictionary id, which sorts like its term.

NULL is an unbound variable and, in expressions, also an evaluation error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
BLANK, IRI, SIMPLE, STRING, BOOLEAN, NUMERIC, DATETIME, LANG, OTHER = range(9)
INTEGERS = tuple(XSD + x for x in "integer positiveInteger nonPositiveInteger negativeInteger nonNegativeInteger byte short int long unsignedByte unsignedShort unsignedInt unsignedLong".split())
FLOATS = (XSD + "float", XSD + "double")
DECIMAL = "decimal(38,18)"
LEXICAL = {
    "int": r"[+-]?[0-9]+",
    "dec": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "dbl": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "dt": r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?",
}
DYN = f"struct<cat:int,lex:string,tag:string,k:int,i:bigint,d:{DECIMAL},f:double,b:boolean,t:timestamp_ntz>"


@dataclass(frozen=True)
class Kind:
    """name: iri, bnode, simple, string, bool, int, dec, dbl, dt, lang, other, dyn or id. iri and bnode columns hold what follows
    ``prefix``; ``datatype`` is the IRI of a typed literal's type."""

    name: str
    datatype: str | None = None
    prefix: str = ""

    @property
    def literal(self) -> bool:
        return self.name not in ("iri", "bnode", "dyn", "id")

    @property
    def numeric(self) -> bool:
        return self.name in ("int", "dec", "dbl")


DYNAMIC, ID, SIMPLE_KIND, BOOL_KIND = Kind("dyn"), Kind("id"), Kind("simple"), Kind("bool", XSD + "boolean")
INT_KIND, DEC_KIND, DBL_KIND = Kind("int", XSD + "integer"), Kind("dec", XSD + "decimal"), Kind("dbl", XSD + "double")
FULL_IRI = Kind("iri")
_CATEGORY = {"bnode": BLANK, "iri": IRI, "simple": SIMPLE, "string": STRING, "bool": BOOLEAN, "int": NUMERIC, "dec": NUMERIC, "dbl": NUMERIC, "dt": DATETIME, "lang": LANG, "other": OTHER}


@dataclass(frozen=True)
class Ex:
    """A typed column: an expression's value or a variable."""

    kind: Kind
    col: Column
    fixed: bool = False  # a number of the query that is neither an error nor NaN


@dataclass(frozen=True)
class Term:
    """A constant of a query or a file: category, lexical form and, for literals, datatype IRI or language tag."""

    cat: int
    lex: str
    tag: str = ""

    def __str__(self) -> str:
        if self.cat == BLANK:
            return "_:" + self.lex
        if self.cat == IRI:
            return f"<{self.lex}>"
        text = '"' + self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'
        return text if self.cat == SIMPLE else f"{text}@{self.tag}" if self.cat == LANG else f"{text}^^<{self.tag}>"


def literal(lex: str, datatype: str | None = None, lang: str | None = None) -> Term:
    if lang:
        return Term(LANG, lex, lang.lower())
    if datatype is None:
        return Term(SIMPLE, lex)
    return Term(category_of(datatype), lex, datatype)


def category_of(datatype: str) -> int:
    if datatype == XSD + "string":
        return STRING
    if datatype == XSD + "boolean":
        return BOOLEAN
    if datatype in INTEGERS or datatype in FLOATS or datatype == XSD + "decimal":
        return NUMERIC
    return DATETIME if datatype == XSD + "dateTime" else OTHER


def kind_of(datatype: str) -> str:
    """The static kind of a datatype's literals."""
    cat = category_of(datatype)
    if cat == NUMERIC:
        return "int" if datatype in INTEGERS else "dbl" if datatype in FLOATS else "dec"
    return {STRING: "string", BOOLEAN: "bool", DATETIME: "dt", OTHER: "other"}[cat]


def parse_native(name: str, lex: Column) -> Column:
    """The native value of a lexical form; NULL if it isn't one of the type."""
    if name == "bool":
        return F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)
    ok = lex.rlike(f"^({LEXICAL[name]})$")
    if name == "int":
        return F.when(ok, lex).try_cast("bigint")
    if name == "dec":
        return F.when(ok, lex).try_cast(DECIMAL)
    if name == "dbl":
        return F.when(ok, F.regexp_replace(F.regexp_replace(lex, r"^\+", ""), "INF", "Infinity")).try_cast("double")
    return F.when(ok, lex).try_cast("timestamp").cast("timestamp_ntz")


def constant(term: Term) -> Ex:
    """A literal or IRI of the query, as a static expression. An ill-typed literal has a NULL value."""
    if term.cat == IRI:
        return Ex(FULL_IRI, F.lit(term.lex))
    if term.cat == BLANK:
        return Ex(Kind("bnode"), F.lit(term.lex))
    if term.cat == SIMPLE:
        return Ex(SIMPLE_KIND, F.lit(term.lex))
    if term.cat == LANG:
        return Ex(Kind("lang"), F.struct(F.lit(term.lex).alias("lex"), F.lit(term.tag).alias("lang")))
    name = kind_of(term.tag)
    if name in ("string", "other"):
        return Ex(Kind(name, term.tag), F.lit(term.lex))
    fine = name in ("int", "dec", "dbl") and term.lex != "NaN" and re.fullmatch(LEXICAL[name], term.lex) is not None
    return Ex(Kind(name, term.tag), parse_native(name, F.lit(term.lex)), fine and (name == "dbl" or len(term.lex) < 18))


def lexical(x: Ex) -> Column:
    """The lexical form of a literal, or the full IRI or blank label."""
    c, name = x.col, x.kind.name
    if name in ("iri", "bnode"):
        return F.concat(F.lit(x.kind.prefix), c.cast("string")) if x.kind.prefix else c.cast("string")
    if name in ("dyn", "lang"):
        return c["lex"]
    if name == "dt":
        text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""))
        return text
    if name == "dec":
        text = F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1")
        return F.regexp_replace(text, r"\.$", "")
    if name == "dbl":
        return F.when(F.isnan(c), "NaN").otherwise(F.replace(c.cast("string"), F.lit("Infinity"), F.lit("INF")))
    return c.cast("string")


def to_dyn(x: Ex) -> Column:
    """The term as a struct; NULL stays NULL."""
    if x.kind.name == "dyn":
        return x.col
    name, c = x.kind.name, x.col
    tag = c["lang"] if name == "lang" else F.lit(x.kind.datatype or "")
    value = {"int": "i", "dec": "d", "dbl": "f", "bool": "b", "dt": "t"}.get(name)
    types = {"i": "bigint", "d": DECIMAL, "f": "double", "b": "boolean", "t": "timestamp_ntz"}
    fields = [F.lit(_CATEGORY[name]).alias("cat"), lexical(x).alias("lex"), tag.alias("tag"), F.lit({"int": 0, "dec": 1, "dbl": 2}.get(name)).cast("int").alias("k")]
    fields += [(c if f == value else F.lit(None)).cast(t).alias(f) for f, t in types.items()]
    return F.when(c.isNotNull(), F.struct(*fields))


def as_statement(x: Ex) -> list[Column]:
    """A static term's columns in a statement; the lexical form is NULL where the term is."""
    tag = x.col["lang"] if x.kind.name == "lang" else F.lit(x.kind.datatype or "")
    return [F.lit(_CATEGORY[x.kind.name]).alias("o_cat"), lexical(x).alias("o_lex"), tag.alias("o_tag")]


def dyn_from_lexical(cat: Column, lex: Column, tag: Column) -> Column:
    """The struct of terms given as category, lexical form and tag columns."""
    k = F.when(cat == NUMERIC, F.when(tag.isin(*INTEGERS), 0).when(tag == XSD + "decimal", 1).otherwise(2)).cast("int")
    return F.struct(
        cat.cast("int").alias("cat"), lex.alias("lex"), tag.alias("tag"), k.alias("k"),
        F.when(k == 0, parse_native("int", lex)).alias("i"), F.when(k == 1, parse_native("dec", lex)).alias("d"), F.when(k == 2, parse_native("dbl", lex)).alias("f"),
        F.when(cat == BOOLEAN, parse_native("bool", lex)).alias("b"), F.when(cat == DATETIME, parse_native("dt", lex)).alias("t"),
    )


def category_column(datatype: Column, lang: Column) -> Column:
    """The category of a literal from its datatype and language columns."""
    return (
        F.when(lang.isNotNull() & (lang != ""), LANG).when(datatype.isNull(), SIMPLE).when(datatype == XSD + "string", STRING).when(datatype == XSD + "boolean", BOOLEAN)
        .when(datatype.isin(*INTEGERS, *FLOATS, XSD + "decimal"), NUMERIC).when(datatype == XSD + "dateTime", DATETIME).otherwise(OTHER)
    )


def decimal_of(d: Column) -> Column:
    return F.coalesce(d["d"], d["i"].cast(DECIMAL))


def double_of(d: Column) -> Column:
    return F.coalesce(d["f"], d["d"].cast("double"), d["i"].cast("double"))


def key_of(d: Column) -> Column:
    """Term identity of a struct."""
    return F.struct(d["cat"].alias("cat"), d["lex"].alias("lex"), d["tag"].alias("tag"))


def sort_keys(x: Ex) -> list[Column]:
    """Columns that order as terms do: category, value, then datatype or tag and lexical form."""
    name, c = x.kind.name, x.col
    if name in ("iri", "bnode"):
        return [lexical(x)]
    if name == "lang":
        return [c["lang"], c["lex"]]
    if name == "dyn":
        return [c["cat"], c["b"], double_of(c), F.when(c["k"] < 2, decimal_of(c)), c["t"], F.when(~c["cat"].isin(BOOLEAN, DATETIME), c["tag"]), c["lex"]]
    return [c]


def format_term(x: Ex) -> Column:
    """The term in N-Triples notation; NULL if unbound."""
    d = to_dyn(x)
    lex = d["lex"]
    escaped = lex
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    quoted = F.concat(F.lit('"'), escaped, F.lit('"'))
    return (
        F.when(d["cat"] == BLANK, F.concat(F.lit("_:"), lex)).when(d["cat"] == IRI, F.concat(F.lit("<"), lex, F.lit(">"))).when(d["cat"] == SIMPLE, quoted)
        .when(d["cat"] == LANG, F.concat(quoted, F.lit("@"), d["tag"])).otherwise(F.concat(quoted, F.lit("^^<"), d["tag"], F.lit(">")))
    )


def canonical(term: Term) -> bool:
    """Whether a literal's lexical form is the one that its native value prints as, so comparing values compares terms."""
    name = kind_of(term.tag) if term.cat in (BOOLEAN, NUMERIC, DATETIME) else ""
    if name == "int":
        return re.fullmatch(r"0|-?[1-9][0-9]{0,17}", term.lex) is not None
    if name == "bool":
        return term.lex in ("true", "false")
    if name == "dt":
        return re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]*[1-9])?", term.lex) is not None
    return True
