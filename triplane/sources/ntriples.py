"""N-Triples text, parsed line by line with native expressions: splittable, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.functions.terms import BLANK, IRI, LANG, OTHER, SIMPLE, category_column

#: Columns of a statement: category, lexical form and tag of subject and object, and the predicate's IRI.
STATEMENT = "s_cat int, s_lex string, p_lex string, o_cat int, o_lex string, o_tag string"
_IRI, _BLANK = r"<([^>]*)>", r"_:([^\s<\"]+?)"
_LITERAL = r'"([^"]*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^>]*)>)?'
#: One match finds all parts: subject's first character, IRI, blank label; predicate; object's first character, IRI, blank
#: label, text, language, datatype.
LINE = rf"^\s*(?=(.))(?:{_IRI}|{_BLANK})\s*<([^>]*)>\s*(?=(.))(?:{_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"
#: Escaped backslashes and quotes stand aside while a line is matched, so that a text is one run of a class of characters: a
#: pattern of alternatives would recurse once a character. Characters that are these marks themselves are escaped first.
_ASIDE = (("\\\\", "\x02"), ('\\"', "\x03"))
#: The parts in a row, the text last, for it alone may hold the mark between them.
_MARK = "\x01"
_PARTS = "$1 $2 $3 $4 $5 $6 $7 $9 $10 $8".replace(" ", _MARK)


def unescape(c: Column) -> Column:
    r"""Undoes \t \n \r \b \f \" \' \\ \uXXXX \UXXXXXXXX."""
    part = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"

    def one(x: Column) -> Column:
        code = F.substring(x, 2, 1)
        named = F.element_at(F.create_map(*[F.lit(y) for pair in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f")) for y in pair]), code)
        point = F.conv(F.substring(x, 3, 8), 16, 10).cast("int")
        utf32 = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
        return F.when(~F.startswith(x, F.lit("\\")), x).when(code.isin("u", "U") & (F.length(x) > 2), utf32).otherwise(F.coalesce(named, F.substring(x, 2, 1)))

    pieces = F.regexp_extract_all(c, F.lit(f"({part})"), F.lit(1))
    return F.when(F.instr(c, "\\") == 0, c).otherwise(F.array_join(F.transform(pieces, one), ""))


def statements(lines: DataFrame, scope: str = "") -> DataFrame:
    """Statements of a DataFrame with a column ``value`` of lines. Empty lines and comments give none; a malformed line is an
    error. scope: put before blank labels, so that files don't share them."""
    value = F.col("value")
    whole = value
    for _, mark in _ASIDE:
        value = F.replace(value, F.lit(mark), F.lit(f"\\u{ord(mark):04x}"))
    for escape, mark in _ASIDE:
        value = F.replace(value, F.lit(escape), F.lit(mark))
    value = F.when(whole.rlike(r"[\\\x02\x03]"), value).otherwise(whole)
    real = lines.where(~whole.rlike(r"^\s*(#.*)?$"))
    # columns of their own, so that the match runs once a line; one that isn't deterministic keeps filters from repeating it
    parts = F.when(F.spark_partition_id() >= 0, F.split(F.regexp_replace(value, LINE, _PARTS), _MARK, 10))
    matched = real.select(parts.alias("parts"), whole.alias("whole"))
    fine = F.when(F.size("parts") == 10, F.col("parts")).otherwise(F.array(F.raise_error(F.concat(F.lit("not an N-Triples line: "), "whole")).cast("string")))
    cut = matched.select(fine.alias("g"))
    s_first, s_iri, s_blank, p, o_first, o_iri, o_blank, lang, kind, text = (F.col("g")[i] for i in range(10))
    for escape, mark in reversed(_ASIDE):
        text = F.replace(text, F.lit(mark), F.lit(escape))
    is_iri = s_first == "<"
    o_cat = F.when(o_first == "<", IRI).when(o_first == "_", BLANK).otherwise(category_column(F.when(kind != "", kind), lang))
    s_lex = F.when(is_iri, unescape(s_iri)).otherwise(F.concat(F.lit(scope), s_blank))
    o_lex = F.when(o_first == "<", unescape(o_iri)).when(o_first == "_", F.concat(F.lit(scope), o_blank)).otherwise(unescape(text))
    tag = F.when(o_cat == LANG, F.lower(lang)).when((o_cat > SIMPLE) & (o_cat <= OTHER), kind).otherwise("")
    return cut.select(F.when(is_iri, IRI).otherwise(BLANK).cast("int").alias("s_cat"), s_lex.alias("s_lex"), unescape(p).alias("p_lex"), o_cat.cast("int").alias("o_cat"), o_lex.alias("o_lex"), tag.alias("o_tag"))


def read(spark, path: str, scope: str = "") -> DataFrame:
    return statements(spark.read.text(path), scope)


def write(statements_: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none", lines: int = 500_000) -> None:
    """Statements as N-Triples lines. compression: Spark's name of a codec; files of most can't be split, so none has more than
    ``lines`` lines."""
    statements_.select(line().alias("value")).write.mode(mode).option("compression", compression).option("maxRecordsPerFile", lines).text(path)


def line() -> Column:
    from triplane.functions.terms import DYNAMIC, Ex, dyn_from_lexical, format_term

    s = F.when(F.col("s_cat") == IRI, F.concat(F.lit("<"), "s_lex", F.lit(">"))).otherwise(F.concat(F.lit("_:"), "s_lex"))
    o = format_term(Ex(DYNAMIC, dyn_from_lexical(F.col("o_cat"), F.col("o_lex"), F.col("o_tag"))))
    return F.concat(s, F.lit(" <"), "p_lex", F.lit("> "), o, F.lit(" ."))


__all__ = ["STATEMENT", "line", "read", "statements", "write"]
