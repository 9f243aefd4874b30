"""Query expressions compiled to columns. NULL stands for an evaluation error, so Spark's three-valued logic is SPARQL's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from triplane.functions.terms import (
    BOOL_KIND, BOOLEAN, DATETIME, DBL_KIND, DEC_KIND, DECIMAL, DYNAMIC, FULL_IRI, INT_KIND, IRI, LANG, NUMERIC, SIMPLE, SIMPLE_KIND, STRING, XSD,
    Ex, Kind, constant, decimal_of, double_of, key_of, lexical, to_dyn,
)
from triplane.plans.ast import Call, Const, Expression, Var

Env = dict[str, Ex]


def _none(kind: str = "boolean") -> Column:
    return F.lit(None).cast(kind)


def _both(a: Ex, b: Ex, value: Column | bool) -> Column:
    return F.when(a.col.isNotNull() & b.col.isNotNull(), value)


def compile_expression(e: Expression, env: Env) -> Ex:
    if isinstance(e, Const):
        return constant(e.term)
    if isinstance(e, Var):
        return env.get(e.name) or Ex(DYNAMIC, _none(_dyn_type()))
    assert isinstance(e, Call)
    if e.name == "bound":
        (v,) = e.args
        return Ex(BOOL_KIND, env[v.name].col.isNotNull() if v.name in env else F.lit(False))
    if e.name in ("and", "or", "not"):
        args = [ebv(compile_expression(a, env)) for a in e.args]
        return Ex(BOOL_KIND, args[0] & args[1] if e.name == "and" else args[0] | args[1] if e.name == "or" else ~args[0])
    if e.name == "regex":
        fixed = [a.term.lex for a in e.args[1:] if isinstance(a, Const) and a.term.cat == SIMPLE]
        return regex(*[compile_expression(a, env) for a in e.args], fixed=fixed if len(fixed) == len(e.args) - 1 else None)
    args = [compile_expression(a, env) for a in e.args]
    return FUNCTIONS[e.name](*args)


def _dyn_type() -> str:
    from triplane.functions.terms import DYN

    return DYN


def ebv(x: Ex) -> Column:
    """The effective boolean value."""
    c, name = x.col, x.kind.name
    if name == "bool":
        return c
    if name == "dbl":
        return (c != 0) & ~F.isnan(c)
    if x.kind.numeric:
        return c != 0
    if name in ("simple", "string"):
        return c != ""
    if name == "lang":
        return c["lex"] != ""
    if name == "dyn":
        number = double_of(c)
        return F.when(c["cat"] == BOOLEAN, c["b"]).when(c["cat"] == NUMERIC, (number != 0) & ~F.isnan(number)).when(c["cat"].isin(SIMPLE, STRING, LANG), c["lex"] != "")
    return _none()


def _numbers(a: Ex, b: Ex) -> tuple[Column, Column, str]:
    """Two static numbers in their common type."""
    order = ["int", "dec", "dbl"]
    common = order[max(order.index(a.kind.name), order.index(b.kind.name))]
    to = {"int": "bigint", "dec": DECIMAL, "dbl": "double"}[common]
    cast = lambda x: x.col if x.kind.name == common else x.col.cast(to)
    return cast(a), cast(b), common


def _compare_values(a: Column, b: Column, op: str, floating: bool, fixed: tuple[bool, bool] = (False, False)) -> Column:
    """floating: NaN compares with nothing. A fixed side needs no guard, which leaves a condition that reaches the scan; an
    equality stays a conjunct of its own, which joins can hash on."""
    out = {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if floating and any(fixed):
        return out & ~F.isnan(b if fixed[0] else a)
    if floating and op == "=":
        return out & F.when(b.isNotNull(), ~F.isnan(a))
    return F.when(a.isNotNull() & b.isNotNull(), out & ~F.isnan(a) & ~F.isnan(b)) if floating else out


def _dyn_numbers(a: Column, b: Column, op: str) -> Column:
    exact = _compare_values(decimal_of(a), decimal_of(b), op, False)
    return F.when((a["k"] < 2) & (b["k"] < 2), exact).otherwise(_compare_values(double_of(a), double_of(b), op, True))


def _dyn_compare(a: Column, b: Column, op: str) -> Column:
    cat = a["cat"]
    return (
        F.when(cat != b["cat"], _none()).when(cat.isin(SIMPLE, STRING), _compare_values(a["lex"], b["lex"], op, False)).when(cat == BOOLEAN, _compare_values(a["b"], b["b"], op, False))
        .when(cat == NUMERIC, _dyn_numbers(a, b, op)).when(cat == DATETIME, _compare_values(a["t"], b["t"], op, False))
    )


def equals(a: Ex, b: Ex) -> Ex:
    """``=``: values of comparable kinds by value; IRIs and blank nodes by identity; other literals that differ are an error."""
    ka, kb = a.kind, b.kind
    if ka.numeric and kb.numeric:
        x, y, common = _numbers(a, b)
        return Ex(BOOL_KIND, _compare_values(x, y, "=", common == "dbl", (a.fixed, b.fixed)))
    if ka.name == kb.name and ka.name in ("simple", "string", "bool", "dt"):
        return Ex(BOOL_KIND, a.col == b.col)
    if ka.name == kb.name and ka.name in ("iri", "bnode"):
        return Ex(BOOL_KIND, a.col == b.col if ka.prefix == kb.prefix else _iri_equal(a, b))
    if "dyn" not in (ka.name, kb.name):
        if not (ka.literal and kb.literal):
            return Ex(BOOL_KIND, _both(a, b, F.lit(False)))
        if ka.name != kb.name or ka.name not in ("lang", "other"):
            return Ex(BOOL_KIND, _none())
    x, y = to_dyn(a), to_dyn(b)
    same = key_of(x) == key_of(y)
    comparable = x["cat"].between(SIMPLE, DATETIME)
    out = (
        F.when(x.isNull() | y.isNull(), _none()).when(comparable & (x["cat"] == y["cat"]), _dyn_compare(x, y, "=")).when(same, True)
        .when((x["cat"] <= IRI) | (y["cat"] <= IRI), False)
    )
    return Ex(BOOL_KIND, out)


def _iri_equal(a: Ex, b: Ex) -> Column:
    """IRIs of two templates. A constant under a template becomes a comparison of the template's own column."""
    for x, y in ((a, b), (b, a)):
        if x.kind.prefix and y.kind.prefix and not x.kind.prefix.startswith(y.kind.prefix) and not y.kind.prefix.startswith(x.kind.prefix):
            return _both(a, b, F.lit(False))
    return lexical(a) == lexical(b)


def _ordered(op: str) -> Callable[[Ex, Ex], Ex]:
    def compare(a: Ex, b: Ex) -> Ex:
        ka, kb = a.kind, b.kind
        if ka.numeric and kb.numeric:
            x, y, common = _numbers(a, b)
            return Ex(BOOL_KIND, _compare_values(x, y, op, common == "dbl", (a.fixed, b.fixed)))
        if ka.name == kb.name and ka.name in ("simple", "string", "bool", "dt"):
            return Ex(BOOL_KIND, _compare_values(a.col, b.col, op, False))
        if "dyn" in (ka.name, kb.name):
            return Ex(BOOL_KIND, _dyn_compare(to_dyn(a), to_dyn(b), op))
        return Ex(BOOL_KIND, _none())

    return compare


def same_term(a: Ex, b: Ex) -> Ex:
    if a.kind == b.kind and a.kind.name != "dyn":
        return Ex(BOOL_KIND, a.col == b.col)
    if {a.kind.name, b.kind.name} == {"iri"}:
        return Ex(BOOL_KIND, _iri_equal(a, b))
    if "dyn" not in (a.kind.name, b.kind.name):  # kinds that differ have no term in common
        return Ex(BOOL_KIND, _both(a, b, F.lit(False)))
    x, y = to_dyn(a), to_dyn(b)
    return Ex(BOOL_KIND, F.when(x.isNotNull() & y.isNotNull(), key_of(x) == key_of(y)))


def _exact(op: str, a: Column, b: Column) -> Column:
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](a, b)


def _floating(op: str, a: Column, b: Column) -> Column:
    if op == "/":
        zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
        return F.when(b == 0, zero).otherwise(F.try_divide(a, b))
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def _arithmetic(op: str) -> Callable[[Ex, Ex], Ex]:
    def compute(a: Ex, b: Ex) -> Ex:
        if a.kind.numeric and b.kind.numeric:
            x, y, common = _numbers(a, b)
            if common == "dbl":
                return Ex(DBL_KIND, _floating(op, x, y))
            if common == "dec" or op == "/":
                return Ex(DEC_KIND, _exact(op, x.cast(DECIMAL), y.cast(DECIMAL)).try_cast(DECIMAL))
            return Ex(INT_KIND, _exact(op, x, y))
        if "dyn" not in (a.kind.name, b.kind.name) or not all(x.kind.numeric or x.kind.name == "dyn" for x in (a, b)):
            return Ex(DBL_KIND, _none("double"))
        x, y = to_dyn(a), to_dyn(b)
        k = F.greatest(x["k"], y["k"])
        i = _exact(op, x["i"], y["i"]) if op != "/" else _none("bigint")
        d = _exact(op, decimal_of(x), decimal_of(y)).try_cast(DECIMAL)
        f = _floating(op, double_of(x), double_of(y))
        whole = (x["k"] == 0) & (y["k"] == 0) if op != "/" else F.lit(False)
        out = F.when(whole, to_dyn(Ex(INT_KIND, i))).when(k < 2, to_dyn(Ex(DEC_KIND, d))).otherwise(to_dyn(Ex(DBL_KIND, f)))
        return Ex(DYNAMIC, F.when((x["cat"] == NUMERIC) & (y["cat"] == NUMERIC), out))

    return compute


def negate(a: Ex) -> Ex:
    if a.kind.name == "int":
        return Ex(INT_KIND, F.try_subtract(F.lit(0).cast("bigint"), a.col))
    if a.kind.numeric:
        return Ex(Kind(a.kind.name, a.kind.datatype), -a.col)
    return _arithmetic("*")(Ex(INT_KIND, F.lit(-1).cast("bigint")), a)


def plus(a: Ex) -> Ex:
    if a.kind.numeric:
        return a
    return Ex(DYNAMIC, F.when(a.col["cat"] == NUMERIC, a.col)) if a.kind.name == "dyn" else Ex(DBL_KIND, _none("double"))


def _is(*names: str, low: int, high: int) -> Callable[[Ex], Ex]:
    def test(a: Ex) -> Ex:
        if a.kind.name == "dyn":
            return Ex(BOOL_KIND, a.col["cat"].between(low, high))
        return Ex(BOOL_KIND, F.when(a.col.isNotNull(), F.lit(a.kind.name in names or "literal" in names and a.kind.literal)))

    return test


def str_(a: Ex) -> Ex:
    if a.kind.name == "bnode":
        return Ex(SIMPLE_KIND, _none("string"))
    if a.kind.name == "dyn":
        return Ex(SIMPLE_KIND, F.when(a.col["cat"] >= IRI, a.col["lex"]))
    return Ex(SIMPLE_KIND, lexical(a))


def lang(a: Ex) -> Ex:
    """The tag; empty for literals without one."""
    if a.kind.name == "lang":
        return Ex(SIMPLE_KIND, a.col["lang"])
    if a.kind.name == "dyn":
        return Ex(SIMPLE_KIND, F.when(a.col["cat"] == LANG, a.col["tag"]).when(a.col["cat"] >= SIMPLE, ""))
    return Ex(SIMPLE_KIND, F.when(a.col.isNotNull(), "") if a.kind.literal else _none("string"))


def datatype(a: Ex) -> Ex:
    if a.kind.name == "dyn":
        return Ex(FULL_IRI, F.when(a.col["cat"] == SIMPLE, XSD + "string").when((a.col["cat"] > SIMPLE) & (a.col["cat"] != LANG), a.col["tag"]))
    if a.kind.literal and a.kind.name != "lang":
        return Ex(FULL_IRI, F.when(a.col.isNotNull(), F.lit(a.kind.datatype or XSD + "string")))
    return Ex(FULL_IRI, _none("string"))


def _simple(a: Ex) -> Column:
    """The text of a simple literal, NULL for other terms."""
    if a.kind.name == "simple":
        return a.col
    return F.when(a.col["cat"] == SIMPLE, a.col["lex"]) if a.kind.name == "dyn" else _none("string")


def lang_matches(tag: Ex, wanted: Ex) -> Ex:
    t, w = F.lower(_simple(tag)), F.lower(_simple(wanted))
    return Ex(BOOL_KIND, F.when(w == "*", t != "").otherwise((t == w) | F.startswith(t, F.concat(w, F.lit("-")))))


def _compiles(pattern: str) -> bool:
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def regex(text: Ex, pattern: Ex, flags: Ex | None = None, fixed: list[str] | None = None) -> Ex:
    """A partial match; flags i, s, m and x, others are an error, as is a pattern that doesn't compile. Text and pattern must be
    simple literals. fixed: pattern and flags where the query states them: they are tried when planning; a pattern of the data is
    tried for each row, which keeps such a filter from being pushed down."""
    p = _simple(pattern)
    if flags is not None:
        f = _simple(flags)
        inline = F.replace(f, F.lit("i"), F.lit("iu"))
        p = F.when(f == "", p).when(f.rlike("^[ismx]+$"), F.concat(F.lit("(?"), inline, F.lit(")"), p))
    if fixed is None:
        p = F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), p).isNotNull(), p)
    elif fixed and not _compiles(fixed[0] if len(fixed) < 2 or "x" not in fixed[1] else f"(?x){fixed[0]}"):
        return Ex(BOOL_KIND, _none("boolean"))
    return Ex(BOOL_KIND, F.rlike(_simple(text), p))


FUNCTIONS: dict[str, Callable[..., Ex]] = {
    "=": equals,
    "!=": lambda a, b: Ex(BOOL_KIND, ~equals(a, b).col),
    **{op: _ordered(op) for op in ("<", "<=", ">", ">=")},
    **{op: _arithmetic(op) for op in "+-*/"},
    "negate": negate,
    "plus": plus,
    "sameterm": same_term,
    "isiri": _is("iri", low=IRI, high=IRI),
    "isuri": _is("iri", low=IRI, high=IRI),
    "isblank": _is("bnode", low=0, high=0),
    "isliteral": _is("literal", low=SIMPLE, high=99),
    "str": str_,
    "lang": lang,
    "datatype": datatype,
    "langmatches": lang_matches,
    "regex": regex,
}
