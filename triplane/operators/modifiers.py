"""Solution modifiers: projection, DISTINCT, ORDER BY, LIMIT, OFFSET, ASK."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.functions.terms import DYN, DYNAMIC, ID, Ex, sort_keys
from triplane.operators.solutions import Solutions, column_name


def project(s: Solutions, variables: list[str], keep: list[str] = ()) -> Solutions:
    """Only these variables; ones that the pattern doesn't have are unbound. keep: more columns of the table."""
    cols = [F.col(column_name(v)) if v in s.kinds else F.lit(None).cast(DYN).alias(column_name(v)) for v in variables]
    df = s.df.select(*(cols or [F.lit(True).alias("unit")]), *keep)
    return Solutions(df, {v: s.kinds.get(v, DYNAMIC) for v in variables}, frozenset(v for v in variables if v in s.certain))


def order_columns(keys: list[tuple[Ex, bool]]) -> list[Column]:
    """Unbound and errors come first ascending, last descending."""
    out = []
    for x, down in keys:
        parts = [x.col] if x.kind == ID else sort_keys(x)
        if x.kind.name in ("dyn", "lang"):
            parts = [x.col.isNotNull(), *parts]
        out += [p.desc_nulls_last() if down else p.asc_nulls_first() for p in parts]
    return out


def distinct(s: Solutions) -> Solutions:
    return Solutions(s.df.distinct(), s.kinds, s.certain)


def distinct_ordered(s: Solutions, variables: list[str], keys: list[tuple[Ex, bool]]) -> DataFrame:
    """Distinct projected solutions in an order that may use other variables: a solution stands where its first row would."""
    columns = order_columns(keys)
    named = [(f"k{i}_{j}", p, down) for i, (x, down) in enumerate(keys) for j, p in enumerate(([x.col.isNotNull()] if x.kind.name in ("dyn", "lang") else []) + ([x.col] if x.kind == ID else sort_keys(x)))]
    assert len(named) == len(columns)
    table = project(s, variables, [p.alias(n) for n, p, _ in named]).df
    groups = [column_name(v) for v in variables] or ["unit"]
    firsts = [(F.max if down else F.min)(n).alias(n) for n, _, down in named]
    if len(named) > 1:
        # several keys: the least row by all of them, not the least of each
        one = F.row_number().over(_window(groups, named))
        table = table.withColumn("first", one).where("first = 1").drop("first")
    else:
        # an unbound key sorts first ascending, but min passes over NULL
        n, _, down = named[0]
        unbound = F.max(F.col(n).isNull())
        table = table.groupBy(*groups).agg(*(firsts if down else [F.when(~unbound, F.min(n)).alias(n)]))
    return table.orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, _, down in named])


def _window(groups: list[str], named: list[tuple[str, Column, bool]]):
    from pyspark.sql import Window

    return Window.partitionBy(*groups).orderBy(*[F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_first() for n, _, down in named])


def slice_(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
