"""Joins of solution tables by compatible bindings, and unions.

Two solutions are compatible if they agree on every variable that both bind. For variables that both sides surely bind this
is an equi-join. A variable that may be unbound on a side splits the join into its cases (both bound and equal, left
unbound, right unbound), each an equi-join on what remains, so no plan compares all pairs where a key is at hand.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.functions.terms import Ex
from triplane.operators.solutions import Solutions, column_name, common_kind, disjoint, same

Condition = Callable[[dict[str, Ex]], Column] | None
_BOTH, _LEFT, _RIGHT = "both", "left unbound", "right unbound"


def _aligned(a: Solutions, b: Solutions) -> tuple[Solutions, Solutions, list[str], list[str], DataFrame]:
    """Both sides with shared variables of one kind; shared variables that are certain, and others; the right side with its
    shared columns renamed."""
    shared = sorted(a.variables & b.variables)
    kinds = {v: common_kind(a.kinds[v], b.kinds[v]) for v in shared}
    x, y = a.as_kinds(kinds), b.as_kinds(kinds)
    sure = [v for v in shared if v in a.certain and v in b.certain]
    right = y.df.drop("unit").withColumnsRenamed({column_name(v): "r_" + column_name(v) for v in shared})
    return x, y, sure, [v for v in shared if v not in sure], right


def _equal(s: Solutions, v: str) -> Column:
    name = column_name(v)
    return same(s.kinds[v], F.col(name), F.col("r_" + name))


def _cases(x: Solutions, y: Solutions, sure: list[str], maybe: list[str], never: set[str]):
    """For each combination of bound and unbound doubtful variables: conditions on the left, on the right and on both."""
    for combination in product((_BOTH, _LEFT, _RIGHT), repeat=len(maybe)):
        left: list[Column] = []
        right: list[Column] = []
        keys = [_equal(x, v) for v in sure]
        possible = True
        for v, case in zip(maybe, combination, strict=True):
            l, r = F.col(column_name(v)), F.col("r_" + column_name(v))
            if case == _BOTH:
                possible &= v not in never
                keys.append(_equal(x, v))
            elif case == _LEFT:
                possible &= v not in x.certain
                left.append(l.isNull())
            else:
                possible &= v not in y.certain
                left.append(l.isNotNull())
                right.append(r.isNull())
        if possible:
            yield left, right, keys


def _and(parts: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, parts, F.lit(True)) if len(parts) != 1 else parts[0]


def _merged_env(x: Solutions, y: Solutions, maybe: list[str]) -> dict[str, Ex]:
    """Expressions over a joined row before its shared columns are merged."""
    env = y.env() | x.env()
    for v in maybe:
        name = column_name(v)
        env[v] = Ex(x.kinds[v], F.coalesce(F.col(name), F.col("r_" + name)))
    return env


def _never(a: Solutions, b: Solutions) -> set[str]:
    return {v for v in a.variables & b.variables if disjoint(a.kinds[v], b.kinds[v])}


#: Rows of a key that a task meets at once, of either side.
PIECE = 2048


def _spread(l: DataFrame, r: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both sides of a join on equal columns, with which a key's rows meet in many tasks: each side's rows of a key are cut into
    pieces, and every piece of one meets every piece of the other. Keys of few rows stay whole. Shuffled by number, for a join
    of few keys has small input and a result that isn't, which adaptive execution would give to one task."""
    named = [f"key_{i}" for i in range(len(pairs))]

    def counted(df: DataFrame, cols: list[str], n: str) -> DataFrame:
        return df.groupBy(*[F.col(c).alias(k) for c, k in zip(cols, named, strict=True)]).agg(F.ceil(F.count(F.lit(1)) / PIECE).alias(n))

    left, right = ([p[i] for p in pairs] for i in (0, 1))
    many = counted(l, left, "pieces_l").join(counted(r, right, "pieces_r"), named).where("pieces_l > 1 or pieces_r > 1")

    def cut(df: DataFrame, cols: list[str], own: str, other: str, to: tuple[str, str]) -> DataFrame:
        found = df.withColumn("row_hash", F.xxhash64(*df.columns)).join(many, [F.col(c) == F.col(k) for c, k in zip(cols, named, strict=True)], "left")
        mine = F.pmod("row_hash", F.coalesce(own, F.lit(1))).alias(to[0])
        return found.select(*df.columns, mine, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(other, F.lit(1)) - 1)).alias(to[1]))

    x, y = cut(l, left, "pieces_l", "pieces_r", ("at_l", "at_r")), cut(r, right, "pieces_r", "pieces_l", ("r_at_r", "r_at_l"))
    spark = l.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return x.repartition(tasks, *left, "at_l", "at_r"), y.repartition(tasks, *right, "r_at_l", "r_at_r"), [F.col("at_l") == F.col("r_at_l"), F.col("at_r") == F.col("r_at_r")]


def inner_join(a: Solutions, b: Solutions, spread: bool = False, same_terms: list[tuple[str, str]] = ()) -> Solutions:
    """spread: a key may have many rows on both sides. same_terms: variables of the left and the right side, of one kind and bound
    in both, that a condition on the result makes equal."""
    never = _never(a, b)
    x, y, sure, maybe, right = _aligned(a, b)
    kinds, certain = y.kinds | x.kinds, x.certain | y.certain

    def finish(df: DataFrame) -> DataFrame:
        merged = {column_name(v): F.coalesce(F.col(column_name(v)), F.col("r_" + column_name(v))) for v in maybe}
        return df.withColumns(merged).drop(*["r_" + column_name(v) for v in [*sure, *maybe]]) if merged or sure else df

    if never & set(sure):
        return Solutions(finish(x.df.crossJoin(right).where(F.lit(False))), kinds, certain)
    tables = []
    for left_only, right_only, keys in _cases(x, y, sure, maybe, never):
        l, r = x.df.where(_and(left_only)) if left_only else x.df, right.where(_and(right_only)) if right_only else right
        pairs = [(column_name(v), "r_" + column_name(v)) for v in sure] + [(column_name(v), column_name(w)) for v, w in same_terms]
        keys = keys + [F.col(column_name(v)) == F.col(column_name(w)) for v, w in same_terms]
        if spread and pairs and not maybe and all(x.kinds[v].name not in ("dyn", "lang") for v in [*sure, *(v for v, _ in same_terms)]):
            l, r, pieces = _spread(l, r, pairs)
            tables.append(finish(l.join(r, _and(keys + pieces), "inner").drop("at_l", "at_r", "r_at_l", "r_at_r")))
            continue
        tables.append(finish(l.join(r, _and(keys), "inner") if keys else l.crossJoin(r)))
    if not tables:
        return Solutions(finish(x.df.crossJoin(right).where(F.lit(False))), kinds, certain)
    return Solutions(reduce(DataFrame.unionByName, tables), kinds, certain)


def difference(a: Solutions, b: Solutions, condition: Condition = None) -> Solutions:
    """Left solutions without a compatible right one that meets the condition: an anti-join for each case."""
    never = _never(a, b)
    x, y, sure, maybe, right = _aligned(a, b)
    out = x.df
    if not never & set(sure):
        extra = [condition(_merged_env(x, y, maybe))] if condition else []
        for left_only, right_only, keys in _cases(x, y, sure, maybe, never):
            r = right.where(_and(right_only)) if right_only else right
            out = out.join(r, _and([*keys, *left_only, *extra]), "left_anti")
    return Solutions(out, x.kinds, x.certain)


def left_join(a: Solutions, b: Solutions, condition: Condition = None) -> Solutions:
    """Each left solution extended by every compatible right one that meets the condition; by itself if there is none."""
    never = _never(a, b)
    x, y, sure, maybe, right = _aligned(a, b)
    kinds = y.kinds | x.kinds
    if not maybe:
        on = [_equal(x, v) for v in sure] + ([condition(_merged_env(x, y, []))] if condition else [])
        if never & set(sure):
            on = [F.lit(False)]
        df = x.df.join(right, _and(on), "left").drop(*["r_" + column_name(v) for v in sure])
        return Solutions(df, kinds, x.certain)
    matched = inner_join(a, b)
    if condition:
        matched = matched.where(condition(matched.env()))
    alone = difference(a, b, condition)
    return union(matched, alone, x.certain)


def union(a: Solutions, b: Solutions, certain: frozenset[str] | None = None) -> Solutions:
    """All solutions of both, repeats kept; variables that one side lacks are unbound there."""
    kinds = {v: common_kind(a.kinds.get(v, b.kinds.get(v)), b.kinds.get(v, a.kinds.get(v))) for v in [*a.kinds, *(v for v in b.kinds if v not in a.kinds)]}
    x, y = a.as_kinds(kinds), b.as_kinds(kinds)
    cols = [column_name(v) for v in kinds]
    # a column of its own keeps solutions that bind nothing
    left, right = (s.df.select(F.lit(True).alias("unit"), *[column_name(v) for v in s.kinds]) for s in (x, y))
    df = left.unionByName(right, allowMissingColumns=True).select("unit", *cols)
    return Solutions(df, kinds, certain if certain is not None else a.certain & b.certain)
