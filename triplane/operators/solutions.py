"""Solution tables: a DataFrame with one column for each variable, and what is known of the variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.functions.terms import DYN, DYNAMIC, FULL_IRI, Ex, Kind, key_of, lexical, to_dyn


def column_name(variable: str) -> str:
    """A column for a variable: names of variables are case-sensitive and columns aren't."""
    upper = "".join("1" if c.isupper() else "0" for c in variable)
    name = ("a_" + variable[1:]) if variable.startswith(".") else "v_" + variable
    return name.lower().replace(".", "_dot_").replace("-", "_dash_") + (f"_{int(upper, 2):x}" if "1" in upper else "")


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    kinds: dict[str, Kind]
    certain: frozenset[str]

    @property
    def variables(self) -> set[str]:
        return set(self.kinds)

    def env(self) -> dict[str, Ex]:
        return {v: Ex(k, F.col(column_name(v))) for v, k in self.kinds.items()}

    def term(self, variable: str) -> Ex:
        return Ex(self.kinds[variable], F.col(column_name(variable)))

    def where(self, condition: Column) -> Solutions:
        return Solutions(self.df.where(condition), self.kinds, self.certain)

    def as_kinds(self, kinds: dict[str, Kind]) -> Solutions:
        """The same solutions with some columns converted."""
        change = {v: k for v, k in kinds.items() if v in self.kinds and self.kinds[v] != k}
        if not change:
            return self
        cols = {column_name(v): convert(self.term(v), k) for v, k in change.items()}
        return Solutions(self.df.withColumns(cols), self.kinds | change, self.certain)


def convert(x: Ex, kind: Kind) -> Column:
    if x.kind == kind:
        return x.col
    if kind.name == "dyn":
        return to_dyn(x)
    if kind == FULL_IRI and x.kind.name == "iri":
        return lexical(x)
    raise AssertionError(f"{x.kind} to {kind}")


def common_kind(a: Kind, b: Kind) -> Kind:
    if a == b:
        return a
    return FULL_IRI if a.name == b.name == "iri" else DYNAMIC


def disjoint(a: Kind, b: Kind) -> bool:
    """Whether no term is of both kinds, from what is known when planning."""
    if a == b or "dyn" in (a.name, b.name) or "id" in (a.name, b.name):
        return False
    if a.name == b.name == "iri":
        return bool(a.prefix and b.prefix) and not a.prefix.startswith(b.prefix) and not b.prefix.startswith(a.prefix)
    if a.name == b.name == "bnode":
        return a.prefix != b.prefix
    return a.name != b.name or a.datatype != b.datatype


def same(kind: Kind, a: Column, b: Column) -> Column:
    """Term identity of two columns of one kind, NULL where either is."""
    return key_of(a) == key_of(b) if kind.name == "dyn" else a == b


def unit(spark) -> Solutions:
    """One solution that binds nothing."""
    return Solutions(spark.range(1).select(F.lit(True).alias("unit")), {}, frozenset())


def empty(spark, variables: set[str]) -> Solutions:
    cols = [F.lit(None).cast(DYN).alias(column_name(v)) for v in sorted(variables)]
    return Solutions(spark.range(1).select(F.lit(True).alias("unit"), *cols).where(F.lit(False)), dict.fromkeys(sorted(variables), DYNAMIC), frozenset(variables))
