"""What a source of triples offers to the planner."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from triplane.functions.terms import Kind
from triplane.operators.solutions import Solutions
from triplane.plans.ast import Triple


class TripleSource(Protocol):
    spark: SparkSession

    def known(self, triple: Triple) -> bool:
        """False if the pattern's constants show that nothing matches."""

    def stars(self, triples: list[Triple]) -> list[list[Triple]]:
        """Patterns partitioned into those that one scan can answer together."""

    def match(self, star: list[Triple], bound: dict[str, Kind] | None = None) -> Solutions:
        """The solutions of one such part; without those that can't join what is already bound, as far as kinds tell."""

    def estimate(self, star: list[Triple]) -> float:
        """About how many solutions it has."""

    def decode(self, solutions: Solutions, variables: set[str]) -> Solutions:
        """The same solutions with these variables' terms at hand for expressions."""

    def counts(self) -> DataFrame:
        """(predicate, triples)."""
