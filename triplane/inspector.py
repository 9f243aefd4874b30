"""What a store holds: counts, triples, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.functions.terms import DYNAMIC, Ex, Term, dyn_from_lexical, format_term
from triplane.sources.encoded import EncodedStore


def summary(store: EncodedStore) -> DataFrame:
    """(item, n): triples, predicates and terms of each category."""
    names = F.array(*map(F.lit, ["blank nodes", "IRIs", "simple literals", "strings", "booleans", "numbers", "dateTimes", "tagged literals", "other literals"]))
    terms = store.terms.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).select(F.get(names, F.col("cat")).alias("item"), "n")
    sums = store.spark.read.parquet(f"{store.path}/stats").agg(F.sum("n").alias("triples"), F.count(F.lit(1)).alias("predicates"))
    return sums.select(F.inline(F.array(*[F.struct(F.lit(x).alias("item"), F.coalesce(x, F.lit(0)).alias("n")) for x in ("triples", "predicates")]))).unionByName(terms)


def triples(store: EncodedStore) -> DataFrame:
    """Every triple as a line of N-Triples. Ids become terms by three joins."""
    shown = store.terms.select("id", format_term(Ex(DYNAMIC, dyn_from_lexical(F.col("cat"), F.col("lex"), F.col("tag")))).alias("term"))
    out = store.triples
    for slot in "spo":
        out = out.join(shown.withColumnsRenamed({"id": slot, "term": f"{slot}_term"}), slot)
    return out.select(F.concat_ws(" ", "s_term", "p_term", "o_term", F.lit(".")).alias("value"))


def terms(store: EncodedStore) -> DataFrame:
    """(id, term) in the order of terms."""
    shown = format_term(Ex(DYNAMIC, dyn_from_lexical(F.col("cat"), F.col("lex"), F.col("tag"))))
    return store.terms.select("id", shown.alias("term")).orderBy("id")


def term(store: EncodedStore, id_: int) -> Term | None:
    return store.lookup(id_)
