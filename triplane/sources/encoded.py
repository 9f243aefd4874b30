"""A dictionary-encoded store: Parquet tables made once from statements.

``terms(id, cat, lex, tag)``: every distinct term; ids ascend in the order of terms, so sorting, DISTINCT and joins work on
BIGINT and terms are looked up late. ``triples/p=<id>`` sorted by subject and ``inverse/p=<id>`` sorted by object: a pattern
reads the partition of its predicate, and row groups by their bounds. ``stats``: triples, subjects and objects of each predicate.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.functions.terms import DYNAMIC, ID, IRI, XSD, Ex, Kind, Term, dyn_from_lexical, sort_keys
from triplane.operators.solutions import Solutions, column_name
from triplane.plans.ast import Const, QueryError, Triple, Var
from triplane.sources.shared import delete, tidy

FORMAT, VERSION = "triplane-store", 1
#: Predicates whose ids are broadcast while a store is built, at most.
BROADCAST_PREDICATES = 100_000
#: A store of many statements is built in so many slices, of so many statements at least.
SLICES, SLICE_ROWS = 8, 5_000_000


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _slices(rows: int) -> int:
    """Slices in which a step runs, so that shuffle files are a share of what it moves: one for small tables."""
    return max(1, min(SLICES, rows // SLICE_ROWS))


def build(spark: SparkSession, statements: DataFrame | Iterable[DataFrame], path: str, force: bool = False) -> EncodedStore:
    """Writes a store. A store that is there already is an error unless ``force``. Statements that repeat count once. Of several
    tables of statements the next is asked for when the one before has been read, so its source may go then."""
    fs, where = _fs(spark, path)
    if fs.exists(where):
        if not force:
            raise FileExistsError(path)
        fs.delete(where, True)
    with tidy(spark):
        _build(spark, [statements] if isinstance(statements, DataFrame) else statements, path)
    stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta.json"), True)
    stream.write(bytearray(json.dumps({"format": FORMAT, "version": VERSION}).encode()))
    stream.close()
    return EncodedStore(spark, path)


def _build(spark: SparkSession, tables: Iterable[DataFrame], path: str) -> None:
    """Every step writes its result, and no shuffle file outlasts its step. Wide steps run in slices."""
    drop = lambda folder: delete(spark, f"{path}/{folder}")

    def write(df: DataFrame, folder: str, *by: str) -> None:
        df.write.mode("append").option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{folder}")

    # in the order they come in, where subjects and predicates of neighbours repeat and compress
    for table in tables:
        write(table.select("s_cat", "s_lex", "p_lex", "o_cat", "o_lex", "o_tag"), "_raw")
    rows = spark.read.parquet(f"{path}/_raw")
    slices = _slices(rows.count())
    sliced = lambda df, i, *by: df if slices == 1 else df.where(F.pmod(F.xxhash64(*by), F.lit(slices)) == i)
    subjects = rows.select(F.col("s_cat").alias("cat"), F.col("s_lex").alias("lex"), F.lit("").alias("tag"))
    predicates = rows.select(F.lit(IRI).alias("cat"), F.col("p_lex").alias("lex"), F.lit("").alias("tag"))
    objects = rows.select(F.col("o_cat").alias("cat"), F.col("o_lex").alias("lex"), F.col("o_tag").alias("tag"))
    types = objects.where("cat > 2 and tag <> '' and cat <> 7").select(F.lit(IRI).alias("cat"), F.col("tag").alias("lex"), F.lit("").alias("tag"))
    fixed = spark.createDataFrame([(IRI, XSD + t, "") for t in ("string", "boolean", "integer", "decimal", "double", "dateTime")], "cat int, lex string, tag string")
    every = reduce(DataFrame.unionByName, [subjects, predicates, objects, types, fixed])
    keys = {f"k{i}": k for i, k in enumerate(sort_keys(Ex(DYNAMIC, F.col("term"))))}
    for i in range(slices):
        typed = sliced(every, i, "lex").distinct().withColumn("term", dyn_from_lexical(F.col("cat"), F.col("lex"), F.col("tag")))
        write(typed.select("cat", "lex", "tag", *[k.alias(name) for name, k in keys.items()]), "_terms")
    ranged = spark.read.parquet(f"{path}/_terms").repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the number holds the partition, then the row in it: ascending, for partitions are ranges in order
    write(ranged.select((F.monotonically_increasing_id() + 1).alias("id"), "cat", "lex", "tag"), "terms")
    drop("_terms")
    terms = spark.read.parquet(f"{path}/terms")

    def ids(name: str, *on: tuple[str, str]) -> DataFrame:
        return terms.select(F.col("id").alias(name), *[F.col(a).alias(b) for a, b in on])

    # predicates are few and hot: a shuffle by them would be skewed
    used = rows.select("p_lex").distinct()
    p_ids = ids("p", ("lex", "p_lex"), ("cat", "p_cat")).where(F.col("p_cat") == IRI).join(used, "p_lex", "left_semi").select("p", "p_lex")
    p_ids = F.broadcast(p_ids) if used.count() <= BROADCAST_PREDICATES else p_ids
    s_ids, o_ids = ids("s", ("cat", "s_cat"), ("lex", "s_lex")).where("s_cat <= 1"), ids("o", ("cat", "o_cat"), ("lex", "o_lex"), ("tag", "o_tag"))
    for i in range(slices):
        triples = sliced(rows, i, "s_lex").join(p_ids, "p_lex").join(sliced(s_ids, i, "s_lex"), ["s_cat", "s_lex"]).select("p", "s", "o_cat", "o_lex", "o_tag")
        write(triples.join(o_ids, ["o_cat", "o_lex", "o_tag"]).select("s", "o", "p"), "_ids", "p")
    drop("_raw")
    triples = spark.read.schema("s bigint, o bigint, p bigint").parquet(f"{path}/_ids")
    for group in _groups({r["p"]: r["count"] for r in triples.groupBy("p").count().collect()}):
        some = triples.where(F.col("p").isin(group)) if group else triples
        for name, by, other in (("triples", "s", "o"), ("inverse", "o", "s")):
            # equal statements are in one range
            write(some.repartitionByRange("p", by).dropDuplicates(["p", by, other]).sortWithinPartitions("p", by).select("s", "o", "p"), name, "p")
        for p in group:
            drop(f"_ids/p={p}")
    written = spark.read.schema("s bigint, o bigint, p bigint").parquet(f"{path}/triples")
    # one column at a time, each of its own layout, where values that repeat are neighbours: rows of both would be shuffled twice over
    inverse = spark.read.schema("s bigint, o bigint, p bigint").parquet(f"{path}/inverse")
    subjects = written.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("subjects"))
    write(subjects.join(inverse.groupBy("p").agg(F.countDistinct("o").alias("objects")), "p"), "stats")
    drop("_ids")


def _groups(rows: dict[int, int]) -> list[list[int]]:
    """Predicates in groups of about as many triples; none, or more than are worth naming, are one group, the empty list."""
    if not 0 < len(rows) <= BROADCAST_PREDICATES:
        return [[]]
    least, out, held = sum(rows.values()) / _slices(sum(rows.values())), [], 0.0
    for p, n in sorted(rows.items()):
        if not out or held + n > least:
            out.append([])
            held = 0
        out[-1].append(p)
        held += n
    return out


class EncodedStore:
    def __init__(self, spark: SparkSession, path: str):
        fs, where = _fs(spark, f"{path}/meta.json")
        if not fs.exists(where):
            raise QueryError(f"no store at {path}")
        meta = json.loads(spark.read.text(f"{path}/meta.json", wholetext=True).first()[0])
        if (meta.get("format"), meta.get("version")) != (FORMAT, VERSION):
            raise QueryError(f"not a store of version {VERSION}: {path}")
        self.spark, self.path = spark, path
        self._ids: dict[Term, int | None] = {}

    @cached_property
    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    @cached_property
    def triples(self) -> DataFrame:
        return self.spark.read.schema("s bigint, o bigint, p bigint").parquet(f"{self.path}/triples")

    @cached_property
    def inverse(self) -> DataFrame:
        return self.spark.read.schema("s bigint, o bigint, p bigint").parquet(f"{self.path}/inverse")

    @cached_property
    def stats(self) -> dict[int, tuple[int, int, int]]:
        """One row a predicate."""
        return {r["p"]: (r["n"], r["subjects"], r["objects"]) for r in self.spark.read.parquet(f"{self.path}/stats").collect()}

    # the dictionary

    def resolve(self, *wanted: Term) -> list[int | None]:
        """Ids of terms, None for absent ones. The filter reaches the scan."""
        new = [t for t in dict.fromkeys(wanted) if t not in self._ids]
        if new:
            same = [(F.col("cat") == t.cat) & (F.col("lex") == t.lex) & (F.col("tag") == t.tag) for t in new]
            found = {Term(r["cat"], r["lex"], r["tag"]): r["id"] for r in self.terms.where(reduce(lambda a, b: a | b, same)).collect()}
            self._ids.update({t: found.get(t) for t in new})
        return [self._ids[t] for t in wanted]

    def lookup(self, id_: int) -> Term | None:
        r = self.terms.where(F.col("id") == id_).first()
        return Term(r["cat"], r["lex"], r["tag"]) if r else None

    def count(self, s: Term | None = None, p: Term | None = None, o: Term | None = None) -> int:
        """Triples that match; None matches anything."""
        ids = self.resolve(*[t for t in (s, p, o) if t is not None])
        if None in ids:
            return 0
        if s is None and o is None:
            return self.stats.get(ids[0], (0,))[0] if p is not None else sum(n for n, _, _ in self.stats.values())
        table = self.inverse if s is None else self.triples
        bound = iter(ids)
        for name, t in (("s", s), ("p", p), ("o", o)):
            if t is not None:
                table = table.where(F.col(name) == next(bound))
        return table.count()

    # the planner's interface

    def known(self, triple: Triple) -> bool:
        return None not in self.resolve(*[x.term for x in triple.slots if isinstance(x, Const)])

    def stars(self, triples: list[Triple]) -> list[list[Triple]]:
        return [[t] for t in triples]

    def match(self, star: list[Triple], bound: dict[str, Kind] | None = None) -> Solutions:
        (t,) = star
        df = self.inverse if isinstance(t.o, Const) and not isinstance(t.s, Const) else self.triples
        first: dict[str, str] = {}
        conditions: list[Column] = []
        for name, slot in zip("spo", t.slots, strict=True):
            if isinstance(slot, Const):
                conditions.append(F.col(name) == self.resolve(slot.term)[0])
            elif slot.name in first:
                conditions.append(F.col(first[slot.name]) == F.col(name))
            else:
                first[slot.name] = name
        for c in conditions:
            df = df.where(c)
        cols = [F.col(c).alias(column_name(v)) for v, c in first.items()]
        return Solutions(df.select(F.lit(True).alias("unit"), *cols), dict.fromkeys(first, ID), frozenset(first))

    def estimate(self, star: list[Triple]) -> float:
        (t,) = star
        if isinstance(t.p, Var):
            n, subjects, objects = (sum(x) for x in zip(*self.stats.values(), strict=True)) if self.stats else (0, 1, 1)
        else:
            n, subjects, objects = self.stats.get(self.resolve(t.p.term)[0], (0, 1, 1))
        return n / (max(1, subjects) if isinstance(t.s, Const) else 1) / (max(1, objects) if isinstance(t.o, Const) else 1)

    def decode(self, solutions: Solutions, variables: set[str]) -> Solutions:
        """Joins terms for variables held as ids."""
        out, kinds = solutions.df, dict(solutions.kinds)
        for v in sorted(variables):
            if kinds.get(v) != ID:
                continue
            name = column_name(v)
            terms = self.terms.select(F.col("id").alias(name), dyn_from_lexical(F.col("cat"), F.col("lex"), F.col("tag")).alias("term_"))
            how = "inner" if v in solutions.certain else "left"
            rest = [c for c in out.columns if c != name]
            out = out.join(terms, name, how).select(*rest, F.col("term_").alias(name))
            kinds[v] = DYNAMIC
        return Solutions(out, kinds, solutions.certain)

    def counts(self) -> DataFrame:
        stats = self.spark.read.parquet(f"{self.path}/stats").withColumnRenamed("p", "id")
        return stats.join(self.terms, "id").select(F.col("lex").alias("predicate"), F.col("n").alias("triples"))


__all__ = ["EncodedStore", "build"]
