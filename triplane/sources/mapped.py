"""A virtual graph over relational tables: each row a subject, each column a predicate, nothing copied.

Columns keep their types, so filters and projections reach the scan. All patterns on one subject and table are answered by
one scan instead of self-joins.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplane.functions.expressions import same_term
from triplane.functions.terms import BLANK, DEC_KIND, DYNAMIC, FULL_IRI, IRI, LANG, SIMPLE, SIMPLE_KIND, XSD, Ex, Kind, Term, canonical, constant, kind_of, to_dyn
from triplane.operators.joins import union
from triplane.operators.solutions import Solutions, column_name, disjoint, empty
from triplane.plans.ast import Const, QueryError, Slot, Triple, Var


@dataclass(frozen=True)
class Link:
    """A predicate whose objects are the subjects of another table."""

    column: str
    prefix: str


@dataclass(frozen=True)
class Table:
    """key: a column without repeats that names the row's IRI after ``prefix``; None: each row is a blank node.
    tagged: predicates whose text has the language in another column, as (text column, language column)."""

    df: DataFrame
    prefix: str
    key: str | None
    vocabulary: str
    links: dict[str, Link] = field(default_factory=dict)
    tagged: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def subject_kind(self) -> Kind:
        return Kind("iri" if self.key else "bnode", prefix=self.prefix)

    def predicates(self) -> dict[str, tuple[Kind, Column]]:
        """IRI of each predicate: kind and column of its objects."""
        out: dict[str, tuple[Kind, Column]] = {}
        for f in self.df.schema.fields:
            if (kind := _kind(f.dataType)) is not None:
                out[self.vocabulary + f.name] = kind, F.col(f"`{f.name}`")
        for name, link in self.links.items():
            out[self.vocabulary + name] = Kind("iri", prefix=link.prefix), F.col(f"`{link.column}`")
        for name, (text, lang) in self.tagged.items():
            both = F.col(text).isNotNull() & F.col(lang).isNotNull()
            out[self.vocabulary + name] = Kind("lang"), F.when(both, F.struct(F.col(text).alias("lex"), F.lower(F.col(lang)).alias("lang")))
        return out


def _kind(t: T.DataType) -> Kind | None:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind("int", XSD + "integer")
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return Kind("dbl", XSD + "double")
    if isinstance(t, T.DecimalType):
        return DEC_KIND
    if isinstance(t, T.StringType):
        return SIMPLE_KIND
    if isinstance(t, T.BooleanType):
        return Kind("bool", XSD + "boolean")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Kind("dt", XSD + "dateTime")
    return None  # arrays and other types have no terms


class MappedTables:
    def __init__(self, spark: SparkSession, tables: list[Table]):
        self.spark, self.tables = spark, tables

    @cached_property
    def where(self) -> dict[str, list[tuple[Table, Kind, Column]]]:
        out: dict[str, list[tuple[Table, Kind, Column]]] = {}
        for t in self.tables:
            for p, (kind, col) in t.predicates().items():
                out.setdefault(p, []).append((t, kind, col))
        return out

    # constants

    def _subject(self, table: Table, term: Term) -> Column | None:
        """The condition that a row's subject is the term; None if no row's is."""
        if not table.key or term.cat != IRI or not term.lex.startswith(table.prefix):
            return None
        return _key_is(table.df.schema[table.key].dataType, F.col(f"`{table.key}`"), term.lex[len(table.prefix) :])

    def _object(self, table: Table, predicate: str, kind: Kind, col: Column, term: Term) -> Column | None:
        if kind.name == "iri":
            if term.cat != IRI or not term.lex.startswith(kind.prefix):
                return None
            name = table.links[predicate.removeprefix(table.vocabulary)].column
            return _key_is(table.df.schema[name].dataType, col, term.lex[len(kind.prefix) :])
        if term.cat in (IRI, BLANK):
            return None
        if kind.name in ("simple", "lang"):
            if (term.cat == LANG) != (kind.name == "lang") or kind.name == "simple" and term.cat != SIMPLE:
                return None
            return col == term.lex if kind.name == "simple" else (col["lex"] == term.lex) & (col["lang"] == term.tag)
        # the same term: the datatype and the lexical form that the column's values print as
        if term.tag != kind.datatype or kind_of(term.tag) != kind.name or not canonical(term):
            return None
        return col == constant(term).col

    def known(self, triple: Triple) -> bool:
        return bool(self._candidates(triple))

    def _candidates(self, triple: Triple) -> list[tuple[str, Table, Kind, Column]]:
        if isinstance(triple.p, Const):
            found = [(triple.p.term.lex, *x) for x in self.where.get(triple.p.term.lex, [])]
        else:
            found = [(p, *x) for p, xs in self.where.items() for x in xs]
        if isinstance(triple.s, Const):
            found = [x for x in found if self._subject(x[1], triple.s.term) is not None]
        if isinstance(triple.o, Const):
            found = [x for x in found if self._object(x[1], x[0], x[2], x[3], triple.o.term) is not None]
        return found

    # the planner's interface

    def stars(self, triples: list[Triple]) -> list[list[Triple]]:
        out: dict[tuple, list[Triple]] = {}
        for i, t in enumerate(triples):
            found = self._candidates(t)
            fused = (t.s, id(found[0][1])) if isinstance(t.p, Const) and len(found) == 1 else (i,)
            out.setdefault(fused, []).append(t)
        # any cell of a row without a key: what else is known of the row is in the same scan, so its long rows aren't joined
        for table in (t for t in self.tables if not t.key and all(disjoint(t.subject_kind, x.subject_kind) for x in self.tables if x is not t)):
            for i, t in enumerate(triples):
                star = out.get((t.s, id(table)), [])
                if isinstance(t.p, Var) and isinstance(t.o, Var) and star and not isinstance(star[-1].p, Var) and (i,) in out:
                    star += out.pop((i,))
        return list(out.values())

    def match(self, star: list[Triple], bound: dict[str, Kind] | None = None) -> Solutions:
        candidates = [[c for c in self._candidates(t) if _joins(t, c[1].subject_kind, c[2], bound or {})] for t in star]
        variables = {v for t in star for v in t.variables()}
        if not all(candidates):
            return empty(self.spark, variables)
        if len(star) > 1 and isinstance(star[-1].p, Var):
            table = candidates[0][0][1]
            return self._scan(star[:-1], [c[0] for c in candidates[:-1]], star[-1], [c for c in candidates[-1] if c[1] is table])
        if len(star) > 1 or len(candidates[0]) == 1:
            return self._scan(star, [c[0] for c in candidates])
        (t,) = star
        if not (isinstance(t.p, Var) and isinstance(t.o, Var)):
            return reduce(union, [self._scan(star, [c]) for c in candidates[0]])
        tables = {id(c[1]): c[1] for c in candidates[0]}
        return reduce(union, [self._unpivot(t, table, [c for c in candidates[0] if c[1] is table]) for table in tables.values()])

    @staticmethod
    def keyed(table: Table) -> tuple[DataFrame, Column]:
        """The table and its subject column. A row without a key is named by its file and place there, so that every
        scan names it alike; rows of tables that aren't files have no such name and are an error."""
        if table.key:
            return table.df, F.col(f"`{table.key}`")
        try:
            return table.df.withColumn("row_", _row_name(table.df)), F.col("row_")
        except AnalysisException:
            raise QueryError(f"the rows of {table.prefix} have no key, and no place in files that could name them") from None

    def _unpivot(self, t: Triple, table: Table, found: list[tuple[str, Table, Kind, Column]]) -> Solutions:
        """Any predicate with any object: one scan of the table, a row for each cell."""
        df, subject = self.keyed(table)
        if isinstance(t.s, Const):
            df = df.where(self._subject(table, t.s.term))
        else:
            df = df.where(subject.isNotNull())
        cells = F.array(*[F.struct(F.lit(p).alias("p"), to_dyn(Ex(kind, col)).alias("o")) for p, _, kind, col in found])
        rows = df.select(subject.alias("s"), F.inline(cells)).where("o is not null")
        columns = [(t.s, Ex(table.subject_kind, F.col("s"))), (t.p, Ex(FULL_IRI, F.col("p"))), (t.o, Ex(DYNAMIC, F.col("o")))]
        bound: dict[str, Ex] = {}
        for slot, x in columns:
            if isinstance(slot, Const):
                continue
            if slot.name in bound:
                rows = rows.where(same_term(bound[slot.name], x).col)
            else:
                bound[slot.name] = x
        cols = [x.col.alias(column_name(v)) for v, x in bound.items()]
        return Solutions(rows.select(F.lit(True).alias("unit"), *cols), {v: x.kind for v, x in bound.items()}, frozenset(bound))

    def _scan(self, star: list[Triple], found: list[tuple[str, Table, Kind, Column]], free: Triple | None = None, cells: list[tuple[str, Table, Kind, Column]] = ()) -> Solutions:
        """Patterns with predicates, of one column each; free: one more with any predicate, and its columns."""
        table = found[0][1]
        df, subject = self.keyed(table)
        where: list[Column] = []
        bound: dict[str, Ex] = {}

        def bind(slot: Slot, x: Ex) -> None:
            assert isinstance(slot, Var)
            if slot.name in bound:
                where.append(same_term(bound[slot.name], x).col)
            else:
                bound[slot.name] = x

        s = star[0].s
        if isinstance(s, Const):
            where.append(self._subject(table, s.term))
        else:
            where.append(subject.isNotNull())
            bind(s, Ex(table.subject_kind, subject))
        for t, (p, _, kind, col) in zip(star, found, strict=True):
            if isinstance(t.p, Var):
                bind(t.p, Ex(FULL_IRI, F.lit(p)))
            if isinstance(t.o, Const):
                where.append(self._object(table, p, kind, col, t.o.term))
            else:
                where.append(col.isNotNull())  # a NULL cell is no triple
                bind(t.o, Ex(kind, col))
        df = df.where(reduce(lambda a, b: a & b, where)) if where else df
        cols = [x.col.alias(column_name(v)) for v, x in bound.items()]
        out = Solutions(df.select(F.lit(True).alias("unit"), *cols), {v: x.kind for v, x in bound.items()}, frozenset(bound))
        return out if free is None else self._with_cells(out, df, cols, free, cells)

    @staticmethod
    def _with_cells(out: Solutions, df: DataFrame, cols: list[Column], free: Triple, cells: list[tuple[str, Table, Kind, Column]]) -> Solutions:
        """Each row of a scan once for each of its cells, which bind the free pattern's predicate and object."""
        each = F.array(*[F.struct(F.lit(p).alias("cell_p"), to_dyn(Ex(kind, col)).alias("cell_o")) for p, _, kind, col in cells])
        rows, bound = df.select(F.lit(True).alias("unit"), *cols, F.inline(each)).where("cell_o IS NOT NULL"), out.env()
        for slot, x in ((free.p, Ex(FULL_IRI, F.col("cell_p"))), (free.o, Ex(DYNAMIC, F.col("cell_o")))):
            if slot.name in bound:
                rows = rows.where(same_term(bound[slot.name], x).col)
            else:
                bound[slot.name] = x
        return Solutions(rows.select("unit", *[x.col.alias(column_name(v)) for v, x in bound.items()]), {v: x.kind for v, x in bound.items()}, frozenset(bound))

    def estimate(self, star: list[Triple]) -> float:
        """Bytes of the table as Catalyst knows them, without a job; less for each constant."""
        found = [self._candidates(t) for t in star]
        if not all(found):
            return 0
        size = sum(float(x[1].df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for x in found[0])
        for t in star:
            size *= 0.02 if isinstance(t.o, Const) else 1
        return size / 1e6 if isinstance(star[0].s, Const) else size

    def decode(self, solutions: Solutions, variables: set[str]) -> Solutions:
        return solutions

    def counts(self) -> DataFrame:
        """One pass over each table."""
        out = []
        for t in self.tables:
            preds = t.predicates()
            row = t.df.agg(*[F.count(col).alias(f"c{i}") for i, (_, col) in enumerate(preds.values())])
            pairs = F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(f"c{i}").alias("triples")) for i, p in enumerate(preds)])
            out.append(row.select(F.inline(pairs)))
        return reduce(DataFrame.unionByName, out)


#: Bits of a file's number within a row's name: with them a file may have 2^38 rows.
FILE_BITS = 25


def one_slash(url: str) -> str:
    """A file's URL without an empty host: file:/a for file:///a."""
    return re.sub(r"^(\w+:)//(?=/)", r"\1", url)


def _row_name(df: DataFrame) -> Column:
    """A whole number for each row of a table of files: its place in the file times a power of two, plus the file's number. That
    is a hash of the path, as wide and with such a seed that no two files of the table share it. Tables of so many files that
    none is found have path and place as text."""
    spark = df.sparkSession
    listed = sorted(set(df.inputFiles()))
    paths = list(dict.fromkeys(form(x) for form in (str, one_slash) for x in listed))  # rows may have the second
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    least = max(0, (len(listed) - 1).bit_length())
    widths = [(b, seed) for b in range(least, min(2 * least, FILE_BITS) + 1) for seed in range(8)]
    number = lambda c, b, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << b))
    each = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(paths)), "\n")).alias("at", "path")).select("at", *[number(F.col("path"), b, seed).alias(f"n{i}") for i, (b, seed) in enumerate(widths)])
    found = [r[1:] for r in sorted(each.collect())] if paths else []
    for i, (b, seed) in enumerate(widths):
        if all(len({r[i] for r in rows}) == len(listed) for rows in (found[: len(listed)], found[-len(listed) :])):
            return row * F.lit(1 << b) + number(path, b, seed)
    return F.concat_ws("-", path, row)


def _joins(t: Triple, subject: Kind, object_: Kind, bound: dict[str, Kind]) -> bool:
    """Whether a pattern's terms of these kinds can be those that its variables are bound to."""
    return not any(isinstance(slot, Var) and slot.name in bound and disjoint(bound[slot.name], kind) for slot, kind in ((t.s, subject), (t.o, object_)))


def _key_is(t: T.DataType, col: Column, text: str) -> Column | None:
    if isinstance(t, T.StringType):
        return col == text
    if not text.isdecimal() or text != str(int(text)) or math.log10(int(text) + 1) > 18:
        return None
    return col == int(text)


VOCABULARY = "urn:t:"


_graphs: dict[tuple[str, str], MappedTables] = {}


def relational_graph(spark: SparkSession, folder: str, refresh: bool = False) -> MappedTables:
    """The mapping of the relational tables of a data folder, vocabulary ``urn:t:``. A session keeps it, with the files found
    at first use, like a table of its catalog; ``refresh`` looks again."""
    at = spark.sparkContext.applicationId, folder
    if refresh or at not in _graphs:
        _graphs[at] = _mapped(spark, folder)
    return _graphs[at]


def _mapped(spark: SparkSession, folder: str) -> MappedTables:
    v = VOCABULARY
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    subject = {"region": "region/", "nation": "nation/", "customer": "customer/", "supplier": "supplier/", "part": "part/", "orders": "order/", "events": "event/", "documents": "doc/"}
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
    links = {
        "nation": {"n_region": Link("n_regionkey", v + "region/")},
        "customer": {"c_nation": Link("c_nationkey", v + "nation/")},
        "supplier": {"s_nation": Link("s_nationkey", v + "nation/")},
        "orders": {"o_cust": Link("o_custkey", v + "customer/")},
        "lineitem": {"l_order": Link("l_orderkey", v + "order/"), "l_part": Link("l_partkey", v + "part/"), "l_supp": Link("l_suppkey", v + "supplier/")},
    }
    tagged = {"documents": {"tagged_text": ("text", "lang")}}
    out = []
    for name in [*subject, "lineitem"]:
        df = read(name)
        out.append(Table(df, v + subject[name] if name in subject else "lineitem", keys.get(name), v, links.get(name, {}), tagged.get(name, {})))
    return MappedTables(spark, out)
