"""RDF files of any supported syntax as a DataFrame of statements."""

from __future__ import annotations

from hashlib import blake2b
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from triplane.plans.ast import Unsupported
from triplane.sources import ntriples
from triplane.sources.rdfxml import parse_rdfxml
from triplane.sources.turtle import parse_turtle

_BY_ENDING = {".nt": "ntriples", ".ttl": "turtle", ".rdf": "rdfxml", ".owl": "rdfxml", ".xml": "rdfxml"}
_PARSERS = {"turtle": parse_turtle, "rdfxml": parse_rdfxml}
#: Statements of a document that are held at once.
ROWS = 10_000
SYNTAXES = ("ntriples", *_PARSERS)


def syntax_of(path: str) -> str:
    """By the name's ending; N-Triples for others."""
    return next((s for ending, s in _BY_ENDING.items() if path.lower().endswith(ending)), "ntriples")


def read_statements(spark: SparkSession, path: str, syntax: str | None = None) -> DataFrame:
    syntax = syntax or syntax_of(path)
    if syntax not in SYNTAXES:
        raise Unsupported(f"syntax {syntax}")
    if syntax == "ntriples":
        return ntriples.read(spark, path)
    return documents(spark.read.format("binaryFile").load(path), syntax)


def documents(files: DataFrame, syntax: str) -> DataFrame:
    """The statements of documents (path, content): Turtle or RDF/XML in UTF-8, each parsed whole. Blank labels of one document
    stay apart from those of another."""
    parse = _PARSERS[syntax]

    def parsed(batches):
        for df in batches:
            for name, content in zip(df["path"], df["content"], strict=True):
                scope = blake2b(name.encode(), digest_size=6).hexdigest()
                rows = ((s.cat, s.lex, p.lex, o.cat, o.lex, o.tag) for s, p, o in parse(bytes(content).decode(), scope, name))
                while some := list(islice(rows, ROWS)):
                    yield pd.DataFrame(some, columns=["s_cat", "s_lex", "p_lex", "o_cat", "o_lex", "o_tag"])

    return files.select("path", "content").mapInPandas(parsed, ntriples.STATEMENT)
