"""Command line: ``python -m triplane load|query|serve|info``.

load STORE FILE [-s SYNTAX] [-f]    builds a store from an RDF file; -f replaces one that is there
query STORE FILE [-x]               runs the query in FILE, as text lines or XML, then prints times on standard error
serve STORE [-p PORT] [-v]          answers queries over HTTP
info STORE [-T] [-V] [-v ID]        counts; all triples; all terms; one term
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

from triplane import inspector
from triplane.plans.ast import QueryError
from triplane.results import text_lines, xml_chunks
from triplane.server import serve
from triplane.sources.encoded import EncodedStore, build
from triplane.sources.files import SYNTAXES, read_statements


def _arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="triplane")
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load")
    load.add_argument("store")
    load.add_argument("file")
    load.add_argument("-s", "--syntax", choices=SYNTAXES)
    load.add_argument("-f", "--force", action="store_true")
    query = commands.add_parser("query")
    query.add_argument("store")
    query.add_argument("file")
    query.add_argument("-x", "--xml", action="store_true")
    server = commands.add_parser("serve")
    server.add_argument("store")
    server.add_argument("-p", "--port", type=int, default=8000)
    server.add_argument("-v", "--verbose", action="store_true")
    info = commands.add_parser("info")
    info.add_argument("store")
    info.add_argument("-T", "--triples", action="store_true")
    info.add_argument("-V", "--terms", action="store_true")
    info.add_argument("-v", "--term", type=int)
    return parser.parse_args(argv)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName("triplane").getOrCreate()
    began = time.perf_counter()
    try:
        if args.command == "load":
            if "://" not in args.file and not Path(args.file).exists():
                print(f"no such file: {args.file}", file=sys.stderr)
                return 2
            build(spark, read_statements(spark, args.file, args.syntax), args.store, args.force)
            return 0
        store = EncodedStore(spark, args.store)
        opened = time.perf_counter()
        if args.command == "query":
            text = Path(args.file).read_text()
            found = 0
            if args.xml:
                for chunk in xml_chunks(store, text):
                    sys.stdout.write(chunk)
            else:
                for row in text_lines(store, text).toLocalIterator():
                    found += 1
                    print(row["value"])
                print(f"found {found}", file=sys.stderr)
            print(f"open {opened - began:.3f} s, query {time.perf_counter() - opened:.3f} s", file=sys.stderr)
        elif args.command == "serve":
            serve(store, port=args.port, verbose=args.verbose).serve_forever()
        elif args.term is not None:
            print(inspector.term(store, args.term))
        else:
            table = inspector.triples(store) if args.triples else inspector.terms(store) if args.terms else inspector.summary(store)
            for row in table.toLocalIterator():
                print(*row)
    except FileExistsError as error:
        print(f"there is a store already: {error}", file=sys.stderr)
        return 1
    except QueryError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
