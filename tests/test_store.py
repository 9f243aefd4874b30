"""The loaded store: formats, term order, three-valued logic, results, and random patterns against a naive evaluator."""

import random
import threading
from pathlib import Path
from itertools import product
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pytest

from triplane import inspector
from triplane.functions.terms import IRI, XSD, Term
from triplane.__main__ import main
from triplane.plans.ast import QueryError, Unsupported
from triplane.plans.planner import run
from triplane.results import text_lines, xml_chunks
from triplane.server import LONGEST_QUERY, serve
from triplane.sources.encoded import EncodedStore, build
from triplane.sources.files import read_statements
from triplane.sources import ntriples
from triplane.streaming.statements import drain, match_star, read_stream

TERMS = f"""
<urn:s> <urn:v> _:b .
<urn:s> <urn:v> <urn:i> .
<urn:s> <urn:v> "a" .
<urn:s> <urn:v> "b" .
<urn:s> <urn:v> "a"^^<{XSD}string> .
<urn:s> <urn:v> "false"^^<{XSD}boolean> .
<urn:s> <urn:v> "true"^^<{XSD}boolean> .
<urn:s> <urn:v> "-1"^^<{XSD}integer> .
<urn:s> <urn:v> "1.0"^^<{XSD}decimal> .
<urn:s> <urn:v> "1"^^<{XSD}integer> .
<urn:s> <urn:v> "2.5E0"^^<{XSD}double> .
<urn:s> <urn:v> "2020-01-01T00:00:00Z"^^<{XSD}dateTime> .
<urn:s> <urn:v> "2021-01-01T00:00:00"^^<{XSD}dateTime> .
<urn:s> <urn:v> "a"@en .
<urn:s> <urn:v> "a"@fr .
<urn:s> <urn:v> "x"^^<urn:dt> .
# a comment

<urn:s> <urn:v> "a" .
"""
PEOPLE = """@prefix : <urn:p/> . @base <urn:p/> .
<ann> :name "Ann" ; :age 30 ; :mail <mailto:ann> . <bob> :name "Bob" ; :knows <ann>, <cy> .
<cy> :name "Ann" ; :age 7.5 ; :likes [ :name "Thing" ] ."""
PEOPLE_XML = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="urn:p/" xml:base="urn:p/">
<rdf:Description rdf:about="urn:p/ann"><name>Ann</name><age rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">30</age><mail rdf:resource="mailto:ann"/></rdf:Description>
<rdf:Description rdf:about="urn:p/bob"><name>Bob</name><knows rdf:resource="urn:p/ann"/><knows rdf:resource="urn:p/cy"/></rdf:Description>
<rdf:Description rdf:about="urn:p/cy"><name>Ann</name><age rdf:datatype="http://www.w3.org/2001/XMLSchema#decimal">7.5</age><likes><rdf:Description><name>Thing</name></rdf:Description></likes></rdf:Description></rdf:RDF>"""


def stored(spark, folder, name, content, force=False):
    (folder / name).write_text(content)
    return build(spark, read_statements(spark, str(folder / name)), str(folder / (name + ".store")), force)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("rdf")


@pytest.fixture(scope="module")
def terms(spark, folder):
    return stored(spark, folder, "terms.nt", TERMS)


@pytest.fixture(scope="module")
def people(spark, folder):
    return stored(spark, folder, "people.ttl", PEOPLE)


def values(store, condition, form="terms"):
    return {r["v"] for r in run(store, f"PREFIX xsd: <{XSD}> SELECT ?v {{ ?s <urn:v> ?v FILTER({condition}) }}", form).collect()}


def test_terms_ascend_in_their_order(terms):
    got = [r["v"] for r in run(terms, "SELECT ?v { ?s <urn:v> ?v } ORDER BY ?v", "terms").collect()]
    expected = [line.split(" ", 2)[2].removesuffix(" .") for line in TERMS.strip().splitlines()[:16]]
    assert got == expected
    down = [r["v"] for r in run(terms, "SELECT ?v { ?s <urn:v> ?v } ORDER BY DESC(?v)", "terms").collect()]
    assert down == expected[::-1]


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ("?v = 1", {f'"1"^^<{XSD}integer>', f'"1.0"^^<{XSD}decimal>'}),
        ("sameTerm(?v, 1)", {f'"1"^^<{XSD}integer>'}),
        ("?v > 0", {f'"1"^^<{XSD}integer>', f'"1.0"^^<{XSD}decimal>', f'"2.5E0"^^<{XSD}double>'}),
        ('?v = "a"', {'"a"'}),
        ('?v != "a"', {'"b"', "<urn:i>", "_:b"}),  # literals of other types are errors
        ("isBLANK(?v)", {"_:b"}),
        ("isIRI(?v)", {"<urn:i>"}),
        ('LANGMATCHES(LANG(?v), "en")', {'"a"@en'}),
        ("DATATYPE(?v) = <urn:dt>", {'"x"^^<urn:dt>'}),
        ('STR(?v) = "a"', {'"a"', f'"a"^^<{XSD}string>', '"a"@en', '"a"@fr'}),
        ("?v", {'"a"', '"b"', f'"a"^^<{XSD}string>', f'"true"^^<{XSD}boolean>', f'"-1"^^<{XSD}integer>', f'"1"^^<{XSD}integer>', f'"1.0"^^<{XSD}decimal>', f'"2.5E0"^^<{XSD}double>', '"a"@en', '"a"@fr'}),
        ("!?v", {f'"false"^^<{XSD}boolean>'}),
        ("?v + 1 = 2", {f'"1"^^<{XSD}integer>', f'"1.0"^^<{XSD}decimal>'}),
        ("?v / 0 = 1", set()),
        ("?v / 0 = 1 || isIRI(?v)", {"<urn:i>"}),
        ("-?v < 0 && ?v * 2 >= 5", {f'"2.5E0"^^<{XSD}double>'}),
        ('REGEX(?v, "^A", "i")', {'"a"'}),
        ('?v < "2020-06-01T00:00:00Z"^^xsd:dateTime', {f'"2020-01-01T00:00:00Z"^^<{XSD}dateTime>'}),
        ("?unknown", set()),
        ("!BOUND(?unknown) && ?v = false", {f'"false"^^<{XSD}boolean>'}),
    ],
)
def test_three_valued_conditions(terms, condition, expected):
    assert values(terms, condition) == expected


def test_repeated_statements_count_once(terms):
    assert terms.count() == 16
    assert terms.count(p=Term(IRI, "urn:v"), o=Term(2, "a")) == 1
    assert terms.count(s=Term(IRI, "urn:none")) == 0


def test_formats_agree(spark, folder, people):
    other = stored(spark, folder, "people.rdf", PEOPLE_XML)
    query = "SELECT ?p ?n ?o { ?s <urn:p/name> ?n ; ?p ?o FILTER(!isBLANK(?o)) }"
    rows = [sorted(map(tuple, run(s, query, "terms").collect())) for s in (people, other)]
    assert rows[0] == rows[1] and len(rows[0]) == 9


def test_optional_union_distinct(people):
    p = "PREFIX : <urn:p/> "
    got = {tuple(r) for r in run(people, p + "SELECT ?n ?a { ?x :name ?n OPTIONAL { ?x :age ?a } }").collect()}
    assert got == {("Ann", "30"), ("Ann", "7.5"), ("Bob", None), ("Thing", None)}
    got = [tuple(r) for r in run(people, p + "SELECT DISTINCT ?n { ?x :name ?n } ORDER BY DESC(?n)").collect()]
    assert got == [("Thing",), ("Bob",), ("Ann",)]
    got = {tuple(r) for r in run(people, p + "SELECT ?n { ?x :name ?n OPTIONAL { ?x :age ?a } FILTER(!BOUND(?a)) }").collect()}
    assert got == {("Bob",), ("Thing",)}
    got = sorted(tuple(r) for r in run(people, p + "SELECT ?x ?y { { ?x :knows ?y } UNION { ?x :mail ?y } }").collect())
    assert got == [("urn:p/ann", "mailto:ann"), ("urn:p/bob", "urn:p/ann"), ("urn:p/bob", "urn:p/cy")]
    assert run(people, p + 'ASK { ?x :name "Bob" }').first()["ask"] is True
    assert run(people, p + 'ASK { ?x :name "Nobody" }').first()["ask"] is False


def test_results(people):
    p = "PREFIX : <urn:p/> "
    lines = [r["value"] for r in text_lines(people, p + "SELECT ?n ?a { ?x :name ?n OPTIONAL { ?x :age ?a } } ORDER BY ?n ?a").collect()]
    assert lines == [f'"Ann" "7.5"^^<{XSD}decimal>', f'"Ann" "30"^^<{XSD}integer>', '"Bob" ', '"Thing" ']
    assert text_lines(people, p + "ASK { ?x :age 30 }").first()["value"] == "YES"
    xml = "".join(xml_chunks(people, p + "SELECT ?n ?m { ?x :name ?n ; :mail ?m }"))
    assert '<variable name="n"/><variable name="m"/>' in xml and "<literal>Ann</literal>" in xml and "<uri>mailto:ann</uri>" in xml
    assert "<boolean>false</boolean>" in "".join(xml_chunks(people, "ASK { <urn:none> ?p ?o }"))


def test_server(people):
    server = serve(people, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    query = "SELECT ?n { ?x <urn:p/name> ?n }"
    assert b"<literal>Bob</literal>" in urlopen(f"{url}/sparql?query={quote(query)}").read()
    assert b"<literal>Bob</literal>" in urlopen(Request(f"{url}/sparql", data=f"query={quote(query)}".encode())).read()
    assert b"form" in urlopen(url).read()
    for path, method, code in (("/sparql", "GET", 400), ("/sparql?query=nonsense", "GET", 400), ("/other", "GET", 404), ("/sparql", "PUT", 405), (f"/sparql?query={'x' * (LONGEST_QUERY + 1)}", "GET", 400)):
        with pytest.raises(HTTPError) as caught:
            urlopen(Request(url + path, method=method))
        assert caught.value.code == code
    server.shutdown()
    server.server_close()


def test_inspector(terms):
    assert {r["item"]: r["n"] for r in inspector.summary(terms).collect()}["triples"] == 16
    assert inspector.triples(terms).count() == 16
    assert '<urn:s> <urn:v> "a"@en .' in {r["value"] for r in inspector.triples(terms).collect()}
    first = inspector.terms(terms).first()
    assert str(inspector.term(terms, first["id"])) == first["term"] == "_:b"
    assert inspector.term(terms, -5) is None


def test_command_line(spark, folder, capsys):
    (folder / "q.rq").write_text('ASK { ?s ?p "b" }')
    (folder / "small.nt").write_text('<urn:a> <urn:b> "b" .\n')
    store = str(folder / "cli.store")
    assert main(["load", store, str(folder / "small.nt")], spark) == 0
    assert main(["load", store, str(folder / "small.nt")], spark) == 1
    assert main(["load", store, str(folder / "small.nt"), "-f"], spark) == 0
    assert main(["load", store, str(folder / "absent.nt")], spark) == 2
    capsys.readouterr()
    assert main(["query", store, str(folder / "q.rq")], spark) == 0
    assert capsys.readouterr().out.strip() == "YES"
    assert main(["info", store, "-T"], spark) == 0
    assert capsys.readouterr().out.strip() == '<urn:a> <urn:b> "b" .'
    assert main(["query", str(folder / "none"), str(folder / "q.rq")], spark) == 1


def test_errors(spark, folder):
    with pytest.raises(QueryError):
        EncodedStore(spark, str(folder / "nothing"))
    with pytest.raises(Unsupported):
        read_statements(spark, str(folder / "terms.nt"), "trig")
    (folder / "bad.nt").write_text("<urn:a> nonsense .\n")
    with pytest.raises(Exception, match="not an N-Triples line"):
        read_statements(spark, str(folder / "bad.nt")).collect()


def test_escapes_come_back(spark, folder):
    (folder / "escapes.nt").write_text('<urn:a> <urn:b> "q\\"uo\\\\te\\n\\u00e9\\U0001F600" .\n')
    df = read_statements(spark, str(folder / "escapes.nt"))
    assert df.first()["o_lex"] == 'q"uo\\te\né😀'
    again = spark.createDataFrame([(df.select(ntriples.line().alias("value")).first()["value"],)], "value string")
    assert ntriples.statements(again).collect() == df.collect()


def test_empty_file(spark, folder):
    store = stored(spark, folder, "empty.nt", "# nothing\n")
    assert store.count() == 0
    assert run(store, "SELECT ?s { ?s ?p ?o }").collect() == []


def test_streamed_star(spark, folder):
    (folder / "in").mkdir()
    (folder / "in" / "a.nt").write_text('<urn:a> <urn:n> "A" .\n<urn:a> <urn:k> "1" .\n<urn:b> <urn:n> "B" .\n')
    stream = read_stream(spark, str(folder / "in"))
    one = drain(match_star(stream, {"urn:n": "name"}))
    assert sorted(map(tuple, one.collect())) == [("urn:a", "A"), ("urn:b", "B")]
    both = drain(match_star(read_stream(spark, str(folder / "in")), {"urn:n": "name", "urn:k": "key"}), "complete")
    assert [tuple(r) for r in both.collect()] == [("urn:a", "A", "1")]


def naive(triples, patterns):
    out = []
    for chosen in product(triples, repeat=len(patterns)):
        env = {}
        if all(env.setdefault(x, y) == y if x.startswith("?") else x == y for p, t in zip(patterns, chosen) for x, y in zip(p, t)):
            out.append(tuple(sorted(env.items())))
    return sorted(out)


def test_random_patterns(spark, folder):
    rng = random.Random(4)
    triples = sorted({tuple(f"<urn:{rng.choice(k)}>" for k in ("abcd", "pq", "abcd")) for _ in range(14)})
    store = stored(spark, folder, "random.nt", "".join(" ".join(t) + " .\n" for t in triples))
    for _ in range(6):
        patterns = [tuple(rng.choice(["?x", "?y", "?z", f"<urn:{rng.choice(k)}>"]) for k in ("abcd", "pq", "abcd")) for _ in range(2)]
        if not any(x.startswith("?") for p in patterns for x in p):
            continue
        got = run(store, "SELECT * { " + " . ".join(map(" ".join, patterns)) + " }", "terms")
        rows = sorted(tuple(sorted(("?" + k, v) for k, v in r.asDict().items())) for r in got.collect())
        assert rows == naive(triples, patterns), patterns


def test_stream_keeps_only_a_part_of_the_text(spark, monkeypatch):
    from triplane import queries

    sizes, own = [], ntriples.write

    def write(statements, path, **options):
        own(statements, path, **options)
        sizes.append(sum(p.stat().st_size for p in Path(path.removeprefix("file://")).parent.rglob("part-*")))

    monkeypatch.setattr(ntriples, "write", write)
    queries.stream_statements(spark, "/root/testdata/sf0.001")
    whole = sizes.pop()
    monkeypatch.setattr(queries, "PART_BYTES", 200e3)
    got = queries.stream_statements(spark, "/root/testdata/sf0.001")
    assert len(sizes) == 3 and max(sizes) < whole / 2 and whole < 1.5e6  # 10 MB before
    wanted = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").groupBy("c_mktsegment").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_rows_of_any_path_have_short_names(spark, tmp_path):
    from triplane.sources import mapped
    from triplane.sources.mapped import MappedTables, Table

    for i in range(3):
        spark.range(50).repartition(1).write.parquet(str(tmp_path / f"a b%20c=é {i}"))
    df = spark.read.parquet(*[str(p) for p in tmp_path.iterdir()])
    keyed, name = MappedTables.keyed(Table(df, "row", None, "urn:t:"))
    named = keyed.select(name.alias("n"), "_metadata.file_path").collect()
    assert len({r["n"] for r in named}) == 150 and max(r["n"] for r in named) < 50 * 16
    assert {mapped.one_slash(x) for x in df.inputFiles()} == {mapped.one_slash(x) for x in {r["file_path"] for r in named}}


def test_store_is_built_in_slices_and_keeps_no_text(spark, monkeypatch, tmp_path):
    from triplane import queries
    from triplane.sources import encoded

    graph = queries.relational_graph(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(queries, "PART_BYTES", 400e3)
    monkeypatch.setattr(encoded, "SLICE_ROWS", 30_000)
    assert queries.text_parts(graph) > 1 and encoded._slices(103_000) > 1
    shared, before = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")), set()
    before = {p.name for p in shared.glob("statements-*")}
    store = build(spark, queries._read_parts(spark, graph), str(tmp_path / "store"))
    assert {p.name for p in shared.glob("statements-*")} == before
    assert sorted(map(tuple, store.counts().collect())) == sorted(tuple(r) for r in graph.counts().collect() if r["triples"])
    ids = [r["id"] for r in store.terms.collect()]
    assert len(set(ids)) == len(ids) == store.terms.select("cat", "lex", "tag").distinct().count()
    a, b = store.triples.select("s", "p", "o"), store.inverse.select("s", "p", "o")
    assert a.count() == b.count() == a.distinct().count() and a.exceptAll(b).isEmpty()


def test_repeated_statements_count_once_across_tables(spark, tmp_path):
    line = spark.createDataFrame([("<urn:a> <urn:p> <urn:b> .",), ("<urn:a> <urn:p> <urn:c> .",)], "value string")
    store = build(spark, iter([ntriples.statements(line), ntriples.statements(line)]), str(tmp_path / "store"))
    assert store.counts().collect()[0]["triples"] == 2
