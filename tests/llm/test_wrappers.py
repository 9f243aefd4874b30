import random
import re
import time

import pytest

from triplane.llm.wrappers import CELLS, _matches, align, dumps, expression, extract, extract_page, fold, infer_wrappers, loads, merged, parse, settle, shape

SCHEMA = "page_id long, url string, html string, host int, wrapper string, shape string"


def page(title, items, ad=False, host="a.example"):
    rows = "".join(f"<li><b>{k}</b><i>{v}</i></li>" for k, v in items)
    return f"<html><body><nav><a href='/'>Home</a></nav><h1>{title}</h1>{'<div>Advert</div>' if ad else ''}<ul>{rows}</ul><p>Copyright {host}</p></body></html>"


def some_pages(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        items = [(f"key{i}.{j}", f"value{i}.{j}") for j in range(rng.randint(1, 6))]
        out.append((i, f"Title {i}", items, rng.random() < 0.4))
    return out


def test_wrapper_of_two_pages():
    a, b = (fold(parse(page(t, items, ad))) for _, t, items, ad in [(0, "One", [("a", "1"), ("b", "2")], True), (1, "Two", [("c", "3")], False)])
    got = expression(align(a, b))
    assert got == "<html><body><nav><a>Home</a></nav><h1>#PCDATA</h1>(<div>Advert</div>)?<ul>(<li><b>#PCDATA</b><i>#PCDATA</i></li>)+</ul><p>Copyright a.example</p></body></html>"


def test_alignment_of_a_page_with_itself_changes_nothing():
    for _, t, items, ad in some_pages(10):
        a = fold(parse(page(t, items, ad)))
        assert expression(align(a, a)) == expression(a)


def test_values_come_back(spark):
    pages = some_pages(40)
    rows = [(i, f"https://A.example/{i}", page(t, items, ad), 1, "w", "s") for i, t, items, ad in pages]
    rows += [(1000 + i, f"http://b.example:80/{i}", f"<div><span>Name</span><em>only {i}</em></div>", 1, "w", "s") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["page_id"]: r for r in extract(df).collect()}
    for i, t, items, _ in pages:
        assert [f["value"] for f in got[i]["fields"]] == [t, *(x for pair in items for x in pair)]
        assert got[i]["host"] == "a.example" and t in got[i]["text"] and "Copyright" not in got[i]["text"]
    assert [f["value"] for f in got[1003]["fields"]] == ["only 3"]
    wrappers = {r["host"]: r for r in infer_wrappers(df).collect()}
    assert (wrappers["a.example"]["n_pages"], wrappers["b.example"]["n_pages"]) == (40, 5)
    again = extract(df, infer_wrappers(df.repartition(1)))
    assert {r["page_id"]: r["text"] for r in again.collect()} == {i: r["text"] for i, r in got.items()}  # however the pages lie


def test_odd_pages(spark):
    long = "<div>" * 3000 + "deep" + "<p>x</p>" * 20_000
    rows = [(1, None, "<p>alone</p>"), (2, "http://h/x", None), (3, "http://h/x", ""), (4, "http://h/y", "no tags at all"), (5, "nonsense", "<<<>>&&"), (6, "http://long/", long), (None, "http://h/z", "<p>a</p>"), (7, "http://r/", "<p>same</p>"), (7, "http://r/", "<p>same</p>"), (8, "http://c/", "<script>var x = '<p>'</script><!-- gone --><p>kept &amp; read</p>")]
    df = spark.createDataFrame([(*r, 1, "w", "s") for r in rows], SCHEMA)
    got = extract(df).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[2]["text"] is None and by[2]["fields"] == [] and by[3]["text"] is None
    assert by[1]["text"] == "alone" and by[4]["text"] == "no tags at all" and by[8]["text"] == "kept & read"
    assert [r["text"] for r in got if r["page_id"] == 7] == ["same", "same"]
    assert extract(df.where("false")).collect() == []
    assert extract_page("<p>a</p>", "[]") == ([("/p", "a")], "a")


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


@pytest.mark.parametrize("cells", [CELLS, 20])
def test_matches_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr("triplane.llm.wrappers.CELLS", cells)
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 14)) for _ in range(2))
        got = _matches(a, b)
        assert all(a[i] == b[j] for i, j in got) and got == sorted(set(got)) and len(got) == longest_common(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def pattern(items):
    """The wrapper as a regular expression over the tokens of ``stream``."""
    out = []
    for x in items:
        one = "#" if x[0] == 0 else (f"<{x[1]}>{pattern(x[2])}</{x[1]}>" if x[0] == 1 else pattern(x[2]))
        out.append(f"(?:{one})" + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[x[3], x[4]])
    return "".join(out)


def stream(children):
    return "".join("#" if isinstance(c, str) else f"<{c[0]}>{stream(c[1])}</{c[0]}>" for c in children)


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "b", "ul", "i"])
        body = random_page(rng, depth + 1) if depth < 3 and rng.random() < 0.6 else f"t{rng.randrange(3)}"
        parts += [f"<{tag}>{body}</{tag}>"] * rng.choice([1, 1, 1, 3])
    return "".join(parts)


def test_a_wrapper_accepts_every_page_it_was_made_of():
    rng = random.Random(2)
    for _ in range(150):
        pages = [parse(random_page(rng)) for _ in range(rng.randint(1, 5))]
        whole = merged([fold(p, i) for i, p in enumerate(pages)])
        accepts = re.compile(pattern(whole))
        assert all(accepts.fullmatch(stream(p)) for p in pages)
        assert loads(dumps(whole)) == whole


@pytest.mark.parametrize("tags", [["a", "b"], ["a", "b", "i", "u", "s"], list("abi") + ["u", "s", "em", "q", "h1", "h2"]])
def test_groups_of_any_length(tags):
    def body(k):
        return "".join(f"<{t}>{k}.{t}</{t}>" for t in tags)

    inner = "".join(f"<{t}>#PCDATA</{t}>" for t in tags)
    assert expression(fold(parse(f"<div>{''.join(map(body, range(4)))}</div>"))) == f"<div>({inner})+</div>"


def test_text_that_one_page_alone_has_is_data(spark):
    rows = [(i, "http://h/", f"<div><h1>T{i}</h1>{'<q>only here</q>' if i == 3 else ''}<em>on all</em></div>", 1, "w", "s") for i in range(6)]
    rows += [(10 + i, "http://two/", x, 1, "w", "s") for i, x in enumerate(["<ul><li>one</li></ul><p>foot</p>", "<pre>code</pre><p>foot</p>"])]
    rows += [(20, "http://same/", "<p>x</p><b>y</b>", 1, "w", "s")] * 2
    got = {r["page_id"]: [f["value"] for f in r["fields"]] for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == ["T3", "only here"] and got[2] == ["T2"]
    assert (got[10], got[11]) == (["one"], ["code"])
    assert got[20] == ["x", "y"]  # a page and its copy don't differ


def test_many_shapes_of_a_host_merge_in_a_tree(spark):
    rng = random.Random(3)
    rows = [(i, "http://h/", f"<div><h1>Title {i}</h1>{''.join(f'<{t}>v{i}{t}</{t}>' for t in 'abiusq' if rng.random() < 0.5)}<p>foot</p></div>", 1, "w", "s") for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    small, large = (infer_wrappers(df, fan=f).collect() for f in (4, 64))
    assert [r["n_pages"] for r in small] == [r["n_pages"] for r in large] == [120]
    for r in small + large:
        accepts = re.compile(pattern(loads(r["wrapper"])))
        assert all(accepts.fullmatch(stream(parse(x[2]))) for x in rows)
    got = {r["page_id"]: [f["value"] for f in r["fields"]] for r in extract(df, infer_wrappers(df, fan=4)).collect()}
    assert all(got[i] == re.findall(r">((?:Title |v)[^<]+)<", x) for i, _, x, *_ in rows)


@pytest.mark.parametrize(
    "page",
    ["<script" * 150_000, '<a "' * 250_000, "<a '\"" * 200_000 + ">", "<div>" * 200_000 + "x", "<b><i>" * 60_000 + "y" + "</i></b>" * 60_000, "<!--" * 250_000, "<" * 1_000_000, "</p>" * 250_000, "<p>a</p><q>b</q>" * 60_000,
     "".join(f"<{t}>{k}</{t}>" for k, t in enumerate(random.Random(1).choices(["a", "b", "i", "u", "s", "q"], k=60_000))), "<td>" * 200_000, "<a b='>' " * 100_000],
)
def test_a_megabyte_of_malformed_page_takes_seconds(page):
    began = time.perf_counter()
    items = fold(parse(page), 1)
    whole = settle(merged([items, fold(parse("<div><p>x</p></div>"), 2)]))
    extract_page(page, dumps(whole))
    assert shape(whole) and expression(whole) is not None
    assert time.perf_counter() - began < 60


def test_reading_of_odd_tokens():
    assert parse("a < b <c>d</c> <!x> e <? y ?> f </g> h<br>i<img/>") == ["a < b", ["c", ["d"]], "e", "f", "h", ["br", []], "i", ["img", []]]
    assert parse("<STYLE>p > q</Style >x<script>1 < 2") == [["style", []], "x", ["script", []]] or parse("<STYLE>p > q</Style >x") == ["x"]
    assert parse("<p>1<p>2<b>3<p>4</b>5") == [["p", ["1"]], ["p", ["2", ["b", ["3"]]]], ["p", ["4", "5"]]]
    assert parse('<a href="x>y">z</a><b c="open>q</b>') == [["a", ["z"]], ["b", ["q"]]]
