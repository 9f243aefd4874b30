"""HTML extraction by union-free regular expressions inferred from pages of one host (method: RoadRunner, Crescenzi et al.).

A page is a token stream of tags and texts, balanced on reading. Inside a page, neighbouring repeats of a tag or of a run of
tags, of any length, become a repeated group. Pages of a host are then aligned: equal tags match, texts that differ become
slots, what one side lacks becomes optional. The result, a wrapper, has sequences, optional and repeated groups and slots, but
no unions. What fills the slots of a page is its data; a text is template only if two pages that differ agree on it.

Pages of one shape merge in any order, so shapes are merged where they are read, then across the cluster by (host, shape).
A host's shapes are merged in a tree: a task aligns ``FAN`` at most, in as many rounds as the logarithm of their number.
Texts are shortened to a stamp. A page is read in one pass whatever is wrong with it, and nested as deep as it is.
"""

from __future__ import annotations

import html as _html
import json
import re
import sys
from bisect import bisect_left
from collections import Counter
from functools import lru_cache, wraps
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.llm.tables import arrow_batches, materialize
from triplane.llm.words import _BASE, _power

_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*+)[^>]*+>")
_TAG_START = re.compile(r"</?[a-zA-Z]")
#: Elements whose content isn't read, and what ends it.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in ("script", "style", "noscript", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open one of the same kind, or of the kinds named.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
#: Tags that may be the content element.
_CONTAINERS = frozenset("html body div main section article table tbody tr td center form".split())
TEXT, ELEMENT, GROUP = 0, 1, 2
# An item is [kind, text stamp or tag, body, optional, repeated, characters, pages]; a text without a stamp is a slot. pages:
# digests of up to two differing pages that agree on the stamp.
#: Shapes that one task aligns at most; cells of an alignment's table that are held at a time.
FAN, CELLS = 64, 1 << 22
#: Characters of a path; a longer one is its beginning and a digest of the rest.
PATH = 400


def _deep(f):
    """Lets a function recurse as deep as its page is nested."""

    @wraps(f)
    def called(*args):
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 10_000_000))
        try:
            return f(*args)
        finally:
            sys.setrecursionlimit(before)

    return called


def _stamp(text: str) -> str:
    return text if len(text) <= 40 else f"{text[:24]}…{blake2b(text.encode(), digest_size=8).hexdigest()}"


def _tokens(page: str):
    """(text before, tag or None, closes, ends itself) for each token of a page, in one pass. Comments, declarations and the
    content of scripts and styles are left out, to the page's end if nothing ends them. From the first tag on whose quotes don't
    close, tags end at the next ``>``; a ``<`` that begins nothing is text."""
    at, text, strict, last = 0, 0, True, page.rfind(">")
    while (lt := page.find("<", at)) >= 0:
        tag, closes, alone = None, False, False
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = len(page) if end < 0 else end + 3
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt + 9)
            end = len(page) if end < 0 else end + 3
        elif lt > last:
            at = lt + 1
            continue
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt) + 1
        else:
            m = (_TAG if strict else _LOOSE_TAG).match(page, lt)
            if m is None and strict and _TAG_START.match(page, lt):
                strict, m = False, _LOOSE_TAG.match(page, lt)
            if m is None:
                at = lt + 1
                continue
            tag, closes, end = m.group(2).lower(), bool(m.group(1)), m.end()
            alone = page[end - 2] == "/"
            if tag in _RAW and not closes and not alone:
                over = _RAW[tag].search(page, end)
                tag, end = None, over.end() if over else len(page)
        yield page[text:lt], tag, closes, alone
        at = text = end
    yield page[text:], None, False, False


def parse(page: str) -> list:
    """The page as nested [tag, children] and strings. Attributes, comments, scripts and styles are left out; tags that are
    never closed end with their parent; closing tags without an open one are ignored."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    opened: Counter[str] = Counter()
    for before, tag, closes, alone in _tokens(page):
        if before and (text := " ".join(_html.unescape(before).split())):
            stack[-1][1].append(text)
        if tag is None:
            continue
        if closes:
            if opened[tag]:
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == tag:
                        break
            continue
        if tag in _ENDS:  # through inline tags that were never closed
            depth = len(stack) - 1
            while depth and stack[depth][0] not in _BLOCKS:
                depth -= 1
            if stack[depth][0] in _ENDS[tag]:
                for top, _ in stack[depth:]:
                    opened[top] -= 1
                del stack[depth:]
        children: list = []
        stack[-1][1].append([tag, children])
        if tag not in _VOID and not alone:
            stack.append((tag, children))
            opened[tag] += 1
    return root


def _key(item: list) -> str:
    return "#" if item[0] == TEXT else item[1]


def _group(items: list[list]) -> list:
    return [GROUP, "(" + ",".join(map(_key, items)) + ")", items, False, False, 0, []]


def merge(a: list, b: list) -> list:
    """Two items of one key as one."""
    if a[0] == TEXT:
        same = a[1] is not None and a[1] == b[1]
        return [TEXT, a[1] if same else None, [], a[3] or b[3], a[4] or b[4], a[5] + b[5], sorted({*a[6], *b[6]})[:2] if same else []]
    return [a[0], a[1], align(a[2], b[2]), a[3] or b[3], a[4] or b[4], 0, []]


def _wrap(seq: list, other: list) -> list:
    """seq with single runs of what ``other`` has as a group made groups too."""
    for g in other:
        if g[0] == GROUP and not any(x[0] == GROUP and x[1] == g[1] for x in seq):
            want = [_key(x) for x in g[2]]
            keys = [_key(x) for x in seq]
            for i in range(len(seq) - len(want) + 1):
                if keys[i : i + len(want)] == want:
                    seq = [*seq[:i], _group(seq[i : i + len(want)]), *seq[i + len(want) :]]
                    break
    return seq


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of a longest common subsequence of all of a with each prefix of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The places of a longest common subsequence. Beyond ``CELLS`` the longer side is halved, so memory is bounded."""
    if not len(a) or not len(b):
        return []
    if (len(a) + 1) * (len(b) + 1) > CELLS and len(a) > 1:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:])]
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):  # of the rests from i and j on
        row = np.maximum(table[i + 1, :-1], table[i + 1, 1:] + (b == a[i]))
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _matches(ka: list[str], kb: list[str]) -> list[tuple[int, int]]:
    """The places of a longest common subsequence of two lists of keys."""
    n, m = len(ka), len(kb)
    head = 0
    while head < min(n, m) and ka[head] == kb[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and ka[n - 1 - tail] == kb[m - 1 - tail]:
        tail += 1
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(k, len(codes)) for k in x], np.int32) for x in (ka[head : n - tail], kb[head : m - tail]))
    middle = [(i + head, j + head) for i, j in _common(a, b)]
    return [(i, i) for i in range(head)] + middle + [(n - t, m - t) for t in range(tail, 0, -1)]


def align(a: list, b: list) -> list:
    """Two sequences as one union-free sequence: a longest common subsequence of keys merges, the rest becomes optional, that of
    a before that of b."""
    if [_key(x) for x in a] != [_key(x) for x in b]:
        a, b = _wrap(a, b), _wrap(b, a)
    ka, kb = [_key(x) for x in a], [_key(x) for x in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for to_i, to_j in [*_matches(ka, kb), (len(a), len(b))]:
        out += [[*x[:3], True, *x[4:]] for x in (*a[i:to_i], *b[j:to_j])]
        if to_i < len(a):
            out.append(merge(a[to_i], b[to_j]))
        i, j = to_i + 1, to_j + 1
    return _fold_runs(out)


def _fold_runs(items: list) -> list:
    out: list = []
    for x in items:
        if out and _key(out[-1]) == _key(x):
            optional = out[-1][3] and x[3]
            out[-1] = merge(out[-1], x)
            out[-1][3], out[-1][4] = optional, True
        else:
            out.append(x)
    return out


def _repeats(keys: list[str], width: int) -> tuple[int, np.ndarray] | None:
    """The least width from ``width`` on at which some run of keys follows itself, and for each place how many keys from it on
    equal those ``width`` further. A run of ``width`` equal pairs covers a multiple of width, and one half of it lies before or
    behind that place: halves are compared by hash there, so all widths take no longer than sorting would."""
    n = len(keys)
    codes: dict[str, int] = {}
    coded = np.array([codes.setdefault(k, len(codes)) for k in keys], np.uint64)
    total = np.append(np.uint64(0), np.cumsum((coded + np.uint64(1)) * _power(_BASE, n), dtype=np.uint64))
    for w in range(width, n // 2 + 1):
        if n > 64:
            at, shift = np.arange(0, n - w, w), np.uint64(pow(_BASE, w, 1 << 64))
            ahead, behind = at[at + w + (w + 1) // 2 <= n], at[at >= w // 2]
            upto, back = ahead + (w + 1) // 2, behind - w // 2
            if not (((total[upto] - total[ahead]) * shift == total[upto + w] - total[ahead + w]).any() or ((total[behind] - total[back]) * shift == total[behind + w] - total[back + w]).any()):
                continue
        same = coded[:-w] == coded[w:]
        ends = np.append(np.flatnonzero(~same), n - w)
        run = ends[np.searchsorted(ends, np.arange(n - w))] - np.arange(n - w)
        if (run >= w).any():
            return w, run
    return None


def _fold_groups(items: list[list]) -> list:
    """items with each run of items that follows itself folded into a repeated group, shorter runs first."""
    keys, width = [_key(x) for x in items], 2
    while len(set(keys)) < len(keys) and (found := _repeats(keys, width)):
        width, run = found
        out, i, n = [], 0, len(items)
        while i < n:
            if i < n - width and run[i] >= width and any(k != "#" for k in keys[i : i + width]):
                body, j = items[i : i + width], i + width
                for _ in range(int(run[i]) // width):
                    body = align(body, items[j : j + width])
                    j += width
                g = _group(body)
                g[4] = True
                out.append(g)
                i = j
            else:
                out.append(items[i])
                i += 1
        items, keys, width = out, [_key(x) for x in out], width + 1
    return items


def _fold(children: list, page: int) -> list:
    items = [[TEXT, _stamp(c), [], False, False, len(c), [page]] if isinstance(c, str) else [ELEMENT, c[0], _fold(c[1], page), False, False, 0, []] for c in children]
    return _fold_groups(_fold_runs(items))


@_deep
def fold(children: list, page: int = 0) -> list:
    """Parsed children as a sequence of items in which repeats are folded. page: a digest that tells pages apart."""
    return _fold(children, page)


@_deep
def merged(parts: list[list]) -> list:
    """Sequences of items aligned one after the other."""
    whole = parts[0]
    for p in parts[1:]:
        whole = align(whole, p)
    return whole


def shape(items: list) -> str:
    out, stack = [], list(reversed(items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x[0] == TEXT:
            out.append("#" + "?" * x[3] + "+" * x[4])
        else:
            out.append(f"{x[1] if x[0] == ELEMENT else ''}(")
            stack.append(")" + "?" * x[3] + "+" * x[4])
            stack.extend(reversed(x[2]))
    return "".join(out)


def expression(items: list) -> str:
    """The wrapper as text: #PCDATA for slots, ( )? ( )+ ( )* for optional and repeated parts."""
    out, stack = [], list(reversed(items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if suffix := {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[x[3], x[4]]:
            out.append("(")
            stack.append(")" + suffix)
        if x[0] == TEXT:
            out.append("#PCDATA" if x[1] is None else x[1])
            continue
        if x[0] == ELEMENT:
            out.append(f"<{x[1]}>")
            stack.append(f"</{x[1]}>")
        stack.extend(reversed(x[2]))
    return "".join(out)


def dumps(items: list) -> str:
    """A sequence of items as JSON that isn't nested: each item with the number of its body's."""
    out, stack = [], list(reversed(items))
    while stack:
        x = stack.pop()
        out.append([x[0], x[1], x[3] + 2 * x[4], x[5], x[6], len(x[2])])
        stack.extend(reversed(x[2]))
    return json.dumps(out, ensure_ascii=False)


def loads(text: str) -> list:
    root: list = []
    stack: list[list] = [[root, -1]]
    for kind, value, bits, chars, pages, inside in json.loads(text):
        item = [kind, value, [], bool(bits & 1), bool(bits & 2), chars, pages]
        while stack[-1][1] == 0:
            stack.pop()
        stack[-1][0].append(item)
        stack[-1][1] -= 1
        if inside:
            stack.append([item[2], inside])
    return root


def _every(items: list) -> list[list]:
    """All items, each before those of its body."""
    out, stack = [], list(items)
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(x[2])
    return out


def settle(items: list) -> list:
    """The wrapper of a host's pages: texts that no two differing pages agree on become slots, all where none else is."""
    texts = [x for x in _every(items) if x[0] == TEXT]
    few = [x for x in texts if len(x[6]) < 2]
    for x in few if any(x[1] is None for x in texts) or few else texts:
        x[1] = None
    for x in texts:
        x[6] = []
    return items


def content_path(items: list, share: float = 0.7) -> list[str]:
    """The tags down to the smallest element that holds ``share`` of all slot characters of the host."""
    held: dict[int, int] = {}
    for x in reversed(_every(items)):
        held[id(x)] = (x[5] if x[1] is None else 0) if x[0] == TEXT else sum([held[id(y)] for y in x[2]])
    path: list[str] = []
    total = sum(held[id(x)] for x in items)
    while total:
        flat = [y for x in items for y in (x[2] if x[0] == GROUP else [x])]
        top = max((x for x in flat if x[0] == ELEMENT), key=lambda x: held[id(x)], default=None)
        if top is None or top[4] or top[1] not in _CONTAINERS or held[id(top)] < share * total:
            break
        path.append(top[1])
        items = top[2]
    return path


def _places(children: list, items: list) -> list:
    """The wrapper item of each child, or None: an assignment in order that takes the first place that fits. A repeated item
    takes several children; a group's inner items are taken in turn."""
    flat: list[tuple[list, int, bool]] = []  # item, place to come back to, may repeat
    for x in items:
        if x[0] == GROUP:
            first = len(flat)
            flat += [(y, first, False) for y in x[2]]
            flat[-1] = (flat[-1][0], first, x[4])
        else:
            flat.append((x, len(flat), x[4]))
    of: dict[str, list[int]] = {}
    for j, (x, _, _) in enumerate(flat):
        of.setdefault(_key(x), []).append(j)
    out: list = []
    at = 0
    for c in children:
        where = of.get("#" if isinstance(c, str) else c[0], [])
        low = flat[at - 1][1] if at and flat[at - 1][2] else at
        k = bisect_left(where, low)
        if k == len(where):
            out.append(None)
            continue
        hit = where[k]
        if isinstance(c, str) and flat[hit][0][1] is None and hit + 1 < len(flat) and flat[hit + 1][0][0] == TEXT and flat[hit + 1][0][1] == _stamp(c):
            hit += 1  # a text that a constant states takes it before an earlier slot
        at = hit + 1
        out.append(flat[hit][0])
    return out


def _below(path: str, tag: str) -> str:
    path = f"{path}/{tag}"
    return path if len(path) <= PATH else f"{path[: PATH // 2]}…{blake2b(path.encode(), digest_size=8).hexdigest()}"


def _fill(children: list, items: list, path: str, region: list[str], depth: int, out: list[list]) -> None:
    """Appends [path, text, whether it begins a block, whether in the region] for each text of a page that is data under the
    wrapper. depth: how many of the region's tags lie above, -1 outside of it."""
    inside = depth == len(region)
    for c, x in zip(children, _places(children, items), strict=True):
        if isinstance(c, str):
            if x is None or x[1] is None or x[1] != _stamp(c):
                out.append([path, c, False, inside])
        else:
            mark, own = len(out), _below(path, c[0])
            under = depth if inside else depth + 1 if 0 <= depth < len(region) and region[depth] == c[0] else -1
            _fill(c[1], x[2] if x is not None else [], own, region, under, out)
            if c[0] in _BLOCKS:
                if c[0] in _VOID:
                    out.append([own, "", True, under == len(region)])
                elif len(out) > mark:
                    out[mark][2] = True
                    out.append([path, "", True, inside])


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> tuple[list, list[str]]:
    items = loads(wrapper)
    return items, content_path(items)


@_deep
def extract_page(page: str, wrapper: str) -> tuple[list[tuple[str, str]], str]:
    """(fields, text): all slot texts with their paths, and the content element's as one text with a line for each block."""
    items, region = _loaded(wrapper)
    found: list[list] = []
    _fill(parse(page), items, "", region, 0, found)
    lines: list[list[str]] = [[]]
    for _, text, block, inside in found:
        if not inside:
            continue
        if block and lines[-1]:
            lines.append([])
        if text:
            lines[-1].append(text)
    return [(p, t) for p, t, *_ in found if t], "\n".join([" ".join(x) for x in lines if x])


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


HELD = 2000
_SHAPES = "host string, shape string, wrapper string, n long"


def _merge_rows(df: DataFrame, keys: list[str], fan: int, salt: Column) -> DataFrame:
    """Rows (host, shape, wrapper, n) merged to one for each value of keys, ``fan`` at most in a task; salt spreads them."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["n", "shape", "wrapper"], ascending=[False, True, True])
        return pd.DataFrame([(df["host"].iloc[0], df["shape"].min(), dumps(merged([loads(w) for w in df["wrapper"]])), int(df["n"].sum()))], columns=["host", "shape", "wrapper", "n"])

    while True:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
        if (sizes.agg(F.max("rows")).first()[0] or 0) <= fan:
            return df.groupBy(*keys).applyInPandas(one, _SHAPES)
        parts = df.withColumn("salt", F.xxhash64(salt)).join(sizes, keys).withColumn("part", F.pmod("salt", F.ceil(F.col("rows") * 2 / fan)))
        df = materialize(parts.select("host", "shape", "wrapper", "n", "part").groupBy(*keys, "part").applyInPandas(one, _SHAPES))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan: int = FAN) -> DataFrame:
    """(host, wrapper, expression, n_pages). Pages without html are left out; a null or odd url has the host "". Pages that
    repeat count in n_pages and agree with nothing but themselves. A host whose pages are all alike has no template to tell from
    data: every text is a slot. Of places that align equally well, the first of the page with more of its kind stands. Long pages
    are read whole. No pages give no rows; other columns play no part."""
    arrow_batches(pages.sparkSession, 500)
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).where(F.length("html") > 0)

    def folded(batches):
        held: dict[tuple[str, str], list] = {}

        def out():
            return pd.DataFrame([(h, s, dumps(x), n) for (h, s), (x, n) in held.items()], columns=["host", "shape", "wrapper", "n"])

        for df in batches:
            for host, page in zip(df["host"], df["html"], strict=True):
                items = fold(parse(page), int.from_bytes(blake2b(page.encode(), digest_size=6).digest()))
                key = host, blake2b(shape(items).encode(), digest_size=16).hexdigest()
                old = held.get(key)
                held[key] = [merged([old[0], items]), old[1] + 1] if old else [items, 1]
            if len(held) >= HELD:  # what is held stays small; equal shapes meet again after the shuffle
                yield out()
                held.clear()
        if held:
            yield out()

    by_shape = materialize(_merge_rows(materialize(rows.mapInPandas(folded, _SHAPES)), ["host", "shape"], fan, F.monotonically_increasing_id()))
    by_host = _merge_rows(by_shape, ["host"], fan, F.col("shape"))

    def settled(batches):
        for df in batches:
            wholes = [settle(loads(w)) for w in df["wrapper"]]
            yield pd.DataFrame({"host": df["host"], "wrapper": [dumps(w) for w in wholes], "expression": [expression(w) for w in wholes], "n_pages": df["n"]})

    return by_host.mapInPandas(settled, "host string, wrapper string, expression string, n_pages long")


def extract(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, fields, text) for each row of pages: fields are (path, value) of all slots in order, text is the
    content element's. A path is the tags from the page's root, shortened to its beginning and a digest beyond ``PATH``
    characters. Null and empty html have no fields and a null text. Repeated rows and null ids are extracted like others, long pages
    whole; extra columns play no part."""
    arrow_batches(pages.sparkSession, 500)
    made = materialize(wrappers if wrappers is not None else infer_wrappers(pages, url_col, html_col)).select("host", "wrapper")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()

    def extracted(batches):
        for df in batches:
            out = []
            for page, wrapper in zip(df["html"], df["wrapper"], strict=True):
                if not page:
                    out.append(([], None))
                    continue
                fields, text = extract_page(page, wrapper or "[]")
                out.append(([{"path": p, "value": v} for p, v in fields], text))
            yield pd.DataFrame({"page_id": df["page_id"], "host": df["host"], "fields": [f for f, _ in out], "text": [t for _, t in out]})

    # Spark broadcasts the wrappers below its own size limit and shuffles pages by host beyond
    return rows.join(made, "host", "left").select("page_id", "host", "html", "wrapper").mapInPandas(extracted, f"page_id {id_type}, host string, fields array<struct<path:string,value:string>>, text string")
