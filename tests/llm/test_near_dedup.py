import random
from itertools import combinations

import numpy as np
import pytest

from triplane.llm.near_dedup import THRESHOLD, near_dedup, near_duplicate_pairs
from triplane.llm.words import hash_words, shingles

from .conftest import prose


def sets(texts, width=2):
    h, b = shingles(hash_words(texts), width)
    return [frozenset(h[s:e].tolist()) for s, e in zip(b[:-1], b[1:], strict=True)]


def groups(rows):
    """Row numbers by group: equal texts, or shingle sets of the threshold's similarity, closed transitively."""
    found = list(range(len(rows)))

    def root(i):
        while found[i] != i:
            i = found[i]
        return i

    s = sets([t for _, t, *_ in rows])
    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if a is None or b is None:
            continue
        if a == b or s[i] and s[j] and len(s[i] & s[j]) >= THRESHOLD * len(s[i] | s[j]):
            found[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(i)
    return list(out.values())


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(2)
    out = list(odd_rows)
    for k in range(40):
        base = prose(rng, 120).split()
        out.append((100 + 10 * k, " ".join(base), "en", "a"))
        for c in range(k % 4):
            copy = list(base)
            for _ in range(1 + c):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append((101 + 10 * k + c, " ".join(copy), "en", "a"))
    chain = prose(rng, 200).split()  # each near the next, the ends far apart
    for k in range(8):
        out.append((900 + k, " ".join(chain), "en", "b"))
        chain = chain[12:] + prose(rng, 12).split()
    return out


def test_same_as_brute_force(spark, make_docs, rows):
    docs = make_docs(rows)
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    expected = []
    for g in groups(rows):
        if rows[g[0]][1] is None:
            expected.append(rows[g[0]])
        else:
            expected.append(min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0)))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(((r[0], r[1]) for r in expected), key=repr)
    pairs = near_duplicate_pairs(docs)
    assert pairs.count() == len(rows) - len(expected)


def test_empty_table(spark, make_docs):
    assert near_dedup(make_docs([])).count() == 0
    assert near_duplicate_pairs(make_docs([])).count() == 0
    nothing = make_docs([(1, "", "en", "a"), (2, None, "en", "a"), (3, "some words", "en", "a")])
    assert near_dedup(nothing).count() == 3


def test_large_group_of_variants(spark, make_docs):
    rng = random.Random(5)
    base = prose(rng, 80).split()
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(copy), "en", "a"))
    assert [r["doc_id"] for r in near_dedup(make_docs(rows)).collect()] == [0]


def test_words_are_hashed_alike_in_pieces():
    long = " ".join(f"word{i}" for i in range(300_000))
    got = hash_words(["a b", None, long, ""])
    assert np.array_equal(np.diff(got.bounds), [2, 0, 300_000, 0])
    assert got.hashes[2] == hash_words(["word0"]).hashes[0] and got.hashes[-1] == hash_words(["Word299999."]).hashes[0]


def test_words_of_any_script():
    words = lambda t: hash_words([t]).hashes.tolist()
    assert words("東京タワー。") == [w for c in "東京タワー" for w in words(c)]
    assert words("a—b…c") == words("a b c") and words("¿qué?") == words("qué") and words("x\u00a0y\u3000z") == words("x y z")
    assert len(words("naïve café Ünïcode")) == 3 and len(words("สวัสดี")) == 6
    mixed = hash_words(["plain", "日本 text", None, "é", "«a»"])
    assert np.diff(mixed.bounds).tolist() == [1, 3, 0, 1, 1]


def test_near_copies_without_spaces(spark, make_docs):
    rng = random.Random(8)
    text = "".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(300))
    docs = make_docs([(1, text, "zh", "a"), (2, text[:150] + "改" + text[151:], "zh", "a"), (3, text[::-1], "zh", "a")])
    assert [(r["doc_id"], r["kept_doc_id"]) for r in near_duplicate_pairs(docs).collect()] == [(2, 1)]
