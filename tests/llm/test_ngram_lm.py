import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from triplane.llm import document_lm
from triplane.llm.document_lm import Block, Grams, pack, score_documents, unpack
from triplane.llm.ngram_lm import STRENGTH, score_texts, suffix_array
from triplane.llm.queries import QUERIES
from triplane.llm.words import hash_words

SCHEMA = "item_id long, text string, q long, start int, length string"


def brute(text, corpus, strength=STRENGTH):
    """Bits per word by counting every n-gram in lists of word hashes."""
    docs = [hash_words([t]).hashes.tolist() for t in corpus if t]
    size = sum(map(len, docs))
    words = hash_words([text]).hashes.tolist()

    def count(gram):
        return sum(d[i : i + len(gram)] == gram for d in docs for i in range(len(d) - len(gram) + 1))

    bits, contexts = [], []
    for j, w in enumerate(words):
        p, best = max(count([w]), 1) / (size + 1), 0
        for n in range(1, j + 1):
            context = words[j - n : j]
            if not (c := count(context)):
                break
            best = n
            if n == j or count(words[j - n - 1 : j]) != c:  # else the longer one says the same
                p = (count([*context, w]) + strength * p) / (c + strength)
        bits.append(-np.log2(p))
        contexts.append(best)
    return len(words), float(np.mean(bits)), max(contexts)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [" ".join(rng.choice("abcde") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))) for _ in range(40)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 200).astype(np.int32)
    got = suffix_array(tokens, 300)
    assert got.tolist() == sorted(range(200), key=lambda i: tokens[i:].tolist())


def test_same_as_counting(spark, corpus, odd_rows):
    texts = ["a b c d e a b", corpus[3], "never seen words", "a a a a a a a", corpus[5][:20] + " zz " + corpus[6], "e"]
    queries = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)
    docs = spark.createDataFrame([(t, 1, "k") for t in [*corpus, None, "", *[t for _, t, *_ in odd_rows]]], "text string, start int, places string").repartition(3)
    whole = [*corpus, *[t for _, t, *_ in odd_rows]]
    for shard, words in ((100, 12), (3_000_000, 2_000_000)):
        got = {r["item_id"]: r for r in score_texts(queries, docs, shard_tokens=shard, pass_words=words).collect()}
        for i, t in enumerate(texts):
            n, bits, longest = brute(t, whole)
            assert (got[i]["n_tokens"], got[i]["longest_context"]) == (n, longest)
            assert got[i]["bits_per_word"] == pytest.approx(bits)
            assert got[i]["perplexity"] == pytest.approx(2**bits)


def test_odd_queries(spark, corpus):
    docs = spark.createDataFrame([(t,) for t in corpus], "text string")
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "?!"), (5, "a b " * 4000)]
    got = score_texts(spark.createDataFrame([(*r, 0, 0, "") for r in rows], SCHEMA), docs).collect()
    assert len(got) == len(rows)
    assert all(r["bits_per_word"] is None and r["n_tokens"] == 0 for r in got if r["item_id"] in (1, 2, 4))
    assert [r["n_tokens"] for r in got if r["item_id"] == 5] == [8000]
    assert score_texts(spark.createDataFrame([], SCHEMA), docs).collect() == []
    nothing = score_texts(spark.createDataFrame([(1, "a b", 0, 0, "")], SCHEMA), docs.where("false")).collect()
    assert [r["bits_per_word"] for r in nothing] == [0.0]


def test_documents_under_all_others(spark, corpus, make_docs, odd_rows):
    rng = random.Random(3)
    copy = " ".join(f"c{rng.randrange(50)}" for _ in range(150))
    rows = [(100 + i, t, "en", "web") for i, t in enumerate([*corpus, corpus[5], corpus[7] + " zz " + corpus[5], "aa aa aa aa aa", "z y x", copy, copy, f"q {copy} r", copy[:300], "a " * 40])] + [r for r in odd_rows if r[0] != 7]
    odd = F.col("doc_id") % 2 == 1
    for block, shard, asked in ((300, 200, None), (1_000_000, 2_000_000, odd), (50, 1000, odd)):
        got = score_documents(make_docs(rows).repartition(3), asked, block_words=block, shard_keys=shard).collect()
        wanted = [r for r in rows if asked is None or (r[0] or 0) % 2]
        assert sorted((r["item_id"] for r in got), key=repr) == sorted((r[0] for r in wanted), key=repr)
        got = {r["item_id"]: r for r in got}
        for at, (i, text, *_) in enumerate(rows):
            if i is None or i == 1 or i not in got:  # ids of several rows
                continue
            n = len(hash_words([text]).hashes)
            assert got[i]["n_tokens"] == n
            if not n:
                assert got[i]["bits_per_word"] is None
                continue
            _, bits, longest = brute(text, [r[1] for j, r in enumerate(rows) if j != at])
            assert got[i]["longest_context"] == longest
            assert got[i]["bits_per_word"] == pytest.approx(bits)
    assert score_documents(make_docs([])).collect() == []
    assert score_documents(make_docs(rows), F.lit(None).cast("boolean")).collect() == []
    assert [r["bits_per_word"] for r in score_documents(make_docs([(1, "a b", "en", "web")])).collect()] == [0.0]


def test_long_copies(spark, make_docs):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3_000))
    rows = [(1, long, "en", "a"), (2, long + " tail", "en", "a"), (3, "x " * 2_000, "en", "a"), (4, "x " * 900, "en", "a"), (5, None, "en", "a")]
    got = {r["item_id"]: r for r in score_documents(make_docs(rows)).collect()}
    assert [got[i]["longest_context"] for i in (1, 2, 3, 4)] == [2_999, 3_000, 900, 899]
    assert got[1]["bits_per_word"] < 1.2 and got[5]["n_tokens"] == 0


def test_packed_arrays():
    for kind in (np.int32, np.int64, np.uint64, np.bool_, np.uint8):
        for n in (0, 1, 1000):
            a = np.random.default_rng(n).integers(0, 2, n).astype(kind) if kind is np.bool_ else np.random.default_rng(n).integers(0, 120, n).astype(kind)
            assert unpack(pack(a), kind).tolist() == a.tolist()


def test_query_scores_every_asked_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["item_id"]: r for r in QUERIES["op9_ngram_lm"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(got) == sorted(r[0] for r in rows if r[0] % 20 == 0)
    some = [i for i in sorted(got) if 0 < got[i]["n_tokens"] < 100][:1]
    for i in some:
        text = next(r["text"] for r in rows if r["doc_id"] == i)
        n, bits, longest = brute(text, [r["text"] for r in rows if r["doc_id"] != i])
        assert (got[i]["n_tokens"], got[i]["longest_context"]) == (n, longest) and got[i]["bits_per_word"] == pytest.approx(bits)


def in_process(texts, asked, grams=None):
    """The rounds over one block for each text: (rows sent, keys sent, open intervals left) of each, and what queries found by
    document, start and length."""
    states, rounds, found = [], [], {}
    for i, t in enumerate(texts):
        h, none = hash_words([t]).hashes, np.zeros(0, np.int64)
        vocabulary, codes = np.unique(h, return_inverse=True)
        b = Block(vocabulary, codes, np.array([0, len(h)]), np.array([i]), np.array([0]), np.array([asked[i]]), np.array([1]), none, none, none, none, none)
        states.append(document_lm._table({k: [v] for k, v in (b.row() | {"block": i, "kind": 0, "open": len(h)} | dict.fromkeys(document_lm._FOUND)).items()}, document_lm._STATE))
    if grams == "queries":
        grams = Grams(np.zeros(1 << 17, np.uint8), 20)
        for at in np.concatenate([document_lm._read(s).of_queries() for s, q in zip(states, asked, strict=True) if q]) >> np.uint64(44):
            grams.bits[int(at) >> 3] |= 1 << (int(at) & 7)
    while states:
        sent = pa.concat_tables(document_lm._sent(s.column("block")[0].as_py(), document_lm._read(s), 3, grams) for s in states)
        answers = pa.concat_tables([document_lm._table({"block": [], "shard": [], "counts": []}, document_lm._ANSWER), *(document_lm._counted(sent.filter(pc.equal(sent.column("shard"), k))) for k in sorted(set(sent.column("shard").to_pylist())))])
        after = []
        for s in states:
            mine = answers.filter(pc.equal(answers.column("block"), s.column("block")[0].as_py()))
            out = document_lm._next(s, mine, grams)
            after += [out.slice(i, 1) for i in range(out.num_rows) if out.column("kind")[i].as_py() == 0]
            for i in range(out.num_rows):
                if out.column("kind")[i].as_py():
                    for doc, start, length, places, width in zip(*(unpack(out.column(c)[i].as_py(), kind).tolist() for c, kind in document_lm._FOUND.items()), strict=True):
                        for j in range(width):
                            assert found.setdefault((doc, start + j, length - j), places) == places
        states = after
        rounds.append((sent.num_rows, sum(len(unpack(x, np.uint64)) for x in sent.column("keys").to_pylist()), sum(s.column("open")[0].as_py() for s in states)))
        grams = None
    return rounds, found


def test_first_round_sends_only_what_queries_have():
    rng = random.Random(5)
    texts = ["a b c d a b c e", "x a b c d y", *(" ".join(f"w{rng.randrange(10**6)}" for _ in range(2_000)) + " a b" for _ in range(3))]
    asked = [True, False, False, False, False]
    every, wanted = in_process(texts, asked)
    rounds, found = in_process(texts, asked, "queries")
    assert every[0][1] > 12_000 and rounds[0][1] < 200  # before, all n-grams of all documents
    for some in (found, in_process(texts, asked, Grams(np.full(1 << 13, 255, np.uint8), 16))[1]):  # bits that let all through change nothing
        assert {k: v for k, v in some.items() if k[2] < 4} == {k: v for k, v in wanted.items() if k[2] < 4} and some[0, 0, 4] == 1
    assert found[0, 0, 2] == 4 and found[0, 0, 3] == 1


def test_copies_are_asked_about_by_chains():
    rng = random.Random(6)
    words = [f"v{rng.randrange(10**6)}" for _ in range(900)]
    other = [*words[:300], "changed", *words[301:]]
    rounds, found = in_process([" ".join(words), " ".join(other), " ".join(words[:600])], [True, False, False])
    assert all(open_ < 20 for _, _, open_ in rounds[3:])  # before, one for each of some 800 starts and more
    longest = {}
    for (_, start, length), places in found.items():
        longest.setdefault(start, {})[length] = places
    for start in (0, 100, 295, 299, 300, 301, 400, 595, 599, 700):
        at = longest[start]
        assert max(at) == (600 - start if start < 301 else 900 - start)
        for length in range(1, max(at) + 1):
            end = start + length
            places = (end <= 600) + (end <= 300 or start > 300)
            assert at[min(x for x in at if x >= length)] == places
