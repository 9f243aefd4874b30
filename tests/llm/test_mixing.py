import random
import re
from collections import Counter

import numpy as np
import pytest

from triplane.llm.mixing import mix, mixed_documents, permute, slots, token_blocks
from triplane.llm.packing import TOKEN


def tokens(text):
    return re.findall(TOKEN, text or "")


@pytest.mark.parametrize("size", [1, 2, 3, 17, 256, 1000])
def test_permutation(size):
    n = np.arange(size)
    seen = [permute(n, np.full(size, size), np.full(size, key)) for key in range(4)]
    assert all(sorted(s) == n.tolist() for s in seen)
    assert size < 17 or any((a != b).any() for a, b in zip(seen, seen[1:], strict=False))


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(1)
    return [r for r in odd_rows if r[0] != 7] + [(100 + i, " ".join(f"d{i}t{j}" for j in range(rng.randint(1, 80))), "en", ["web", "book", "code"][i % 3]) for i in range(150)]


def test_blocks_hold_every_token_once(spark, make_docs, rows):
    for group_tokens in (200, 1 << 20):
        blocks, totals = token_blocks(make_docs(rows), 32, group_tokens)
        got = blocks.collect()
        want = {s: Counter(t for i, x, _, source in rows if source == s for t in tokens(x)) for s in {r[3] for r in rows}}
        assert {r["source"]: r["tokens"] for r in totals.collect()} == {s: sum(c.values()) for s, c in want.items() if c}
        for s, c in want.items():
            own = sorted((b for b in got if b["source"] == s), key=lambda b: b["block"])
            assert [b["block"] for b in own] == list(range(len(own)))
            assert all(b["n_tokens"] == 32 for b in own[:-1]) and all(len(tokens(b["text"])) == b["n_tokens"] for b in own)
            assert sum((Counter(tokens(b["text"])) for b in own), Counter()) == c


def test_slots_follow_weights(spark):
    got = slots(spark, ["a", None, "c"], [40, 7, 300], [0.5, 0.3, 0.2], 3000, 100, seed=3).toPandas()
    assert len(got) == 3000 and got.groupby("shard").size().tolist() == [100] * 30
    assert all(sorted(g) == list(range(100)) for _, g in got.groupby("shard")["slot"])
    share = got["source"].fillna("none").value_counts(normalize=True)
    assert abs(share["a"] - 0.5) < 0.05 and abs(share["none"] - 0.3) < 0.05 and abs(share["c"] - 0.2) < 0.05
    for source, size in (("a", 40), ("none", 7), ("c", 300)):
        own = got[got["source"].fillna("none") == source]
        for turn, g in own.groupby("pass"):
            assert g["block"].is_unique and g["block"].between(0, size - 1).all()
            assert len(g) == size or turn == own["pass"].max()
    drawn = {i: np.random.default_rng([3, i]).multinomial(100, [0.5, 0.3, 0.2]) for i in range(30)}
    assert all(((got["shard"] == i) & (got["source"] == "a")).sum() == d[0] for i, d in drawn.items())


def test_mix(spark, make_docs, rows):
    docs = make_docs(rows)
    a, b = (sorted(map(tuple, mix(d, {"web": 3.0, "book": 1.0, "absent": 5.0}, 32, 16, 96).collect()), key=repr) for d in (docs, docs.repartition(5)))
    assert a == b and len(a) == 96  # the same whatever the partitions
    assert {r[2] for r in a} == {"web", "book"}
    merged = mix(docs, {"web": 3.0, "book": 1.0, "absent": 5.0}, 32, 16, 96, broadcast_slots=0)
    assert "SortMergeJoin" in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, merged.collect()), key=repr) == a
    assert len(mix(docs, block_tokens=32).collect()) == token_blocks(docs, 32)[0].count()
    out = mixed_documents(docs, block_tokens=32)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_long_and_empty(spark, make_docs, odd_rows):
    blocks, _ = token_blocks(make_docs([r for r in odd_rows if r[0] == 7]))
    assert sum(b["n_tokens"] for b in blocks.collect()) == 40_000
    assert mix(make_docs([])).collect() == []
    assert mixed_documents(make_docs([(1, None, "en", "a"), (2, " ", "en", "a")])).collect() == []


def test_every_document_of_a_block_has_a_row(spark, make_docs, rows):
    langs = ["en", "de", "fr", None]
    docs = [(i, None if x is None else f"{x}\n\né{n}", langs[n % 4], source) for n, (i, x, _, source) in enumerate(rows)]
    blocks = mix(make_docs(docs), block_tokens=32).collect()
    got = mixed_documents(make_docs(docs), block_tokens=32).collect()
    assert Counter(i for b in blocks for i in b["doc_ids"]) == Counter(r["doc_id"] for r in got)
    assert sum((Counter(tokens(b["text"])) for b in blocks), Counter()) == sum((Counter(tokens(r["text"])) for r in got), Counter())
    whole = {(i, lang, source, x) for i, x, lang, source in docs if x}
    assert all(any((r["doc_id"], r["lang"], r["source"]) == w[:3] and r["text"] in w[3] for w in whole) for r in got)
