import random
import re

from triplane.llm.packing import TOKEN, first_fit_decreasing, pack, pack_texts


def naive(lengths, capacity):
    room, out = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= n
        out.append(b)
    return out


def test_tree_is_first_fit():
    rng = random.Random(1)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(0, 60))), reverse=True)
        assert first_fit_decreasing(lengths, 20) == naive(lengths, 20)


def test_every_token_once(spark, make_docs, odd_rows):
    rng = random.Random(2)
    rows = odd_rows + [(100 + i, "x " * rng.randint(1, 90), "en", "a") for i in range(300)]
    capacity = 64
    bins = pack(make_docs(rows), capacity, group_docs=50).collect()
    assert len({(b["pack_group"], b["pack"]) for b in bins}) == len(bins) and len({b["pack_group"] for b in bins}) > 3
    held = {}
    for b in bins:
        assert b["n_tokens"] == sum(b["lengths"]) <= capacity
        for i, start, n in zip(b["doc_ids"], b["starts"], b["lengths"], strict=True):
            held.setdefault(i, []).append((start, n))
    want = {}
    for i, t, *_ in rows:
        if n := len(re.findall(TOKEN, t or "")):
            want[i] = want.get(i, 0) + n
    assert {i: sum(n for _, n in parts) for i, parts in held.items()} == want
    for i in range(100, 400):
        parts = sorted(held[i])
        assert [s for s, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]


def test_groups_are_packed_first_fit(spark, make_docs):
    rng = random.Random(3)
    docs = make_docs([(i, "x " * rng.randint(1, 40), "en", "a") for i in range(200)])
    bins = pack(docs, 50, group_docs=60).collect()
    for b in {r["pack_group"] for r in bins}:
        own = sorted((r for r in bins if r["pack_group"] == b), key=lambda r: r["pack"])
        lengths = sorted((n for r in own for n in r["lengths"]), reverse=True)
        assert len(own) == max(naive(lengths, 50)) + 1
        assert sorted(sum(r["lengths"]) for r in own) == sorted(sum(n for n, at in zip(lengths, naive(lengths, 50), strict=True) if at == k) for k in range(len(own)))


def test_texts_are_those_of_the_pieces(spark, make_docs, odd_rows):
    rng = random.Random(5)
    rows = odd_rows + [(100 + i, " ".join(f"d{i}t{j}" for j in range(rng.randint(1, 90))) + "\n", "en", "a") for i in range(200)]
    docs = make_docs(rows)
    got = pack_texts(docs, 64, group_docs=50).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(map(tuple, pack(docs, 64, group_docs=50).collect()), key=repr)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t)
    whole = {}
    for r in got:
        for i, start, n, text in zip(r["doc_ids"], r["starts"], r["lengths"], r["texts"], strict=True):
            assert len(re.findall(TOKEN, text)) == n and any(text in t for t in texts[i] if t)
            whole.setdefault(i, []).append((start, text))
    for i in range(100, 300):  # every document again from its pieces
        assert "".join(t for _, t in sorted(whole[i])) == next(iter(texts[i]))
    small = pack_texts(docs, 64, group_docs=50, group_tokens=500).collect()
    assert len({r["pack_group"] for r in small}) > 20 and sum(r["n_tokens"] for r in small) == sum(r["n_tokens"] for r in got)


def test_large_ids_beside_null_ones(spark, make_docs):
    docs = make_docs([(2**62 + 1, "a b c", "en", "a"), (None, "a b c", "en", "a"), (0, "d", "en", "a")])
    for found in (pack(docs), pack_texts(docs)):
        assert [r["doc_ids"] for r in found.collect()] == [[2**62 + 1, None, 0]]


def test_empty(spark, make_docs):
    assert pack(make_docs([])).collect() == []
    assert pack_texts(make_docs([])).collect() == []
    assert pack_texts(make_docs([(1, None, "en", "a"), (2, " ", "en", "a")])).collect() == []
    assert pack(make_docs([(1, None, "en", "a"), (2, "", "en", "a")])).collect() == []
