"""Unbounded n-gram language model over sharded suffix arrays of a corpus.

The corpus is cut into shards of about ``shard_tokens`` words where it is read, so no text is shuffled. Each shard sorts its
suffixes, and for each start in a query narrows an interval of the suffix array by binary search, word by word, as far as
anything matches. What leaves a shard is, for each query start, how many of its places match for exactly how many words;
summed over shards, these numbers give the count of every n-gram of the query, of any length.

A word's probability starts from its share of the corpus (an unseen word has the share of one occurrence) and is refined
by each longer context that the corpus holds: p = (count(context word) + strength * p') / (count(context) + strength), p' being
that of the next shorter one. Contexts that occur at the same places say the same and are one, of which the longest stands.

Work grows as corpus size times log, plus query words times shards. Queries are read in passes of ``pass_words`` words; it is
meant for evaluation texts against a corpus. For the documents of a corpus against each other see ``document_lm``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.llm.tables import arrow_batches, materialize
from triplane.llm.words import hash_words

SHARD_TOKENS, PASS_WORDS, STRENGTH = 3_000_000, 2_000_000, 1.0
SCORES = "n_tokens long, bits_per_word double, perplexity double, mean_context double, longest_context long"


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` tokens at least, by prefix doubling; each round sorts
    only the suffixes that are still tied."""
    n = len(tokens)
    sa = np.argsort(tokens, kind="stable")
    rank = np.empty(n, np.int64)
    pos, suffix, key = np.arange(n), sa, tokens[sa].astype(np.int64)
    h = 1
    while len(pos):
        new = np.ones(len(pos), bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(new, pos, 0))
        tied = ~(new & np.append(new[1:], True))
        pos, suffix = pos[tied], suffix[tied]
        if h >= depth or not len(pos):
            break
        after = suffix + h
        key = rank[suffix] * (n + 2) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        suffix, key = suffix[order], key[order]
        sa[pos] = suffix
        h *= 2
    return sa


def match_lengths(tokens: np.ndarray, sa: np.ndarray, query: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, places): for each start in ``query``, how many suffixes share exactly ``length`` > 0 tokens with what
    follows it up to its end in ``ends``."""
    n = len(tokens)
    start = np.arange(len(query))
    lo, hi, before = np.zeros(len(query), np.int64), np.full(len(query), n, np.int64), np.full(len(query), -1, np.int64)
    out = []
    t = 0
    while len(start):
        inside = start + t < ends[start]
        want = np.where(inside, query[np.minimum(start + t, len(query) - 1)], -1)
        bounds = []
        for upper in (False, True):
            a, b = lo.copy(), np.where(want < 0, lo, hi)
            while True:
                live = a < b
                if not live.any():
                    break
                mid = (a + b) >> 1
                at = sa[np.minimum(mid, n - 1)] + t
                got = np.where(at < n, tokens[np.minimum(at, n - 1)], -1)
                right = live & ((got <= want) if upper else (got < want))
                a = np.where(right, mid + 1, a)
                b = np.where(live & ~right, mid, b)
            bounds.append(a)
        first, last = bounds
        last = np.where(want < 0, first, last)
        now = last - first
        lost = (before > now) & (before > 0)
        out.append((start[lost], np.full(lost.sum(), t, np.int64), (before - now)[lost]))
        go = now > 0
        start, lo, hi, before = start[go], first[go], last[go], now[go]
        t += 1
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _counted(corpus: DataFrame, hashes: np.ndarray, ends: np.ndarray, shard_tokens: int) -> DataFrame:
    """(start, length, places) summed over shards; start -1 has the corpus size."""
    depth = int((ends - np.arange(len(ends))).max(initial=0)) + 1

    def search(parts: list[np.ndarray]):
        if not parts:
            return
        words = np.concatenate(parts)
        vocabulary, tokens = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        query = np.where((vocabulary[at] == hashes) & (hashes != 0), at, -1)
        tokens = tokens.astype(np.int32)
        got = match_lengths(tokens, suffix_array(tokens, depth), query, ends)
        cols = [np.append(g, x) for g, x in zip(got, (-1, 0, np.count_nonzero(words)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["start", "length", "places"])

    def shards(batches):
        parts, held = [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            w = hash_words(texts)
            h = np.where(w.hashes == 0, np.uint64(1), w.hashes)
            full = np.diff(w.bounds) > 0
            parts.append(np.insert(h, w.bounds[1:][full], 0))  # 0 ends a document: no match runs past it
            held += len(parts[-1])
            if held >= shard_tokens:
                yield from search(parts)
                parts, held = [], 0
        yield from search(parts)

    return corpus.mapInArrow(shards, "start long, length long, places long").groupBy("start", "length").agg(F.sum("places").alias("places"))


def at_least(start: np.ndarray, length: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By start and length, from the places that share exactly a length, those that share it at least."""
    order = np.lexsort((length, start))
    start, length, places = start[order], length[order], places[order]
    total = np.append(np.cumsum(places[::-1])[::-1], 0)
    return start, length, total[:-1] - total[np.searchsorted(start, start, side="right")]


def word_probabilities(start: np.ndarray, length: np.ndarray, places: np.ndarray, n: int, corpus_size: int, strength: float = STRENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(probability, longest context) of each of a text's n words. (start, length, places), in order: places that match
    ``length`` words from ``start``; a length left out has the places of the next longer one of its start."""
    first = np.searchsorted(start, np.arange(n + 1))
    key = start * (n + 2) + length

    def count(i: np.ndarray, size: np.ndarray) -> np.ndarray:
        at = np.searchsorted(key, i * (n + 2) + size)
        return np.where(at < first[i + 1], places[np.minimum(at, len(key) - 1)], 0) if len(key) else np.zeros(len(i), np.int64)

    j = np.arange(n)
    longest = np.zeros(n, np.int64)
    some = first[1:] > first[:-1]
    longest[some] = length[first[1:][some] - 1]
    # where a match ends never falls from one start to the next, so a word's longest context is found by bisection
    i = np.searchsorted(j + longest, j)
    context = j - i
    # p = known + rest * p of the contexts still to come, from the longest on
    known, rest, todo = np.zeros(n), np.ones(n), np.flatnonzero(context > 0)
    while len(todo):
        at, to = i[todo], j[todo]
        held = count(at, to - at)
        known[todo] += rest[todo] * count(at, to - at + 1) / (held + strength)
        rest[todo] *= strength / (held + strength)
        low, high = at + 1, to.copy()  # the next is the longest context with more places
        while (open_ := low < high).any():
            mid = (low + high) // 2
            more = count(np.minimum(mid, n - 1), np.maximum(to - mid, 1)) > held
            high, low = np.where(open_ & more, mid, high), np.where(open_ & ~more, mid + 1, low)
        i[todo] = low
        todo = todo[(low < to) & (rest[todo] > 1e-18 * known[todo])]
    return known + rest * np.maximum(count(j, np.ones(n, np.int64)), 1) / (corpus_size + 1), context


def summary(start: np.ndarray, length: np.ndarray, places: np.ndarray, n: int, corpus_size: int, strength: float) -> tuple:
    """A text's row of scores; see ``word_probabilities``."""
    if not n:
        return 0, None, None, None, None
    p, context = word_probabilities(start, length, places, n, corpus_size, strength)
    bits = float(-np.log2(p).mean())
    return n, bits, 2.0**bits, float(context.mean()), int(context.max())


def score_columns(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = {"n_tokens": pa.int64(), "bits_per_word": pa.float64(), "perplexity": pa.float64(), "mean_context": pa.float64(), "longest_context": pa.int64()}
    return {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}


def score_texts(queries: DataFrame, corpus: DataFrame, id_col: str = "item_id", text_col: str = "text", corpus_text_col: str = "text", strength: float = STRENGTH, shard_tokens: int = SHARD_TOKENS, pass_words: int = PASS_WORDS) -> DataFrame:
    """(item_id, n_tokens, bits_per_word, perplexity, mean_context, longest_context) for each row of queries, repeated rows
    included, under the language model of all of corpus.

    Null and empty query texts have 0 tokens and null scores. Null and empty corpus texts add nothing; with an empty corpus
    every word has probability 1. No match crosses a document's end. Queries without rows give no rows; other columns of either
    play no part.
    """
    spark = queries.sparkSession
    arrow_batches(spark)
    texts = corpus.select(F.col(corpus_text_col).alias("text")).where("text is not null and text <> ''")
    rows = queries.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["item_id"].dataType.simpleString()
    results, chunk, words = [], [], 0

    def one_pass(chunk: list) -> DataFrame:
        w = hash_words([t for _, t in chunk])
        hashes = np.where(w.hashes == 0, np.uint64(1), w.hashes)
        ends = np.repeat(w.bounds[1:], np.diff(w.bounds))
        found = materialize(_counted(texts, hashes, ends, shard_tokens))
        corpus_size = found.where("start = -1").agg(F.sum("places")).first()[0] or 0
        bounds = w.bounds

        def owned(batches):
            for b in batches:
                s = b.column("start").to_numpy()
                q = np.searchsorted(bounds, s, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(s - bounds[q]), b.column("length"), b.column("places")], ["q", "start", "length", "places"])

        def score(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
            q = int(key[0])
            df = df[df["length"] > 0]
            counts = at_least(df["start"].to_numpy(), df["length"].to_numpy(), df["places"].to_numpy())
            return pd.DataFrame([(q, *summary(*counts, int(bounds[q + 1] - bounds[q]), corpus_size, strength))], columns=["q", "n_tokens", "bits_per_word", "perplexity", "mean_context", "longest_context"])

        counts = found.where("start >= 0").mapInArrow(owned, "q long, start long, length long, places long")
        every = spark.range(len(chunk)).selectExpr("id as q", "0L as start", "0L as length", "0L as places")
        scored = counts.union(every).groupBy("q").applyInPandas(score, f"q long, {SCORES}")
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(chunk)], f"q long, item_id {id_type}")
        return ids.join(scored, "q").drop("q")

    for row in rows.toLocalIterator():  # one pass is held at a time
        chunk.append((row["item_id"], row["text"]))
        words += len((row["text"] or "").split())
        if words >= pass_words:
            results.append(one_pass(chunk))
            chunk, words = [], 0
    if chunk or not results:
        if not chunk:
            return spark.createDataFrame([], f"item_id {id_type}, {SCORES}")
        results.append(one_pass(chunk))
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out
