"""Unbounded n-gram scores of stated documents under the language model of all the other documents of a corpus.

A suffix array for each shard of documents, as ``ngram_lm`` has, must be searched by every query: work that grows as queries
times shards. Here shards are of n-grams instead, by hash, so a query's n-gram is looked for in one shard, by binary search in
its sorted keys, and work grows as the corpus does. What is known of a query's start is the same in the end: for every length,
how many places in other documents match it.

Documents of one text count as one with a weight, so copies cost no more than one of them. Documents form blocks of about
``block_words`` words, coded by a vocabulary of the block. A round asks, for each open start
of a block, how often the n-gram of one length occurs: a block sends its distinct n-grams with their counts to the shards,
so a frequent one is one row a block, whatever its share; shards add the counts and answer in the order of what was sent.
Lengths are 1, 2 and 3 at once, of those n-grams only that queries have, by a bitmap of their hashes (1 and 2 of all n-grams,
where queries are more than a quarter of the words); then 4 and 5. By these counts neighbouring starts join to chains whose n-grams have
the same places, and the rounds go on in chains for words: 2 is known, 3, 4, 5, 10, 20 ... until no query shares the n-gram with another
document, then halfway between two lengths whose counts differ. All places of one n-gram were asked for the same lengths up to it, so the askers of an n-gram are
all its places; places that no query shares drop out, and words that no n-gram still asked about can reach. Rounds are about
twice the logarithm of the longest match and soon small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.llm.ngram_lm import SCORES, STRENGTH, score_columns, summary
from triplane.llm.tables import Kept, arrow_batches, materialize, release, tidy
from triplane.llm.words import _BASE, _INVERSE, _power, hash_words, mix

BLOCK_WORDS, SHARD_KEYS = 500_000, 2_000_000
#: Open intervals for which a round has one more task, up to the session's shuffle partitions: late rounds are small.
TASK_OPEN = 500_000
#: Lengths of a first round that looks at what queries have, and the most bits of that, as a power of two: 32 MB.
FIRST, GRAMS_POWER = 3, 28
#: Lengths are asked for one by one up to this, doubled beyond. When the next is known too, starts of this many words join.
EACH, JOINED = 5, 4
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ARRAYS = {"vocabulary": np.uint64, "codes": np.int32, "bounds": np.int64, "docs": np.int32, "offsets": np.int64, "asked": np.bool_, "weights": np.int64, "at": np.int32, "lo": np.int32, "hi": np.int32, "c_lo": np.int64, "c_hi": np.int64, "begin": np.int32, "width": np.int32, "reach": np.int32}
_FOUND = {"f_doc": np.int32, "f_start": np.int32, "f_length": np.int32, "f_places": np.int64, "f_width": np.int32}
_STATE = "block long, kind int, open long, " + ", ".join(f"{name} binary" for name in [*_ARRAYS, *_FOUND])


#: Made once a worker: each has memory of its own.
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """An array as its narrowest kind of number, the parts of one place in its numbers side by side, compressed. Ascending
    numbers are packed best by their differences."""
    if not len(a):
        return b""
    if a.dtype != np.uint64:
        low, high = (int(x) for x in (a.min(), a.max()))
        a = a.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if 0 <= low and high <= np.iinfo(k).max or k is np.int64))
    a = np.ascontiguousarray(a)
    unit = 2 if a.itemsize == 8 else 1
    return bytes([a.itemsize]) + _COMPRESSOR.compress(np.ascontiguousarray(a.view(f"u{unit}").reshape(len(a), -1).T))


def unpack(data: bytes | None, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    width = data[0]
    unit = 2 if width == 8 else 1
    planes = np.frombuffer(_DECOMPRESSOR.decompress(memoryview(data)[1:]), f"u{unit}").reshape(width // unit, -1)
    flat = np.ascontiguousarray(planes.T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64 if kind is np.uint64 else np.int64}[width]).ravel()
    return flat.astype(kind, copy=False)


def _used(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``size`` codes occur, in order, and each code's number among them."""
    some = np.zeros(size, bool)
    some[codes] = True
    return np.flatnonzero(some), (np.cumsum(some, dtype=np.int32) - np.int32(1))[codes]


@dataclass
class Grams:
    """The n-grams that queries have, as bits by the first bits of their hashes: others may be taken for one of them, but none of
    them is missed."""

    bits: np.ndarray
    power: int

    def sent(self) -> float:
        """Keys that blocks send for a word, about: all that the bits let through, and a third of a key that queries have."""
        return 1 / 3 + (FIRST - 1) * sum(int(np.unpackbits(x).sum()) for x in np.array_split(self.bits, 16)) / (8 * len(self.bits))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.power)
        return self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


@dataclass
class Block:
    """Stretches of documents (``docs``: numbers in the whole block; ``offsets``: words before; ``asked``: of a query; ``weights``:
    how many documents have this text) and open
    intervals of lengths: the n-gram from word ``at`` has c_lo places at length lo and c_hi at length hi, or no length is an end
    yet where hi is 0. A fresh block has no intervals: all is open.

    After ``joined``, each code is a chain of starts: ``width`` of them from word ``begin`` of the document on, its last n-gram
    ending ``reach`` words from there."""

    vocabulary: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray
    docs: np.ndarray
    offsets: np.ndarray
    asked: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    c_lo: np.ndarray
    c_hi: np.ndarray
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    width: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def questions(self, grams: Grams | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For each set of n-grams that is asked about: (intervals whose n-gram ends within its stretch, stretches, lengths,
        each interval's place among the keys); and the keys, distinct n-gram hashes in order. grams: what a fresh block asks about
        at all, and then lengths up to FIRST."""
        n = len(self.codes)
        part = self.stretches()
        sets, keys = [], []

        def add(inside: np.ndarray, length: np.ndarray, which: np.ndarray, own: np.ndarray) -> None:
            sets.append((inside, part[self.at[inside] if len(self.at) else inside], length, which + sum(map(len, keys))))
            keys.append(own)

        hashes = self.hashes()
        if len(self.at):
            length = np.where(self.hi > 0, (self.lo + self.hi) >> 1, np.where(self.lo < EACH, self.lo + 1, 2 * self.lo))
            inside = np.flatnonzero(self.at + length <= self.bounds[1:][part[self.at]])
            add(inside, length, *pd.factorize(hashes(self.at[inside], length[inside])))
        else:
            own = mix(self.vocabulary + _STEP)  # single words: the vocabulary knows them
            known = np.ones(len(own), bool) if grams is None else grams.has(own)
            open_ = known[self.codes]
            at = np.flatnonzero(open_)
            add(at, np.ones(n, np.int32), (np.cumsum(known) - 1)[self.codes[at]], own[known])
            for size in range(2, 3 if grams is None else FIRST + 1):  # a known n-gram's words and shorter n-grams are known
                at = at[at + size <= self.bounds[1:][part[at]]]
                at = at[open_[at + 1]]
                own = hashes(at, size)
                if grams is not None:
                    known = grams.has(own)
                    at, own = at[known], own[known]
                    open_ = np.zeros(n, bool)
                    open_[at] = True
                add(at, np.full(n, size, np.int32), *pd.factorize(own))
        merged = np.concatenate(keys)
        order = np.argsort(merged)
        rank = np.empty(len(merged), np.int64)
        rank[order] = np.arange(len(merged))
        return [(*x, rank[which]) for *x, which in sets], merged[order]

    def hashes(self) -> Callable[[np.ndarray, np.ndarray | int], np.ndarray]:
        """What gives the hashes of the n-grams of such starts and lengths."""
        n = len(self.codes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.vocabulary[self.codes] * _power(_BASE, n), out=total[1:])
        return lambda at, size: mix((total[at + size] - total[at]) * _power(_INVERSE, n + 1)[at] + np.asarray(size).astype(np.uint64) * _STEP)

    def of_queries(self) -> np.ndarray:
        """The hashes of the n-grams of up to FIRST words that a query has."""
        part, hashes = self.stretches(), self.hashes()
        at = np.flatnonzero(self.asked[part])
        found = [mix(self.vocabulary[np.unique(self.codes[at])] + _STEP)]
        for size in range(2, FIRST + 1):
            at = at[at + size <= self.bounds[1:][part[at]]]
            found.append(hashes(at, size))
        return np.concatenate(found)

    def stretches(self) -> np.ndarray:
        """The stretch of each word."""
        return np.repeat(np.arange(len(self.docs), dtype=np.int32), np.diff(self.bounds))

    def kept(self, at: np.ndarray, lo: np.ndarray, c_lo: np.ndarray, hi: np.ndarray, c_hi: np.ndarray) -> Block:
        """These intervals, those without an end first and in order, and the stretches that they can reach into."""
        n = len(self.codes)
        ends = np.minimum(at + hi, self.bounds[1:][self.stretches()[at]])
        free = np.count_nonzero(hi == 0)
        if free:  # a match that goes on goes on from the next word too: it ends where a run of such starts does
            last = np.append(np.flatnonzero(np.diff(at[:free]) != 1), free - 1)
            ends[:free] = (at[last] + lo[last])[np.searchsorted(last, np.arange(free))]
        covered = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:n] > 0
        begins = covered & ~np.append(False, covered[:-1])
        begins[self.bounds[:-1]] = covered[self.bounds[:-1]]
        begins = np.flatnonzero(begins)
        part = np.searchsorted(self.bounds, begins, side="right") - 1
        place = np.cumsum(covered) - 1
        used, codes = _used(self.codes[covered], len(self.vocabulary))
        return Block(self.vocabulary[used], codes, np.append(place[begins], len(codes)), self.docs[part], self.offsets[part] + begins - self.bounds[part], self.asked[part], self.weights[part], place[at], lo, hi, c_lo, c_hi, *(x[covered] if len(x) else x for x in (self.begin, self.width, self.reach)))

    def joined(self, c: np.ndarray, own: np.ndarray) -> tuple[Block | None, list[np.ndarray]]:
        """Starts that follow each other, of n-grams that have the same places but for the shift, as one code: c, the count of the
        n-gram longer by a word, is that of both. Every place of one of them is part of a place of the whole chain, so all
        blocks cut the same chains. own: the n-grams longer by a word in the document itself. Also what queries found."""
        at, size, n = self.at.astype(np.int64), int(self.lo[0]), len(self.at)
        follows = np.append(np.diff(at) == 1, False)  # a count of 0 ends the chain where the document does
        same = follows & (c == self.c_lo) & (c == np.append(self.c_lo[1:], 0))
        first = np.flatnonzero(~np.append(False, same[:-1]))
        last = np.append(first[1:], n) - 1
        part = self.stretches()[at[first]]
        begin, width = self.offsets[part] + at[first] - self.bounds[part], last - first + 1
        reach = width - 1 + size
        vocabulary, codes = np.unique(self.hashes()(at[first], size), return_inverse=True)
        new = np.ones(len(first), bool)
        new[1:] = ~follows[last[:-1]] | (part[1:] != part[:-1])
        new = np.flatnonzero(new)
        none = np.zeros(0, np.int64)
        whole = Block(vocabulary, codes, np.append(new, len(first)), self.docs[part[new]], np.zeros(len(new), np.int64), self.asked[part[new]], self.weights[part[new]], none, none, none, none, none, begin, width, reach)
        on = np.flatnonzero(c[last] > 0)  # two chains have the places of the n-gram where they meet
        found = []
        mine = np.flatnonzero(self.asked[part] & (width > 1))
        doc = self.docs[part]
        which, pairs = pd.factorize((codes[self.asked[part]].astype(np.int64) << 32) + doc[self.asked[part]])
        times = np.zeros(len(first), np.int64)
        times[self.asked[part]] = np.bincount(which, minlength=len(pairs))[which]
        found.append((doc[mine], begin[mine], reach[mine], self.c_lo[first[mine]] - times[mine], width[mine]))
        mine = on[self.asked[part[on]]]
        found.append((doc[mine], begin[mine], begin[mine + 1] + reach[mine + 1] - begin[mine], c[last[mine]] - own[last[mine]], width[mine]))
        two, zero = np.full(len(on), 2, np.int32), np.zeros(len(on), np.int32)
        return whole.kept(on, two, c[last[on]], zero, zero) if len(on) else None, [np.concatenate(x) for x in zip(*found, strict=True)]

    def row(self) -> dict[str, bytes]:
        return {f.name: pack(getattr(self, f.name)) for f in fields(self)}


def _read(table: pa.Table | pa.RecordBatch, i: int = 0) -> Block:
    return Block(**{name: unpack(table.column(name)[i].as_py(), kind) for name, kind in _ARRAYS.items()})


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = dict(x.split() for x in schema.split(", "))
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in names.items()})


_SENT = "shard int, block long, keys binary, counts binary"
_ANSWER = "block long, shard int, counts binary"


def _sent(block: int, b: Block, shards: int, grams: Grams | None = None) -> pa.Table:
    """A row for each shard that holds n-grams of the block: sorted keys, and in one number how often each occurs here, whether
    several documents have it and whether a query has."""
    sets, keys = b.questions(grams)
    part, which = np.concatenate([x[1] for x in sets]), np.concatenate([x[3] for x in sets])
    doc = b.docs[part]
    query, last, many = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    query[which[b.asked[part]]] = True
    last[which] = doc
    many[which[(doc != last[which]) | (b.weights[part] > 1)]] = True
    counts = np.bincount(which, weights=b.weights[part], minlength=len(keys)).astype(np.int64) << 2 | many.astype(np.int64) << 1 | query
    cut = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
    rows: dict[str, list] = {x.split()[0]: [] for x in _SENT.split(", ")}
    for k in np.flatnonzero(np.diff(cut)):
        p = slice(cut[k], cut[k + 1])
        for name, x in zip(rows, (k, block, pack(np.diff(keys[p], prepend=np.uint64(0))), pack(counts[p])), strict=True):
            rows[name].append(x)
    return _table(rows, _SENT)


def _counted(table: pa.Table) -> pa.Table:
    """The answers of a shard: each n-gram's places, 0 unless a query and another document have it."""
    keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x, np.int64) for x in table.column("counts").to_pylist()])
    ends = np.cumsum([len(k) for k in keys])[:-1]
    which, own = pd.factorize(np.concatenate(keys))
    del keys
    places = np.bincount(which, weights=counts >> 2, minlength=len(own)).astype(np.int64)
    query, many = np.zeros(len(own), bool), np.bincount(which, minlength=len(own)) > 1
    query[which[counts & 1 > 0]] = True
    many[which[counts & 2 > 0]] = True
    places[~(query & many)] = 0
    return _table({"block": table.column("block"), "shard": table.column("shard"), "counts": [pack(x) for x in np.split(places[which], ends)]}, _ANSWER)


def _next(state: pa.Table, answers: pa.Table, grams: Grams | None = None) -> pa.Table:
    """A row (kind 0) with the block's intervals that are still open, and one (kind 1) with what queries found."""
    block, b = state.column("block")[0].as_py(), _read(state)
    parts = answers.column("counts").to_pylist()
    counted = np.concatenate([np.zeros(0, np.int64), *(unpack(parts[i], np.int64) for i in np.argsort(answers.column("shard").to_numpy()))])
    found: dict[str, list] = {name: [] for name in _FOUND}
    joins = len(b.at) > 0 and not len(b.begin) and b.lo[0] == JOINED
    for inside, part, length, which in b.questions(grams)[0]:
        c = np.zeros(len(length), np.int64)
        c[inside] = counted[which]
        mine = np.flatnonzero(b.asked[part] & (c[inside] > 0))
        doc, at = b.docs[part[mine]].astype(np.int64), inside[mine]
        same, pairs = pd.factorize((which[mine] << 32) + doc)
        times = np.bincount(same, minlength=len(pairs))[same]
        if joins:
            own = np.zeros(len(length), np.int64)
            own[at] = times
            break
        word = b.at[at] if len(b.at) else at
        if len(b.begin):
            end = word + length[at] - 1
            start, words, width = b.begin[word], b.begin[end] + b.reach[end] - b.begin[word], b.width[word]
        else:
            start, words, width = b.offsets[part[mine]] + word - b.bounds[part[mine]], length[at], np.ones(len(at), np.int32)
        for name, x in zip(_FOUND, (doc, start, words, c[at] - times, width), strict=True):
            found[name].append(x)
    rows = []
    none = dict.fromkeys([*_ARRAYS, *_FOUND])
    if joins:
        left, results = b.joined(c, own)
        for name, x in zip(_FOUND, results, strict=True):
            found[name].append(x)
        if left:
            rows.append(none | {"block": block, "kind": 0, "open": len(left.at)} | left.row())
        return _state(rows, block, found)
    if len(b.at):
        at, lo, hi, c_lo, c_hi = b.at, b.lo, b.hi, b.c_lo, b.c_hi
    else:  # all lengths up to the last are settled
        at = np.arange(len(b.codes), dtype=np.int32)
        lo, hi, c_lo, c_hi = length - np.int32(1), np.zeros(len(at), np.int32), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    further = (hi == 0) & (c > 0)
    below = (length - lo > 1) & (c != c_lo)
    above = (hi - length > 1) & (c != c_hi)
    zero = np.zeros(np.count_nonzero(further), np.int32)
    intervals = [np.concatenate(x) for x in zip((at[further], length[further], c[further], zero, zero), (at[below], lo[below], c_lo[below], length[below], c[below]), (at[above], length[above], c[above], hi[above], c_hi[above]), strict=True)]
    if len(intervals[0]):
        rows.append(none | {"block": block, "kind": 0, "open": len(intervals[0])} | b.kept(*intervals).row())
    return _state(rows, block, found)


def _state(rows: list[dict], block: int, found: dict[str, list[np.ndarray]]) -> pa.Table:
    if any(map(len, found["f_doc"])):
        rows = [*rows, dict.fromkeys(_ARRAYS) | {"block": block, "kind": 1, "open": 0} | {name: pack(np.concatenate(found[name])) for name in _FOUND}]
    return _table({x.split()[0]: [r[x.split()[0]] for r in rows] for x in _STATE.split(", ")}, _STATE)


def _next_with(shared: Broadcast | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda state, answers: _next(state, answers, shared and shared.value)


_FRESH = ("vocabulary", "codes", "bounds", "docs", "offsets")
_WORDS = "block long, kind int, words long, documents array<struct<doc:int,n:long,query:boolean,key:binary,item_id:{id}>>, " + ", ".join(f"{c} binary" for c in _FRESH)


def _blocks(rows: DataFrame, block_words: int, id_type: str) -> DataFrame:
    """Two rows for each block, from rows (item_id, text, query, key): kind 0 has its words, kind 1 its documents."""

    def built(batches):
        columns, sizes, words, held, made = [], [], [], 0, TaskContext.get().partitionId() << 32

        def out():
            codes, distinct = pd.factorize(np.concatenate(words))
            order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            n = np.concatenate(sizes)
            full = np.flatnonzero(n)
            fresh = {"vocabulary": distinct[order], "codes": rank[codes], "bounds": np.concatenate([[0], np.cumsum(n[full])]), "docs": full, "offsets": np.zeros(len(full), np.int64)}
            ids, queries, keys = (pa.concat_arrays(x) for x in zip(*columns, strict=True))
            each = pa.StructArray.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n, pa.int64()), queries, keys, ids], ["doc", "n", "query", "key", "item_id"])
            parts = [pa.array([made] * 2), pa.array([0, 1], pa.int32()), pa.array([len(codes)] * 2), pa.ListArray.from_arrays(pa.array([0, 0, len(n)], pa.int32()), each), *(pa.array([pack(fresh[c]), None], pa.binary()) for c in _FRESH)]
            return pa.RecordBatch.from_arrays(parts, ["block", "kind", "words", "documents", *_FRESH])

        for batch in batches:
            w = hash_words(batch.column("text").to_pylist())
            n = np.diff(w.bounds)
            keep = pa.array((n > 0) | np.array(batch.column("query").to_pylist(), bool))
            columns.append([batch.column(c).filter(keep) for c in ("item_id", "query", "key")])
            sizes.append(n[keep.to_numpy(zero_copy_only=False)])
            words.append(w.hashes)
            held += len(w.hashes)
            if held >= block_words:
                yield out()
                columns, sizes, words, held, made = [], [], [], 0, made + 1
        if sizes:
            yield out()

    return rows.mapInArrow(built, _WORDS.format(id=id_type))


def _distinct(words: pa.Table, chosen: pa.Table) -> pa.Table:
    """A block's first state: its words, without documents that another stands for."""
    if not chosen.num_rows:
        return _table({x.split()[0]: [] for x in _STATE.split(", ")}, _STATE).drop_columns(["kind", *_FOUND])
    fresh = {name: unpack(words.column(name)[0].as_py(), _ARRAYS[name]) for name in _FRESH}
    order = np.argsort(chosen.column("doc").to_numpy())
    doc, weight, asked = (chosen.column(c).to_numpy()[order] for c in ("doc", "weight", "asked"))
    stays, n = np.isin(fresh["docs"], doc), np.diff(fresh["bounds"])
    used, codes = _used(fresh["codes"][np.repeat(stays, n)], len(fresh["vocabulary"]))
    none = np.zeros(0, np.int64)
    b = Block(fresh["vocabulary"][used], codes, np.concatenate([[0], np.cumsum(n[stays])]), fresh["docs"][stays], fresh["offsets"][stays], asked, weight, none, none, none, none, none)
    row = b.row() | {"block": words.column("block")[0].as_py(), "open": len(codes), "kind": 0} | dict.fromkeys(_FOUND)
    return _table({k: [v] for k, v in row.items()}, _STATE).drop_columns(["kind", *_FOUND])


def _grams(state: DataFrame, query_words: int) -> Grams:
    """What queries have, of a size that follows their words as far as GRAMS_POWER."""
    power = min(max((4 * FIRST * query_words).bit_length(), 16), GRAMS_POWER)
    low = power - min(4, max(power - 16, 0))  # bits are set in up to 16 ranges

    def ones(batches):
        held: list[np.ndarray] = []

        def out():
            at = np.unique(np.concatenate(held))
            cut = np.searchsorted(at, np.arange((1 << power - low) + 1, dtype=np.uint64) << np.uint64(low))
            return pa.RecordBatch.from_pylist([{"range": k, "bits": pack(np.diff(at[cut[k] : cut[k + 1]] - np.uint64(k << low), prepend=np.uint64(0)))} for k in np.flatnonzero(np.diff(cut)).tolist()], pa.schema([("range", pa.int32()), ("bits", pa.binary())]))

        for batch in batches:
            for i in range(batch.num_rows):
                held.append(np.unique(_read(batch, i).of_queries() >> np.uint64(64 - power)))
                if sum(map(len, held)) > 2_000_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def joined(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << low, bool)
        for x in table.column("bits").to_pylist():
            bits[np.cumsum(unpack(x, np.uint64), dtype=np.uint64).astype(np.int64)] = True
        return pa.table({"range": table.column("range")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    kind = "range int, bits binary"
    bits = np.zeros(1 << power - 3, np.uint8)
    for r in state.mapInArrow(ones, kind).groupBy("range").applyInArrow(joined, kind).toLocalIterator():
        bits[r["range"] << low - 3 : r["range"] + 1 << low - 3] = np.frombuffer(r["bits"], np.uint8)
    return Grams(bits, power)


def _rounds(spark: SparkSession, state: DataFrame, shard_keys: int, query_words: int = 0) -> list[Kept]:
    """The tables of all rounds; rows of kind 1 are what queries found. state: a written table, released when it was read.
    query_words: of all queries, where they are few enough for a look at what they have."""
    tables: list[Kept] = []
    grams = _grams(state, query_words) if query_words else None
    shared = grams and spark.sparkContext.broadcast(grams)
    while open_ := state.agg(F.sum("open")).first()[0]:
        shards = max(1, -(-int(open_ * (grams.sent() if grams else 1)) // shard_keys))

        def sent(batches, shards=shards, shared=shared):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from _sent(batch.column("block")[i].as_py(), _read(batch, i), shards, shared and shared.value).to_batches()

        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-open_ // TASK_OPEN))
        answers = state.mapInArrow(sent, _SENT).repartition(tasks, "shard").groupBy("shard").applyInArrow(_counted, _ANSWER)
        after = state.repartition(tasks, "block").groupBy("block").cogroup(answers.repartition(tasks, "block").groupBy("block")).applyInArrow(_next_with(shared), _STATE)
        tables.append(Kept(after, "kind"))
        if shared:
            shared.destroy()
            grams = shared = None
        if len(tables) > 1:
            tables[-2].drop(0)
        else:
            release(state)
        state = tables[-1].read(0).select("block", "open", *_ARRAYS)
    return tables


def score_documents(docs: DataFrame, asked: Column | None = None, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH, block_words: int = BLOCK_WORDS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(item_id, n_tokens, bits_per_word, perplexity, mean_context, longest_context) for each row of docs that meets ``asked``
    (every row where it is not given), repeated rows included, under the language model of all the other rows of docs.

    Null and empty texts have 0 tokens and null scores. Where no other row has words, every word has probability 1. No match
    crosses a document's end. No docs, or none asked for, give no rows; other columns play no part. A document is worked on
    whole, in one task.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    query = F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(True)
    rows = docs.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"), query.alias("query"), F.unhex(F.md5(text_col)).alias("key"))
    id_type = rows.schema["item_id"].dataType.simpleString()
    blocks = Kept(_blocks(rows, block_words, id_type), "kind")
    every = blocks.read(1)
    size = every.agg(F.sum("words")).first()[0] or 0
    single = every.select("block", F.inline("documents"))
    query_words = single.where("query").agg(F.sum("n")).first()[0] or 0
    alike = single.where("n > 0").groupBy("key").agg(F.min(F.struct("block", "doc")).alias("first"), F.count(F.lit(1)).alias("weight"), F.max("query").alias("asked"))
    alike = materialize(alike.select("key", F.col("first.block").alias("in_block"), F.col("first.doc").alias("in_doc"), "weight", "asked"))
    chosen = alike.select(F.col("in_block").alias("block"), F.col("in_doc").alias("doc"), "weight", "asked")
    fresh = blocks.read(0).select("block", *_FRESH).groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(_distinct, _STATE.replace("kind int, ", "").partition(", f_doc")[0])
    with tidy(spark):
        state = materialize(fresh)
        blocks.drop(0)
        found = [t.read(1) for t in _rounds(spark, state, shard_keys, query_words if 4 * query_words <= size else 0)]
    parts = spark.createDataFrame([], "block long, " + ", ".join(f"{c} binary" for c in _FOUND))
    for f in found:
        parts = parts.union(f.select("block", *_FOUND))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, start, length, places, width = (np.concatenate([unpack(x, kind) for x in right.column(c).to_pylist()] or [np.zeros(0, kind)]).astype(np.int64) for c, kind in _FOUND.items())
        within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)  # each start of a chain
        doc, start, length, places = np.repeat(doc, width), np.repeat(start, width) + within, np.repeat(length, width) - within, np.repeat(places, width)
        order = np.lexsort((length, start, doc))
        doc, start, length, places = doc[order], start[order], length[order], places[order]
        scores: dict[int, tuple] = {}  # copies have those of the one that stands for them
        for d, n in zip(left.column("doc").to_pylist(), left.column("n").to_pylist(), strict=True):
            if d not in scores:
                a, b = np.searchsorted(doc, [d, d + 1])
                scores[d] = summary(start[a:b], length[a:b], places[a:b], n, size - n, strength)
        return pa.table({"item_id": left.column("item_id")} | score_columns([scores[d] for d in left.column("doc").to_pylist()]))

    asked_for = single.where("query").join(alike.select("key", "in_block", "in_doc"), "key", "left")
    # texts without words stand for themselves
    asked_for = asked_for.select(F.when(F.col("n") > 0, F.col("in_block")).otherwise(F.col("block")).alias("block"), F.when(F.col("n") > 0, F.col("in_doc")).otherwise(F.col("doc")).alias("doc"), "n", "item_id")
    return asked_for.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(score, f"item_id {id_type}, {SCORES}")
