"""Mixing sources to target weights over fixed-length token blocks.

1. Each source's documents, in a seeded random order, form one token stream, cut every ``block_tokens`` tokens. Documents
   are shuffled once, by (source, random group); a group's place in its stream follows from the groups' token totals, so
   blocks that lie within a group need nothing else and only the two at its ends are joined from parts.
2. Every output shard of ``shard_blocks`` slots draws its counts of sources from a multinomial with the target weights.
3. A source's slots are numbered through all shards. Number q maps to block perm(q mod B) in pass q div B, where perm is a
   pseudorandom permutation of the source's B blocks, another in each pass: no block repeats before all were used.
4. Slots and blocks are joined by (source, index).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplane.llm.packing import TOKEN, token_count
from triplane.llm.tables import arrow_batches, materialize

BLOCK_TOKENS, SHARD_BLOCKS, GROUP_TOKENS = 512, 256, 1 << 20
#: Slots, rows of some 60 bytes, that are broadcast to the blocks at most; a merge join takes over beyond. The planner would
#: judge by the few rows that slots are drawn from.
BROADCAST_SLOTS = 500_000
#: Without given weights a source's weight is its tokens to this power, so small sources gain.
TEMPERATURE = 0.7
BREAK = "\n\n"
_PIECE = re.compile(TOKEN)
BLOCK = "source string, block long, part int, n_tokens long, doc_ids array<long>, langs array<string>, chars array<int>, lang string, text string"


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index in [0, size) through a keyed permutation of [0, size): a four-round Feistel network over the next even
    power of two, walked until it falls inside."""
    index, size, key = (np.asarray(x, np.int64) for x in (index, size, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + k + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo &= out >= size.astype(np.uint64)
    return out.astype(np.int64)


def _cut(batches, block_tokens: int):
    """Parts of blocks from rows in stream order. A block wholly inside a group is part -1; others are numbered by group."""
    open_ = None  # source, group, block, tokens held of it, tokens it began with, texts, ids, lang, langs

    def close(state, full: bool):
        source, group, block, held, began, texts, ids, lang, langs = state
        return source, block, -1 if full and began == 0 else group, held - began, ids, langs, [len(t) for t in texts], lang, BREAK.join(texts)

    for batch in batches:
        out = []
        for source, group, offset, id_, lang, text in zip(*(batch.column(c).to_pylist() for c in ("source", "group", "offset", "id", "lang", "text")), strict=True):
            if open_ is not None and (open_[0], open_[1]) != (source, group):
                if open_[3] > open_[4]:
                    out.append(close(open_, False))
                open_ = None
            if open_ is None:
                began = offset % block_tokens
                open_ = [source, group, offset // block_tokens, began, began, [], [], lang, []]
            starts = [m.start() for m in _PIECE.finditer(text)]
            at = 0
            while at < len(starts):
                if not open_[6]:
                    open_[7] = lang
                take = min(block_tokens - open_[3], len(starts) - at)
                end = starts[at + take] if at + take < len(starts) else len(text)
                open_[5].append(text[starts[at] if at else 0 : end])
                open_[6].append(id_)
                open_[8].append(lang)
                open_[3] += take
                at += take
                if open_[3] == block_tokens:
                    out.append(close(open_, True))
                    open_ = [source, group, open_[2] + 1, 0, 0, [], [], lang, []]
        if out:
            yield _batch(out)
    if open_ is not None and open_[3] > open_[4]:
        yield _batch([close(open_, False)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    source, block, part, n, ids, langs, chars, lang, text = map(list, zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(source, pa.string()), pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(langs, pa.list_(pa.string())), pa.array(chars, pa.list_(pa.int32())), pa.array(lang, pa.string()), pa.array(text, pa.string())], ["source", "block", "part", "n_tokens", "doc_ids", "langs", "chars", "lang", "text"])


def token_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, group_tokens: int = GROUP_TOKENS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(blocks, totals): blocks (source, block, n_tokens, doc_ids, langs, chars, lang, text) of each source numbered from 0, the last of a
    source possibly short; totals (source, tokens). docs needs doc_id, text, lang and source; a null source is a source of
    its own; rows without tokens are in no block. doc_ids, with their langs and the characters of their pieces, are in order of their text; lang is the first document's."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"), F.col("lang").alias("lang"), F.col("source").cast("string").alias("source"))
    rank = F.xxhash64(F.lit(seed), "id", F.md5("text"))
    # a source's name as a key that is never null, so that joins and shuffles hash on the same columns
    name = F.concat(F.when(F.col("source").isNull(), "-").otherwise("="), F.coalesce("source", F.lit("")))
    counted = materialize(rows.select(name.alias("name"), "source", rank.alias("rank"), token_count(F.col("text")).alias("n")).where("n > 0"))
    totals = materialize(counted.groupBy("name", "source").agg(F.sum("n").alias("tokens")))
    # a source of T tokens has ceil(T / group_tokens) groups, each an equal range of ranks, whatever T
    sizes = totals.select("name", F.ceil(F.col("tokens") / group_tokens).alias("groups"))

    def grouped(df: DataFrame) -> DataFrame:
        share = F.shiftrightunsigned("rank", 11) / float(1 << 53)
        return df.join(sizes, "name").withColumn("group", F.least(F.floor(share * F.col("groups")), F.col("groups") - 1).cast("int")).drop("groups")

    groups = grouped(counted).groupBy("name", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("name", "group", (F.sum("n").over(Window.partitionBy("name").orderBy("group")) - F.col("n")).alias("offset"))
    # texts move once: the join finds them where the repartitioning put them
    streams = grouped(rows.where("text is not null").withColumn("rank", rank).withColumn("name", name)).repartition("name", "group")
    streams = streams.join(groups, ["name", "group"]).sortWithinPartitions("name", "group", "rank", "id", "text")
    parts = streams.select("source", "group", "offset", "id", "lang", "text").mapInArrow(lambda b: _cut(b, block_tokens), BLOCK)
    parts = materialize(parts)
    whole = parts.where("part = -1").select("source", "block", "n_tokens", "doc_ids", "langs", "chars", "lang", "text")
    joined = parts.where("part >= 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "doc_ids", "langs", "chars", "lang", "text"))).alias("p"))
    joined = joined.select("source", "block", "n_tokens", *[F.flatten(F.transform("p", lambda x: x[c])).alias(c) for c in ("doc_ids", "langs", "chars")], F.col("p")[0]["lang"].alias("lang"), F.concat_ws(BREAK, F.transform("p", lambda x: x["text"])).alias("text"))
    blocks = whole.unionByName(joined)
    return blocks, totals.select("source", "tokens")


def slots(spark, sources: list[str | None], counts: list[int], weights: list[float], total: int, shard_blocks: int = SHARD_BLOCKS, seed: int = 1) -> DataFrame:
    """(shard, slot, source, pass, block): ``total`` slots. sources, block counts and weights are driver-side lists."""
    p, size = np.array(weights, float) / np.sum(weights), np.array(counts, np.int64)
    shards = -(-total // shard_blocks)

    def draw(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            drawn = [np.random.default_rng([seed, int(i)]).multinomial(min(shard_blocks, total - int(i) * shard_blocks), p) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(p))), pa.array(np.tile(np.arange(len(p)), len(ids)), pa.int32()), pa.array(np.concatenate(drawn), pa.int64())], ["shard", "s", "n"])

    drawn = spark.range(shards).mapInArrow(draw, "shard long, s int, n long").where("n > 0")
    drawn = drawn.withColumn("chunk", F.floor(F.col("shard") / 4096).cast("long"))
    # numbers through all shards: totals of chunks of shards, then within a chunk, so no task orders a whole source
    chunk = drawn.groupBy("s", "chunk").agg(F.sum("n").alias("c"))
    chunk = chunk.withColumn("base", F.sum("c").over(Window.partitionBy("s").orderBy("chunk")) - F.col("c")).drop("c")
    within = drawn.withColumn("at", F.sum("n").over(Window.partitionBy("s", "chunk").orderBy("shard")) - F.col("n"))
    first = F.sum("n").over(Window.partitionBy("shard").orderBy("s")) - F.col("n")
    numbered = within.join(chunk, ["s", "chunk"]).withColumn("slot0", first)
    one = numbered.select("shard", "s", "slot0", (F.col("base") + F.col("at")).alias("q0"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("i"))
    one = one.select("shard", (F.col("slot0") + F.col("i")).alias("slot"), "s", (F.col("q0") + F.col("i")).alias("q"))

    def place(batches):
        for b in batches:
            s, q, shard, slot = (b.column(c).to_numpy() for c in ("s", "q", "shard", "slot"))
            n = size[s]
            turn = q // n
            block = permute(q % n, n, (s.astype(np.int64) * 1_000_003 + turn) * 1_000_003 + seed)
            width = np.minimum(shard_blocks, total - shard * shard_blocks)
            where = permute(slot, width, shard * 7919 + seed)  # sources are spread over the shard
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(where), pa.array([sources[i] for i in s], pa.string()), pa.array(turn), pa.array(block)], ["shard", "slot", "source", "pass", "block"])

    return one.mapInArrow(place, "shard long, slot long, source string, pass long, block long")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, total: int | None = None, temperature: float = TEMPERATURE, seed: int = 1, broadcast_slots: int = BROADCAST_SLOTS) -> DataFrame:
    """(shard, slot, source, pass, block, n_tokens, doc_ids, lang, text), a row for each output slot.

    ``total`` slots, as many as there are blocks unless given. Sources without weight, and weights without documents, play
    no part. No documents give no rows; columns beyond doc_id, text, lang and source play no part."""
    return _mixed(docs, weights, block_tokens, shard_blocks, total, temperature, seed, broadcast_slots).drop("langs", "chars")


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_tokens: int = BLOCK_TOKENS, shard_blocks: int = SHARD_BLOCKS, total: int | None = None, temperature: float = TEMPERATURE, seed: int = 1, broadcast_slots: int = BROADCAST_SLOTS) -> DataFrame:
    """``mix`` with the langs and chars of each block's pieces."""
    blocks, totals = token_blocks(docs, block_tokens, seed=seed)
    found = sorted(totals.collect(), key=lambda r: (r["source"] is not None, r["source"] or ""))  # one row a source
    if weights is not None:
        found = [r for r in found if weights.get(r["source"], 0) > 0]
    spark = docs.sparkSession
    sources, counts = [r["source"] for r in found], [-(-r["tokens"] // block_tokens) for r in found]
    share = [weights[r["source"]] if weights is not None else float(r["tokens"]) ** temperature for r in found]
    if not found:
        return blocks.where(F.lit(False)).selectExpr("0L as shard", "0L as slot", "source", "0L as pass", "block", "n_tokens", "doc_ids", "langs", "chars", "lang", "text")
    total = total if total is not None else sum(counts)
    wanted = slots(spark, sources, counts, share, total, shard_blocks, seed).alias("w")
    wanted = F.broadcast(wanted) if total <= broadcast_slots else wanted.hint("merge")
    b = blocks.alias("b")
    return wanted.join(b, F.col("w.source").eqNullSafe(F.col("b.source")) & (F.col("w.block") == F.col("b.block"))).select("shard", "slot", "w.source", "pass", "w.block", "n_tokens", "doc_ids", "langs", "chars", "b.lang", "b.text")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``mix`` as rows of documents, one for each piece of a document in each slot: its doc_id, lang and source, the piece's
    text and length. A block that several slots hold is there as often. Columns of docs beyond doc_id, text, lang, source and
    n_chars are dropped, for a piece isn't the document that they describe."""
    # a piece begins behind those before it in its block, each with a break
    piece = F.transform("doc_ids", lambda x, i: F.struct(x.alias("doc_id"), F.get("langs", i).alias("lang"), F.get("chars", i).alias("n"), F.aggregate(F.slice("chars", F.lit(1), i), F.lit(1), lambda a, n: a + n + F.lit(len(BREAK))).alias("at")))
    out = _mixed(docs, **how).select("source", "text", F.explode(piece).alias("p"))
    out = out.select(F.col("p.doc_id").alias("doc_id"), F.substring("text", F.col("p.at"), F.col("p.n")).alias("text"), F.col("p.lang").alias("lang"), "source")
    return out.withColumn("n_chars", F.length("text").cast("long"))
