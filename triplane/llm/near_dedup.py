"""MinHash near-duplicate groups with tensored banding (method: Christiani, "Fast locality-sensitive hashing frameworks").

``sides`` collections on the left and as many on the right, each of ``k`` minhashes, give ``sides**2`` tables: table (i, j)
is keyed by left collection i with right collection j. So 2*sides*k minhashes stand for 2*k*sides**2. A pair of Jaccard
similarity J meets in some table with probability (1-(1-J**k)**sides)**2: 0.91 at the threshold of 0.6, 0.98 at 0.7.

Texts move once, and only those of candidates: tables hold fixed-size keys. Every candidate pair is settled exactly. A pair
is verified by the true Jaccard similarity of both shingle sets; pairs whose ends are already connected need no look.

1. Rows with equal text (MD5) are one node.
2. In each table bucket every node is verified against the bucket's least node; components are formed.
3. In each bucket that still holds several components, every pair across components is verified; components are formed again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplane.llm.tables import arrow_batches, materialize, release, small_enough
from triplane.llm.words import U, hash_words, mix, shingles

WIDTH, THRESHOLD, SIDES, K = 2, 0.6, 7, 2
#: Rows of a table of (16-byte key, id) that are broadcast at most; a shuffle join takes over beyond.
BROADCAST_ROWS = 500_000


def collection_hashes(hashes: np.ndarray, bounds: np.ndarray, sides: int, k: int, seed: int) -> np.ndarray:
    """(documents, 2*sides) combined hashes of k minhashes each; rows without shingles are meaningless."""
    n = len(bounds) - 1
    out = np.zeros((n, 2 * sides), U)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    rng = np.random.default_rng(seed)
    for c in range(2 * sides):
        for _ in range(k):
            odd, add = U(int(rng.integers(1 << 62)) * 2 + 1), U(int(rng.integers(1 << 63)))
            low = np.minimum.reduceat((hashes * odd + add) >> U(16), bounds[full])
            out[full, c] = mix(out[full, c] * U(31) + low)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the least node reachable. Labels spread along edges and are then
    followed one step, so chains shrink geometrically; each round is a written table."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        spread = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        near = label.join(spread, "node").select("node", "component", F.least("component", "c").alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = materialize(near.join(jump, "c").select("node", F.least("c", "cc").alias("component"), (F.least("c", "cc") < F.col("component")).alias("moved")))
        moving = new.where("moved").limit(1).count()
        release(label)
        label = new
        if not moving:
            release(both)
            return label.select("node", "component")


def duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, sides: int = SIDES, k: int = K, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, kept_key, kept_doc_id, repeated) for each distinct (text, doc_id) that goes or repeats.

    A group is a connected component of exact and verified near copies. Its row with the least doc_id (null after all
    others; then least MD5) is kept and named by kept_*. ``repeated``: the row is the kept one and occurs more than once
    in docs; one of its rows stays. Null texts belong to no group. Texts without words (empty ones too) match exact copies
    only. Long texts are hashed in pieces, whole. Ids are whole numbers or strings of them (others raise). Rows that tie in all of this are the same row. No docs give no rows; columns
    beyond id and text play no part.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("key", F.unhex(F.md5("text")))

    def sketch(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            h, b = shingles(hash_words(texts), width)
            sigs = collection_hashes(h, b, sides, k, seed)
            offsets = np.where(np.append(np.diff(b) > 0, False), 1, 0)[:-1] * sides * 2
            values = sigs[np.diff(b) > 0].reshape(-1).view(np.int64)
            sig = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(offsets)]), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), sig], ["key", "id", "sig"])

    sketched = rows.select("key", "id", "text").mapInArrow(sketch, "key binary, id long, sig array<long>")
    nodes = materialize(sketched.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig")))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    texts = nodes.groupBy("key").agg(best.alias("best"), F.first("sig").alias("sig")).select("key", "best.id", "sig")

    tables = F.explode(F.expr(f"flatten(transform(sequence(0, {sides - 1}), i -> transform(sequence(0, {sides - 1}), j -> xxhash64(i, j, sig[i], sig[{sides} + j]))))"))
    keyed = texts.where(F.size("sig") > 0).select(tables.alias("bucket"), "key", "id")
    w = Window.partitionBy("bucket")
    met = materialize(keyed.withColumn("least", F.min(F.struct("key", "id")).over(w)).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1").select("bucket", "key", "id", "least"))
    candidates = materialize(met.select("key", "id").distinct())

    match = (F.col("c.key") == F.col("r.key")) & F.col("c.id").eqNullSafe(F.col("r.id"))
    side = candidates.alias("c")
    chosen = rows.alias("r").join(F.broadcast(side) if small_enough(candidates, BROADCAST_ROWS) else side, match, "left_semi")

    def sets(batches):
        for batch in batches:
            h, b = shingles(hash_words(batch.column("text").to_pylist()), width)
            parts = [np.unique(h[s:e]).view(np.int64) for s, e in zip(b[:-1], b[1:], strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))], ["key", "set"])

    features = materialize(chosen.select("key", "text").mapInArrow(sets, "key binary, set array<long>").dropDuplicates(["key"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left = features.select(F.col("key").alias("a"), F.col("set").alias("x"))
        right = features.select(F.col("key").alias("b"), F.col("set").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        lengths_fit = F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * threshold
        return pairs.join(left, "a").join(right, "b").where(lengths_fit).withColumn("shared", shared).where(F.col("shared") >= threshold * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")

    stars = met.where("key > least.key").select(F.col("key").alias("a"), F.col("least.key").alias("b")).distinct()
    edges = materialize(verified(stars))
    first = connected_components(edges)
    placed = met.select("bucket", "key").join(first.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    split = placed.withColumn("lo", F.min("component").over(w)).withColumn("hi", F.max("component").over(w)).where("lo < hi")
    split = materialize(split.select("bucket", "key", "component"))
    other = split.select("bucket", F.col("key").alias("b"), F.col("component").alias("other"))
    across = split.withColumnRenamed("key", "a").join(other, "bucket").where("component < other").select("a", "b").distinct()
    more = materialize(verified(across))
    final = materialize(connected_components(edges.union(more)))

    member = nodes.select("key", "id", "n").join(final.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    kept = member.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("kept"), F.sum("n").alias("rows")).where("rows > 1")
    out = member.join(kept, "component").withColumn("repeated", (F.col("key") == F.col("kept.key")) & F.col("id").eqNullSafe(F.col("kept.id"))).where("not repeated or n > 1")
    done = materialize(out.select("key", F.col("id").alias("doc_id"), F.col("kept.key").alias("kept_key"), F.col("kept.id").alias("kept_doc_id"), "repeated", "n"))
    release(nodes, met, candidates, features, edges, split, more, final)
    return done


def near_duplicate_pairs(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, kept_doc_id) for each row that near-deduplication drops, with the row that stands for it. A row that
    repeats the kept row in full gives (kept_doc_id, kept_doc_id). Extra columns of docs play no part."""
    found = duplicates(docs, **how)
    times = F.when(F.col("repeated"), F.col("n") - 1).otherwise(F.col("n")).cast("int")
    return found.select("doc_id", "kept_doc_id", F.explode(F.array_repeat(F.lit(0), times)).alias("one")).drop("one")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with all its columns, without the rows of ``near_duplicate_pairs``. Rows of null text all stay."""
    found = duplicates(docs, id_col=id_col, text_col=text_col, **how)
    key, id_ = F.unhex(F.md5(F.col(f"d.{text_col}"))), F.col(f"d.{id_col}").cast("long")

    def matches(side: str):
        return (key == F.col(f"{side}.key")) & id_.eqNullSafe(F.col(f"{side}.doc_id"))

    def placed(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    kinds = {r["repeated"]: r["count"] for r in found.groupBy("repeated").count().collect()}
    gone = found.select("key", "doc_id").alias("g")
    out = docs.alias("d").join(placed(gone, sum(kinds.values())), matches("g"), "left_anti")
    if kinds.get(True):  # rows that occur several times over: one of each comes back
        again = found.where("repeated").select("key", "doc_id").alias("r")
        out = out.unionByName(docs.alias("d").join(placed(again, kinds[True]), matches("r"), "left_semi").dropDuplicates([id_col, text_col]))
    return out
