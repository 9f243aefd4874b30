"""Exact top-k nearest neighbours (Euclidean) of stated queries among all vectors, by a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it. Ranges of (pivot, distance) make shards of about
``shard_rows`` vectors. A query first searches its own shard, which bounds its k-th distance by tau. Another shard, and in
it another pivot's vectors, can only matter if the triangle inequality leaves room: a vector at distance r from pivot p is
at least |d(q, p) - r| from q, and, as p is its nearest pivot, at least (d(q, p) - d(q, nearest pivot)) / 2. So a query goes
only to shards that may hold something nearer than tau; there it takes pivots from the least bound up, cuts the annulus
[d(q, p) - tau, d(q, p) + tau] out of the sorted distances, lowers tau with what it finds, and stops when the next bound is
above tau. Nothing is approximate; where distances concentrate, as in many dimensions, bounds prune little and the search is
a blocked comparison of the queries with all vectors.

Queries travel to shards, shards stay whole: one that more than ``query_rows`` queries reach is held once for each
``query_rows`` of them, others once, so what is copied follows the queries that bounds let through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.llm.tables import materialize, release

K, SHARD_ROWS, QUERY_ROWS = 10, 16_384, 16_384
#: Distances, one for each query and annulus, that are held at a time while queries are routed.
ROUTE_CELLS = 1 << 22
#: Relative guard for rounding in bounds; distances that decide are computed directly.
SLACK = 1e-9


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


class Best:
    """The k best (distance, id) of each query so far."""

    def __init__(self, ids: np.ndarray, tau: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.limit = tau.copy()
        self.row, self.dist, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, rows: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Compares queries ``rows``, of vectors q, with x."""
        square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
        square[self.ids[rows][:, None] == ids[None]] = np.inf
        guard = SLACK * (1 + (q * q).sum(1) + (x * x).sum(1).max(initial=0))
        most = self.limit[rows] ** 2
        if x.shape[0] > self.k:
            most = np.minimum(most, np.partition(square, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero(np.isfinite(square) & (square <= (most + 2 * guard)[:, None]))
        if not len(r):
            return
        d = np.sqrt(((q[r] - x[c]) ** 2).sum(1))
        touched = np.isin(self.row, rows)
        row = np.concatenate([self.row[touched], rows[r]])
        dist, id_ = np.concatenate([self.dist[touched], d]), np.concatenate([self.id[touched], ids[c]])
        order = np.lexsort((id_, dist, row))
        row, dist, id_ = row[order], dist[order], id_[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        last = place == self.k - 1
        self.limit[row[last]] = np.minimum(self.limit[row[last]], dist[last])
        self.row, self.dist, self.id = np.concatenate([self.row[~touched], row[keep]]), np.concatenate([self.dist[~touched], dist[keep]]), np.concatenate([self.id[~touched], id_[keep]])


def _search(pivots: np.ndarray, queries: np.ndarray, ids: np.ndarray, nearest: np.ndarray, tau: np.ndarray, pivot: np.ndarray, r: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, step: int = 512) -> Best:
    """Queries against one shard, its rows sorted by (pivot, r)."""
    best = Best(ids, tau, k)
    to = _distances(queries, pivots)
    own = to[np.arange(len(queries)), nearest]
    runs = [(p, *np.searchsorted(pivot, [p, p + 1])) for p in np.unique(pivot)]
    bound = np.stack([np.maximum.reduce([to[:, p] - r[b - 1], r[a] - to[:, p], (to[:, p] - own) / 2]) for p, a, b in runs], 1) if runs else np.zeros((len(queries), 0))
    for at in range(0, len(queries), step):  # a block of queries takes the pivots in the order of its least bounds
        rows = np.arange(at, min(at + step, len(queries)))
        order = np.argsort(bound[rows].min(0), kind="stable")
        for j in order:
            p, a, b = runs[j]
            may = rows[bound[rows, j] <= best.limit[rows] * (1 + SLACK) + SLACK]
            if not len(may):
                if bound[rows, j].min() > best.limit[rows].max() * (1 + SLACK) + SLACK:
                    break  # the bounds that follow are no less
                continue
            margin = best.limit[may] * (1 + SLACK) + SLACK
            lo = a + np.searchsorted(r[a:b], (to[may, p] - margin).min(), side="left")
            hi = a + np.searchsorted(r[a:b], (to[may, p] + margin).max(), side="right")
            if lo < hi:
                best.add(may, queries[may], x[lo:hi], x_ids[lo:hi])
    return best


def _frame(best: Best, q: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((best.id, best.dist, best.row))
    return pd.DataFrame({"q": q[best.row[order]], "distance": best.dist[order], "neighbor_id": best.id[order]})


FOUND = "q long, distance double, neighbor_id long"


def top_k(vectors: DataFrame, asked: Column | None = None, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the k nearest of each query among all rows, ties by neighbor_id, rank from 1.

    ``asked``: a condition on vectors that queries meet; every row is one where it is not given. Ids are whole numbers (or
    strings of them; others raise). Rows of a null id, of a null or empty vector or with a null or non-finite element are neither
    queries nor neighbours. Vectors of different lengths aren't comparable: each length is searched by itself. A row is no
    neighbour of rows with its own id. Rows that repeat are queries and neighbours as often as they occur. Fewer than k
    candidates give fewer ranks. No vectors, or none asked for, give no rows; other columns play no part.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    query = F.coalesce(asked, F.lit(False)) if asked is not None else F.lit(True)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), query.alias("query"))
    rows = rows.where("id is not null and size(x) > 0").where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    lengths = sorted(rows.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("query").alias("queries")).collect())  # one row a vector length
    results = [_top_k(spark, rows.where(F.size("x") == n), count, k, shard_rows, query_rows, pivots) for n, count, queries in lengths if queries]
    if not results:
        return spark.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out


def _top_k(spark, rows: DataFrame, count: int, k: int, shard_rows: int, query_rows: int, n_pivots: int | None) -> DataFrame:
    # pivots: a bounded sample, 2048 at most, that all executors hold
    n_pivots = n_pivots or int(np.clip(np.sqrt(count) / 4, 1, 2048))
    chosen = rows.orderBy(F.xxhash64("id", "x"), "id").limit(n_pivots).select("x").collect()
    pivots = np.unique(np.array([r["x"] for r in chosen]), axis=0)

    def keyed(batches):
        for df in batches:
            v = np.stack(df["x"].to_numpy())
            d = _distances(v, pivots)
            yield pd.DataFrame({"id": df["id"], "x": df["x"], "query": df["query"], "pivot": d.argmin(1), "r": d.min(1)})

    sized = materialize(rows.mapInPandas(keyed, "id long, x array<double>, query boolean, pivot int, r double"))
    # shards are ranges of (pivot, r): a pivot with many rows is cut into annuli, equal distances by id, small pivots share one
    ranged = sized.repartitionByRange(max(1, -(-count // shard_rows)), "pivot", "r", "id").sortWithinPartitions("pivot", "r", "id")
    index = materialize(ranged.select(F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("q"), "id", "x", "query", "pivot", "r"))
    release(sized)
    queries = index.where("query")

    def visit(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "distance": np.zeros(0), "neighbor_id": np.zeros(0, np.int64)})
        shard, queries = shard.sort_values(["pivot", "r"]), queries.sort_values(["pivot", "q"])
        tau = queries["tau"].fillna(np.inf).to_numpy(dtype=float)
        best = _search(pivots, np.stack(queries["x"].to_numpy()), queries["id"].to_numpy(), queries["pivot"].to_numpy(), tau, shard["pivot"].to_numpy(), shard["r"].to_numpy(), np.stack(shard["x"].to_numpy()), shard["id"].to_numpy(), k)
        return _frame(best, queries["q"].to_numpy())

    def searched(asked: DataFrame) -> DataFrame:
        """asked (shard, q, id, x, pivot, tau), a written table: what each finds in its shard."""
        reached = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("chunks"))
        sent = asked.join(reached, "shard").selectExpr("shard", "cast(pmod(xxhash64(q), chunks) as int) as chunk", "q", "id", "x", "pivot", "tau")
        copies = reached.selectExpr("shard as at", "explode(sequence(0, chunks - 1)) as chunk")
        held = index.join(copies, F.col("shard") == F.col("at")).select("shard", "chunk", "id", "x", "pivot", "r")
        return sent.groupBy("shard", "chunk").cogroup(held.groupBy("shard", "chunk")).applyInPandas(visit, FOUND)

    at_home = materialize(queries.select("shard", "q", "id", "x", "pivot", F.lit(None).cast("double").alias("tau")))
    local = materialize(searched(at_home))
    tau = local.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("tau"))
    rings = index.groupBy("shard", "pivot").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).orderBy("shard", "pivot").toPandas()  # one row an annulus
    ring_shard, ring_pivot, ring_lo, ring_hi = (rings[c].to_numpy() for c in ("shard", "pivot", "lo", "hi"))
    shards, starts = np.unique(ring_shard, return_index=True)
    step = max(1, ROUTE_CELLS // (len(rings) + len(pivots)))

    def routed(batches):
        for whole in batches:
            for begin in range(0, len(whole), step):
                df = whole.iloc[begin : begin + step]
                v, near = np.stack(df["x"].to_numpy()), df["pivot"].to_numpy()
                tau = df["tau"].fillna(np.inf).to_numpy(dtype=float)
                to = _distances(v, pivots)
                mine = to[np.arange(len(v)), near]
                d = to[:, ring_pivot]
                bound = np.maximum.reduce([d - ring_hi, ring_lo - d, (d - mine[:, None]) / 2])
                least = np.minimum.reduceat(bound, starts, axis=1)
                r, s = np.nonzero((least <= (tau * (1 + SLACK) + SLACK)[:, None]) & (shards[None] != df["shard"].to_numpy()[:, None]))
                take = df.iloc[r]
                yield pd.DataFrame({"shard": shards[s], "q": take["q"].to_numpy(), "id": take["id"].to_numpy(), "x": take["x"].to_numpy(), "pivot": take["pivot"].to_numpy(), "tau": tau[r]})

    routes = queries.join(tau, "q", "left").select("shard", "q", "id", "x", "pivot", "tau").mapInPandas(routed, "shard int, q long, id long, x array<double>, pivot int, tau double")
    abroad = materialize(routes)
    both = local.union(searched(abroad))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)
    return ranked.join(queries.select("q", F.col("id").alias("vec_id")), "q").select("vec_id", "rank", "neighbor_id", "distance")
