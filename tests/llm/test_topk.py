import numpy as np
import pytest
from pyspark.sql import functions as F

from triplane.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id int, x string, pivot int, shard string"


def brute(rows, k):
    out = []
    for n, (i, v) in enumerate(rows):
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in rows if j != i and len(w) == len(v))
        out += [(i, rank, j, round(d, 6)) for rank, (d, j) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_same_as_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "clusters":
        x = rng.normal(size=(12, 6))[rng.integers(12, size=260)] * 8 + rng.normal(size=(260, 6)) * 0.2
    elif kind == "noise":
        x = rng.normal(size=(150, 24))
    else:
        x = rng.integers(0, 3, size=(120, 2)).astype(float)
    x = x.astype(np.float32)
    rows = [(i, v.astype(float)) for i, v in enumerate(x)]
    rows += [(1000 + i, v[:1]) for i, v in rows[:5]]
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, "a", 2, "b") for i, v in rows], SCHEMA)
    got = top_k(df, None, 4, shard_rows=40, query_rows=60, pivots=9)
    assert sorted((r["vec_id"], r["rank"], r["neighbor_id"], round(r["distance"], 6)) for r in got.collect()) == brute(rows, 4)


def test_stated_queries_against_all_rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros((80, 5)), rng.normal(size=(160, 5))])  # a third of all rows at one place
    rows = [(i, v) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, "a", 2, "b") for i, v in rows], "vec_id long, embedding array<double>, label int, id int, x string, pivot int, shard string")
    for shard_rows, query_rows in ((30, 2), (1000, 1000)):
        got = top_k(df, F.col("vec_id") % 7 == 0, 4, shard_rows=shard_rows, query_rows=query_rows)
        assert sorted((r["vec_id"], r["rank"], r["neighbor_id"], round(r["distance"], 6)) for r in got.collect()) == [r for r in brute(rows, 4) if r[0] % 7 == 0]
    assert top_k(df, F.lit(False)).collect() == [] and top_k(df, F.lit(None).cast("boolean")).collect() == []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [0.0, 0.0]), (7, [1.0, None]), (8, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame([(i, v, None, None, None, None, None) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, top_k(df, None, 3).select("vec_id", "rank", "neighbor_id").collect()))
    assert got == [(1, 1, 2), (1, 1, 2), (2, 1, 1), (2, 2, 1)]
    assert top_k(df.where("false")).collect() == []
    assert top_k(df.where("vec_id = 8")).collect() == []
