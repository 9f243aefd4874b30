import math
import re
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from triplane.llm.mixing import BLOCK_TOKENS, BREAK, SHARD_BLOCKS, TEMPERATURE, mix, permute
from triplane.llm.packing import CAPACITY, TOKEN
from triplane.llm.quality import BANDS, SPREAD, VOCAB_DIR, Z, _vocabularies, band_key
from triplane.llm.queries import ORACLE_SQL, QUERIES
from triplane.llm.toxicity import REJECT_AT, train

from ..test_queries import canonical
from .test_near_dedup import groups
from .test_packing import naive
from .test_toxicity import naive_features

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    """(stage, what it was given, what it gave) for each stage in turn."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.materialize(stage(spark, docs, SF))
        out[name] = docs, got
        docs = got
    return out


def test_stages_are_those_asked_for(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    assert all(stages[n][1].columns == COLUMNS for n in list(stages)[:-1])
    assert all(stages[n][1].count() < stages[n][0].count() for n in ("toxicity", "near_dedup"))
    assert canonical(corpus_pipeline.run(spark, SF).collect(), stages["packing"][1].columns) == canonical(stages["packing"][1].collect(), stages["packing"][1].columns)


def test_toxicity_is_a_plain_sum(spark, stages):
    docs, got = stages["toxicity"]
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(model.features.tolist(), model.weights, strict=True))
    keep = [r for r in docs.collect() if 1 / (1 + math.exp(model.thresholds[0] - sum(weight.get(f, 0) for f in naive_features(r["text"])))) < REJECT_AT]
    assert rows_of(got) == sorted(map(tuple, keep), key=repr)


def test_quality_is_the_stated_rule(stages):
    docs, got = stages["quality"]
    bpe, pieces, _ = _vocabularies(VOCAB_DIR)
    keep = []
    for r in docs.withColumn("band", band_key(F.col("lang"), F.col("text"))).collect():
        ids, parts = bpe.encode_ordinary(r["text"]), pieces.encode(" ".join(r["text"].split()))
        n = len(ids)
        low, high, most, bits, share = BANDS[r["band"]]
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        fell = sum(map(pieces.is_byte, parts)) / len(parts)
        if low - SPREAD / n**0.5 <= len(r["text"]) / n <= high + SPREAD / n**0.5 and fell <= most + Z * (most * (1 - most) / n) ** 0.5 and entropy >= min(bits, share * math.log2(n)) - 1e-9:
            keep.append(tuple(r)[:-1])
    assert rows_of(got) == sorted(keep, key=repr)


def test_near_dedup_keeps_the_least_of_each_group(stages):
    docs, got = stages["near_dedup"]
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    assert rows_of(got) == sorted((min((rows[i] for i in g), key=lambda r: r[0]) for g in groups(rows)), key=repr)


def plain_blocks(docs, block_tokens, seed=1):
    """{(source, block): [(doc_id, piece)]} by one list of tokens a source."""
    rank = F.xxhash64(F.lit(seed), F.col("doc_id"), F.md5("text"))
    streams = {}
    for r in docs.withColumn("rank", rank).orderBy("rank", "doc_id", "text").collect():
        starts = [m.start() for m in re.finditer(TOKEN, r["text"])]
        streams.setdefault(r["source"], []).extend((r["doc_id"], r["text"], s, starts[k + 1] if k + 1 < len(starts) else len(r["text"])) for k, s in enumerate(starts))
    out = {}
    for source, tokens in streams.items():
        for k in range(0, len(tokens), block_tokens):
            pieces = []
            for i, text, s, e in tokens[k : k + block_tokens]:
                if pieces and pieces[-1][0] == i and pieces[-1][1] is text:
                    pieces[-1][3] = e
                else:
                    pieces.append([i, text, 0 if not text[:s].strip() else s, e])
            out[source, k // block_tokens] = [(i, text[s:e]) for i, text, s, e in pieces]
    return out, {s: len(t) for s, t in streams.items()}


def plain_mix(blocks, totals, block_tokens, shard_blocks, seed=1):
    """Rows (shard, slot, source, pass, block), one slot at a time."""
    sources = sorted(totals)
    size = [-(-totals[s] // block_tokens) for s in sources]
    weights = np.array([float(totals[s]) ** TEMPERATURE for s in sources])
    total, drawn, out = sum(size), [0] * len(sources), []
    for shard in range(-(-total // shard_blocks)):
        width, place = min(shard_blocks, total - shard * shard_blocks), 0
        for s, n in enumerate(np.random.default_rng([seed, shard]).multinomial(width, weights / weights.sum())):
            for _ in range(n):
                turn, q = divmod(drawn[s], size[s])
                block = int(permute(np.array([q]), np.array([size[s]]), np.array([(s * 1_000_003 + turn) * 1_000_003 + seed]))[0])
                slot = int(permute(np.array([place]), np.array([width]), np.array([shard * 7919 + seed]))[0])
                out.append((shard, slot, sources[s], turn, block))
                drawn[s], place = drawn[s] + 1, place + 1
    return out


@pytest.mark.parametrize(("block_tokens", "shard_blocks"), [(BLOCK_TOKENS, SHARD_BLOCKS), (100, 16)])
def test_every_slot_holds_the_block_that_plain_mixing_puts_there(spark, stages, block_tokens, shard_blocks):
    docs = stages["mixing"][0]
    blocks, totals = plain_blocks(docs, block_tokens)
    slots = plain_mix(blocks, totals, block_tokens, shard_blocks)
    wanted = sorted((*x, [i for i, _ in blocks[x[2], x[4]]], BREAK.join(t for _, t in blocks[x[2], x[4]])) for x in slots)
    got = mix(docs, block_tokens=block_tokens, shard_blocks=shard_blocks)
    assert sorted(map(tuple, got.select("shard", "slot", "source", "pass", "block", "doc_ids", "text").collect())) == wanted
    if block_tokens == BLOCK_TOKENS:
        pieces = Counter((i, t, s) for _, _, s, _, b in slots for i, t in blocks[s, b])
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in stages["mixing"][1].collect()) == pieces


def test_packing_is_first_fit_and_its_texts_are_whole(stages):
    docs, got = stages["packing"]
    rows = [(r["doc_id"], len(re.findall(TOKEN, r["text"])), r["text"]) for r in docs.collect()]
    bins = got.collect()
    assert all(b["n_tokens"] == sum(b["lengths"]) <= CAPACITY for b in bins)
    packed = [(i, s, n, t) for b in bins for i, s, n, t in zip(b["doc_ids"], b["starts"], b["lengths"], b["texts"], strict=True)]
    assert all(len(re.findall(TOKEN, t)) == n for _, _, n, t in packed)
    # a piece of mixing is shorter than a bin: each is one item, and its text comes back whole
    assert Counter((i, 0, n, t) for i, n, t in rows) == Counter(packed)
    for group in {b["pack_group"] for b in bins}:
        own = sorted((b for b in bins if b["pack_group"] == group), key=lambda b: b["pack"])
        lengths = sorted((n for b in own for n in b["lengths"]), reverse=True)
        at = naive(lengths, CAPACITY)
        assert [b["n_tokens"] for b in own] == [sum(n for n, k in zip(lengths, at, strict=True) if k == b) for b in range(len(own))]


@pytest.mark.parametrize("empty", [True, False])
def test_odd_documents(spark, make_docs, odd_rows, empty, tmp_path):
    docs = make_docs([] if empty else odd_rows)  # with columns of clashing names
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        counts[name] = docs.count()
        if name in ("toxicity", "quality", "near_dedup"):
            assert docs.columns[:5] == COLUMNS
        if name == "near_dedup" and not empty:
            kept = {r["doc_id"] for r in docs.collect()}
    if empty:
        assert set(counts.values()) == {0}
        return
    assert counts["toxicity"] == len(odd_rows) and counts["near_dedup"] == len(kept)
    assert kept == {6, 7, 8}  # null, empty and blank texts fail the quality rules, as do numbered words in the bands of English
    long = [t for b in docs.collect() for i, t in zip(b["doc_ids"], b["texts"], strict=True) if i == 7]
    assert sum(len(t.split()) for t in long) >= BLOCK_TOKENS


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, asked = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in asked.description]
    assert canonical(df.collect(), df.columns) == canonical(asked.fetchall(), columns)


def test_registered():
    found = __spark_entry__.queries()
    assert {k.split("_")[0] for k in found if k.startswith("op") and k[2].isdigit()} == {f"op{n}" for n in range(1, 11)} and "pipeline" in found


def test_entry_without_this_package():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
