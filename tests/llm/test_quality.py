import base64
import math
from collections import Counter

import pytest
import sentencepiece
import tiktoken

from triplane.llm.quality import BANDS, BPE_FILE, PATTERN, PIECE_FILE, SPREAD, VOCAB_DIR, Z, bpe_tokens, filter_quality, measure, score_quality


@pytest.fixture(scope="module")
def vocabularies():
    with open(f"{VOCAB_DIR}/{BPE_FILE}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sentencepiece.SentencePieceProcessor(model_file=f"{VOCAB_DIR}/{PIECE_FILE}")


TEXTS = [
    (1, "The committee met on Tuesday and agreed that the library should stay open in the evenings during winter. " * 3, "en", "a"),
    (2, "xq7#kz!" * 60, "en", "a"),
    (3, "word " * 400, "en", "a"),
    (4, "Съешь же ещё этих мягких французских булок, да выпей чаю, а потом приходи снова. " * 3, None, "a"),
    (5, "ⵣⵉⵏ ⵜⴰⵎⴰⵣⵉⵖⵜ " * 20, "zgh", "a"),
    (6, "short", "en", "a"),
]


def test_measures_are_those_of_the_vocabularies(spark, make_docs, odd_rows, vocabularies):
    bpe, pieces = vocabularies
    rows = TEXTS + odd_rows
    got = score_quality(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by_text = {r[0]: r[1] for r in TEXTS}
    for r in got:
        if r["doc_id"] in by_text and r["n_tokens"] and (text := by_text[r["doc_id"]]) and r["n_tokens"] == len(ids := bpe.encode_ordinary(text)):
            assert r["chars_per_token"] == pytest.approx(len(text) / len(ids))
            counts = Counter(ids).values()
            assert r["token_entropy"] == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in counts))
            tokens = [t for w in text.split() for t in pieces.encode(w)]
            assert r["byte_share"] == pytest.approx(sum(map(pieces.is_byte, tokens)) / len(tokens))
    measured = {r["n_tokens"] for r in got if r["doc_id"] == 1}
    assert len(bpe.encode_ordinary(TEXTS[0][1])) in measured


def test_verdicts(spark, make_docs, odd_rows):
    got = {r["doc_id"]: r for r in score_quality(make_docs(TEXTS)).collect()}
    assert {i: r["keep"] for i, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True}
    assert (got[4]["band"], got[5]["band"], got[6]["band"]) == ("Cyrillic", "other", "en")
    docs = make_docs(odd_rows)
    kept = filter_quality(docs)
    assert kept.columns == docs.columns
    assert all(r["text"] for r in kept.collect())  # null and empty texts go
    scored = score_quality(docs).collect()
    assert sorted((r["doc_id"] for r in scored if r["keep"]), key=repr) == sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert score_quality(make_docs([])).count() == filter_quality(make_docs([])).count() == 0


def test_bands_are_bands():
    assert all(low < high and 0 <= most <= 1 and 0 < share < 1 for low, high, most, _, share in BANDS.values())


def test_short_junk_goes_and_short_prose_stays(spark, make_docs):
    junk = ["It It It It It It It hast hast hast hast hast hast hast atst atst atst atst atst atst atst is is is is is is is", "ha " * 30, "qq qq qq qq qq qq"]
    prose = ["Thank you all for coming.", "Yes.", "The ferry leaves at nine and comes back before dusk.", "A", "Two of the three roads were closed after the storm, so we took the long way home."]
    got = {r["doc_id"]: r["keep"] for r in score_quality(make_docs([(i, t, "en", "a") for i, t in enumerate(junk + prose)])).collect()}
    assert got == {i: i >= len(junk) for i in range(len(junk) + len(prose))}


def test_verdict_is_the_stated_rule(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in score_quality(docs).collect():
        low, high, most, bits, share = BANDS[r["band"]]
        n = r["n_tokens"]
        ok = low - SPREAD / n**0.5 <= r["chars_per_token"] <= high + SPREAD / n**0.5
        ok = ok and (r["byte_share"] is None or r["byte_share"] <= most + Z * (most * (1 - most) / n) ** 0.5)
        assert r["keep"] == (ok and r["token_entropy"] >= min(bits, share * math.log2(n)) - 1e-9)


def test_runs_of_white_space(vocabularies):
    bpe, _ = vocabularies
    for run in (" ", "\n", "\t", " \n", "\u3000", "\x85"):
        for text in (run * 1500, f"a{run * 1500}b", f"{run * 1500}b c{run * 2000}", f"a {run * 1001}{run * 999}!x"):
            assert bpe_tokens(bpe, text) == bpe.encode_ordinary(text)
    assert bpe_tokens(bpe, "\x1c" * 3000) == bpe.encode_ordinary("\x1c" * 3000)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "word" + " \n" * 600_000 + "word", "x" * 1_000_000, "é!" * 300_000, "漢" * 500_000])
def test_very_long_runs(text):
    got = measure([text, "some words", None, ""])
    assert got["n_tokens"][0] > 0 and got["n_tokens"].tolist()[1:] == measure(["some words", None, ""])["n_tokens"].tolist()


def test_byte_share_is_that_of_the_whole_text(spark, vocabularies):
    _, pieces = vocabularies
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        whole = pieces.encode(" ".join(r["text"].split()))
        assert measure([r["text"]])["byte_share"][0] == pytest.approx(sum(map(pieces.is_byte, whole)) / len(whole))
