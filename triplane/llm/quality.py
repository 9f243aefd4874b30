"""Tokeniser fertility as a quality rule.

Public vocabularies, read from ``vocab_dir``, measure each whole text:

* ``chars_per_token``: characters per token of the byte-level BPE vocabulary;
* ``token_entropy``: Shannon entropy, in bits, of its token ids within the text;
* ``byte_share``: share of byte-fallback tokens among the piece vocabulary's tokens of the text with each run of white
  space as one space: line breaks and tabs have no piece of their own and aren't what the share is to show.

A text is rejected when a measure leaves the band of its language or, where the language has none, of its main script.
One rule holds for texts of every length, for what n tokens can show depends on n:

* ``chars_per_token`` may leave its band by ``SPREAD`` characters over the root of n, about a standard error of a mean;
* ``byte_share`` may pass its most by ``Z`` standard errors of a share of n tokens;
* ``token_entropy`` must reach the band's least or, if that is less, the band's share of log2(n), the most n tokens can have.

Each batch's distinct words go through the piece vocabulary once.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.llm.tables import arrow_batches

VOCAB_DIR = "/opt/tokenizers"
BPE_FILE, PIECE_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters by which the mean length of one token may lie outside its band; standard errors that a share may.
SPREAD, Z = 1.0, 3.0
#: White space in runs of this length goes to the merges directly, for the pattern's engine recurses once a character there.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

#: By language, then by script: (chars_per_token least, most; byte_share most; token_entropy least, in bits and as a share
#: of log2(n)). A language's band follows running text of that language; a script's is wider, for several languages share it.
BANDS: dict[str, tuple[float, float, float, float, float]] = {
    "en": (1.75, 8.0, 0.02, 5.0, 0.72),
    "de": (1.65, 8.0, 0.02, 5.0, 0.72),
    "fr": (1.40, 8.0, 0.02, 5.0, 0.72),
    "es": (1.50, 8.0, 0.02, 5.0, 0.72),
    "Latin": (1.40, 10.0, 0.05, 4.0, 0.65),
    "Greek": (0.60, 4.0, 0.10, 3.5, 0.60),
    "Cyrillic": (0.60, 5.0, 0.05, 3.5, 0.60),
    "Hebrew": (0.50, 4.0, 0.20, 3.5, 0.60),
    "Arabic": (0.50, 4.0, 0.20, 3.5, 0.60),
    "Devanagari": (0.25, 4.0, 0.40, 3.5, 0.60),
    "Hangul": (0.25, 3.0, 0.60, 3.5, 0.60),
    "Kana": (0.30, 3.0, 0.50, 3.5, 0.60),
    "Han": (0.30, 3.0, 0.60, 3.5, 0.60),
    "other": (0.20, 12.0, 0.90, 3.0, 0.50),
}
_SCRIPTS = {
    "Latin": "A-Za-zªºÀ-ɏḀ-ỿ",
    "Greek": "Ͱ-Ͽἀ-῿",
    "Cyrillic": "Ѐ-ԯ",
    "Hebrew": "֐-׿",
    "Arabic": "؀-ۿݐ-ݿ",
    "Devanagari": "ऀ-ॿ",
    "Hangul": "ᄀ-ᇿ가-힯",
    "Kana": "぀-ヿ",
    "Han": "㐀-䶿一-鿿",
}
MEASURES = "struct<n_tokens:bigint,chars_per_token:double,byte_share:double,token_entropy:double>"
_loaded: dict[str, tuple] = {}


def _vocabularies(folder: str) -> tuple:
    if folder not in _loaded:
        import sentencepiece
        import tiktoken

        with open(os.path.join(folder, BPE_FILE), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_FILE))
        fallback = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        _loaded[folder] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), pieces, fallback
    return _loaded[folder]


def bpe_tokens(bpe, text: str) -> list[int]:
    """``bpe.encode_ordinary(text)``, whatever its runs of white space: of a run the pattern takes all but the last character
    as one piece, or all at the text's end, and no piece reaches into a run from the left."""
    out, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += bpe.encode_ordinary(text[at : m.start()])
        out += bpe._encode_single_piece(text[m.start() : end])
        at = end
    return out + bpe.encode_ordinary(text[at:])


def measure(texts: list[str | None], folder: str = VOCAB_DIR) -> pd.DataFrame:
    """The measures of each text; null for null texts, zero tokens and null ratios for empty ones."""
    bpe, pieces, fallback = _vocabularies(folder)
    n = len(texts)
    tokens, entropy = np.zeros(n, np.int64), np.full(n, np.nan)
    words: list[str] = []
    counts = np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        ids = np.array(bpe_tokens(bpe, text), np.int64)
        tokens[i] = len(ids)
        per = np.bincount(ids)
        per = per[per > 0]
        entropy[i] = np.log2(len(ids)) - (per * np.log2(per)).sum() / len(ids)
        own = text.split()
        counts[i] = len(own)
        words += own
    codes, distinct = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
    encoded = pieces.encode(list(distinct), num_threads=1) if len(distinct) else []
    size = np.array([len(e) for e in encoded], np.int64)
    flat = np.concatenate([np.array(e, np.int64) for e in encoded]) if encoded else np.zeros(0, np.int64)
    falls = np.bincount(np.repeat(np.arange(len(encoded)), size), weights=fallback[flat], minlength=len(encoded)) if encoded else np.zeros(0)
    owner = np.repeat(np.arange(n), counts)
    all_ = np.bincount(owner, weights=size[codes], minlength=n) if len(codes) else np.zeros(n)
    fell = np.bincount(owner, weights=falls[codes], minlength=n) if len(codes) else np.zeros(n)
    chars = np.array([len(t) if t else 0 for t in texts], float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return pd.DataFrame({"n_tokens": tokens, "chars_per_token": chars / np.where(tokens > 0, tokens, np.nan), "byte_share": fell / np.where(all_ > 0, all_, np.nan), "token_entropy": entropy})


def fertility(text: Column | str, folder: str = VOCAB_DIR) -> Column:
    """A struct column of the measures of ``text``."""

    @F.arrow_udf(MEASURES)
    def measured(batch: pa.Array) -> pa.Array:
        got = measure(batch.to_pylist(), folder)
        arrays = [pa.array(got[c], pa.int64() if c == "n_tokens" else pa.float64(), from_pandas=True) for c in got]
        return pa.StructArray.from_arrays(arrays, list(got))

    return measured(text)


def band_key(lang: Column, text: Column) -> Column:
    """The language where it has a band, else the script with most letters (the first listed at a tie), else "other"."""
    known = [k for k in BANDS if k not in _SCRIPTS and k != "other"]
    letters = F.array(*[F.struct(F.length(F.regexp_replace(text, f"[^{cls}]", "")).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, cls) in enumerate(_SCRIPTS.items())])
    top = F.array_max(letters)
    script = F.when(top["n"] > 0, top["name"]).otherwise("other")
    return F.when(F.lower(lang).isin(known), F.lower(lang)).otherwise(F.coalesce(script, F.lit("other")))


def _bound(key: Column, at: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, b in BANDS.items() for x in (k, b[at])]), key)


def _judged(docs: DataFrame, folder: str, text_col: str, lang_col: str) -> tuple[DataFrame, Column]:
    """docs with one struct column of a name of its own, and the verdict on it: true to keep."""
    arrow_batches(docs.sparkSession, 500)
    name = "fertility"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    text = F.col(text_col)
    out = docs.withColumn(name, F.struct(fertility(text, folder).alias("m"), band_key(F.col(lang_col), text).alias("band")))
    m, key = F.col(name)["m"], F.col(name)["band"]
    n = F.greatest(m["n_tokens"], F.lit(1)).cast("double")
    wide = F.lit(SPREAD) / F.sqrt(n)
    most = _bound(key, 2)
    fits = m["chars_per_token"].between(_bound(key, 0) - wide, _bound(key, 1) + wide)
    fits &= F.coalesce(m["byte_share"] <= most + F.lit(Z) * F.sqrt(most * (1 - most) / n), F.lit(True))
    fits &= m["token_entropy"] >= F.least(_bound(key, 3), _bound(key, 4) * F.log2(n)) - 1e-9
    return out, F.coalesce(text.isNotNull() & (m["n_tokens"] > 0) & fits, F.lit(False))


def score_quality(docs: DataFrame, folder: str = VOCAB_DIR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, band, n_tokens, chars_per_token, byte_share, token_entropy, keep) for each row. Null and empty texts are
    rejected (their measures are null, or 0 tokens); short ones are judged like long ones, by the rule above. Null languages go by
    script. Long texts are measured whole, long runs of one character too; repeated rows and null ids are judged like others; no docs give no rows; other columns play no part."""
    judged, keep = _judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), folder, "text", "lang")
    f = F.col("fertility")
    null = F.col("text").isNull()
    return judged.select("doc_id", f["band"].alias("band"), *[F.when(~null, f["m"][c]).alias(c) for c in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")], keep.alias("keep"))


def filter_quality(docs: DataFrame, folder: str = VOCAB_DIR, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs, all columns, without the rows that ``score_quality`` rejects."""
    judged, keep = _judged(docs, folder, text_col, lang_col)
    return judged.where(keep).select([F.col(f"`{c}`") for c in docs.columns])
