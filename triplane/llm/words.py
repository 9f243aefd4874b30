"""Vectorised word hashing, shared by the operators that work on words.

A word is a maximal run of letters, digits and symbols of the lower-cased text: white space, ASCII characters that are neither
letters nor digits, and punctuation of any script end it. Scripts that don't space their words (Han, Kana, Thai and their
like) have a word for each character. A word's hash is a polynomial over its UTF-8 bytes modulo 2**64, mixed; it depends on the bytes alone, so all workers agree on it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_STEP = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BREAKS = "".join(c for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x1F000)]) if unicodedata.category(c)[0] in "PZ" or 127 < ord(c) < 160)
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_APART = re.compile(f"[{re.escape(_BREAKS)}]+|([{_ALONE}])")
_powers = {b: np.ones(1, U) for b in (_BASE, _INVERSE)}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def _encoded(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The lower-cased texts, each with a line break behind it, and their bounds. Characters beyond ASCII that end a word have
    spaces around them or in their place; texts that may hold any are found by their bytes."""
    parts = [t.lower().encode() if t else b"" for t in texts]
    data = b"\n".join(parts) + b"\n"
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in parts], out=starts[1:])
    whole = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((whole >= 0xCD) | (whole == 0xC2))  # none of these bytes begins a Latin letter
    if not len(lead):
        return data, starts
    for i in np.unique(np.searchsorted(starts, lead, side="right") - 1):
        parts[i] = _APART.sub(r" \1 ", parts[i].decode()).encode()
    np.cumsum([len(e) + 1 for e in parts], out=starts[1:])
    return b"\n".join(parts) + b"\n", starts


@dataclass
class Words:
    """hashes of all words in order; document d's are hashes[bounds[d]:bounds[d+1]]. prefixes: hashes of longer words' first bytes, else 0."""

    hashes: np.ndarray
    bounds: np.ndarray
    prefixes: np.ndarray | None = None

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def hash_words(texts: list[str | None], prefix: int = 0) -> Words:
    """Words of each text; a null text has none. Long inputs are worked through in pieces that end between words."""
    data, starts = _encoded(texts)
    whole = np.frombuffer(data, np.uint8)
    hashes, firsts, prefixes = [], [], []
    at = 0
    while at < len(whole):
        end = min(at + _STEP, len(whole))
        while end < len(whole):
            gap = np.flatnonzero(~_WORD[whole[end : end + _STEP]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(end + _STEP, len(whole))
        buf = whole[at:end]
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = _WORD[buf]
        change = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = change[::2], change[1::2]
        total = np.zeros(len(buf) + 1, U)
        np.cumsum((buf.astype(U) + U(1)) * _power(_BASE, len(buf)), out=total[1:])
        inverse = _power(_INVERSE, len(buf) + 1)[s]
        hashes.append(mix((total[e] - total[s]) * inverse))
        firsts.append(s + at)
        if prefix:
            part = mix((total[np.minimum(e, s + prefix)] - total[s]) * inverse ^ U(0x5851F42D4C957F2D))
            prefixes.append(np.where(e - s > prefix, part, U(0)))
        at = end
    firsts = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, U), np.searchsorted(firsts, starts), np.concatenate(prefixes) if prefix and prefixes else None)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``width`` words in a row, and bounds as in Words. A shorter text with words has one shingle: all its words."""
    h, n = words.hashes, np.diff(words.bounds)
    out = h.copy()
    owner_end = np.repeat(words.bounds[1:], n)
    at = np.arange(len(h))
    for k in range(1, width):
        nxt = np.zeros_like(h)
        nxt[:-k] = h[k:]
        nxt[at + k >= owner_end] = 0
        out = mix(out * U(0x9E3779B97F4A7C15) + nxt + U(k))
    keep = (at + width <= owner_end) | ((np.repeat(n, n) < width) & (at == np.repeat(words.bounds[:-1], n)))
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    return out[keep], bounds
