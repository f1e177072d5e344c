"""Words, shingles and their hashes, in numpy over batches of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_KNOWN: dict[str, int] = {}
_KNOWN_LIMIT = 1_000_000


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case; none for null."""
    return WORD.findall(text.lower()) if text else []


def word_hash(word: str) -> int:
    h = _KNOWN.get(word)
    if h is None:
        if len(_KNOWN) >= _KNOWN_LIMIT:
            _KNOWN.clear()
        h = _KNOWN[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(word_hash, words(text)), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive words, in order, repeats kept."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:n])
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out = mix(out * np.uint64(0x9DDFEA08EB382D69) ^ hashes[k : n + k])
    return out


def flat_shingles(texts: list, size: int, least_words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one behind the other: hashes, the text each belongs to, words per text."""
    per = [word_hashes(t) for t in texts]
    counts = np.array([len(h) for h in per], dtype=np.int64)
    sets = [np.unique(shingles(h, size)) if len(h) >= max(least_words, size) else np.empty(0, np.uint64) for h in per]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in sets])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), owner, counts
