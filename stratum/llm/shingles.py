"""Words, shingle sets and MinHash signatures of texts.

Words are the runs of bytes other than space and \\x09-\\x0D, after lower-casing A-Z. A shingle is a run of `size`
words; a text of fewer words has its whole sequence as its one shingle, a text without words none. Sets are
kept as sorted 64-bit hashes of the shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, where each text's words begin and end). Arrow splits the texts and numbers
    their words, so that only distinct words are hashed and nothing is remembered."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))  # before the cast: of a slice that was cast Arrow lowers other bytes
    split = pc.ascii_split_whitespace(lowered.cast(pa.large_string()))
    coded = split.flatten().dictionary_encode()
    distinct, at = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    word = np.fromiter(map(bool, distinct), bool, len(distinct))[at]
    ends = np.concatenate([[0], np.cumsum(word)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    return own[at[word]], ends


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    h, ends = word_hashes(texts)
    runs = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for j in range(size):
        runs = _mixed(runs * _STEP + h[j : j + len(runs)])
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            whole = np.full(min(1, b - a), b - a, np.uint64)
            for j in range(a, b):
                whole = _mixed(whole * _STEP + h[j])
            out.append(whole)
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.large_string()), size)[0]


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Signer:
    """MinHash signatures: of each of `coordinates` mixing functions the least value over the set, as 31 bits."""

    def __init__(self, coordinates: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, coordinates, dtype=np.uint64)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.odd), np.uint64(2**64 - 1), np.uint64)
        for a in range(0, len(shingles), 4096):
            x = shingles[a : a + 4096, None] * self.odd + self.add
            np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
        return _mixed(least) >> np.uint64(33)
