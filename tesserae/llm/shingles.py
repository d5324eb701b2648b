"""Word shingles of texts as 64-bit hashes, for the Python side of operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5


#: Words of more bytes are hashed on their own.
LONG = 512
#: Bytes of short texts that are hashed together, and of one text at a time.
CHUNK, WINDOW = 1 << 18, 1 << 22
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]


def _grow(n: int) -> None:
    """Tables of the base's powers and inverse powers modulo 2**64, for n bytes."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        _powers, _inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        _powers[0] = _inverse[0] = 1
        _powers, _inverse = _powers.cumprod(dtype=np.uint64), _inverse.cumprod(dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _words(b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in the bytes `b`, by differences of one prefix sum; none crosses an edge."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_GAP[b]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = edges[(edges > 0) & (edges < len(b))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    _grow(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers[: len(b)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64)
    for i in np.flatnonzero(ends - starts > LONG):
        h[i] = xxhash.xxh3_64_intdigest(b[starts[i] : ends[i]].tobytes().lower())
    return mix(h), starts


def _windows(b: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one long text that end before a gap."""
    lo = 0
    while lo < len(b):
        hi = lo + WINDOW
        while hi < len(b) and not _GAP[b[hi]]:
            gaps = np.flatnonzero(_GAP[b[hi : hi + WINDOW]])
            hi += gaps[0] if len(gaps) else WINDOW
        yield b[lo:hi]
        lo = hi


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.concatenate([[True], new])]


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the distinct shingles, ascending: five words each; with fewer words the whole sequence.

    A-Z are lower-cased; words are runs of other bytes than space and the controls 9 to 13. Nulls have none.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        b = data[at[i] : at[j]]
        if j == i + 1 and len(b) > WINDOW:
            h = np.concatenate([_words(w, np.zeros(0, np.int64))[0] for w in _windows(b)])
            cut = np.array([0, len(h)])
        else:
            h, starts = _words(b, at[i:j] - at[i])
            cut = np.searchsorted(starts, at[i : j + 1] - at[i])
        m = max(0, len(h) - WORDS + 1)
        out = h[:m] * _PLACE[0]
        for k in range(1, WORDS):
            out += h[k : m + k] * _PLACE[k]
        out = mix(out + np.uint64(WORDS))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            n = hi - lo
            if n >= WORDS:
                yield _unique(out[lo : hi - WORDS + 1])
            elif n:
                one = (h[lo:hi] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True)
                yield mix(one + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
        i = j


def shingles(text: str | None) -> np.ndarray:
    """The set of one text."""
    return next(sets(pa.array([text], pa.large_string())))


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def subsets(s: list[int], size: int) -> list[int]:
    """A hash for each subset of the given size."""
    s = sorted(s)
    return [xxhash.xxh3_64_intdigest(np.array([*c, size], np.int64).tobytes()) for c in combinations(s, size)]
