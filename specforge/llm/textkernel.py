"""Vectorised words, hashes and shingles over the bytes of many documents at once."""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
#: A random odd-or-even 64-bit value for each byte, and odd multipliers.
BYTE_CODE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and STEP ** -i modulo 2 ** 64 for i in 0..n."""
    if len(_powers["up"]) <= n:
        m = (int(n) // (1 << 18) + 1) << 18
        for name, base in (("up", STEP), ("down", STEP_INVERSE)):
            f = np.full(m + 1, base, np.uint64)
            f[0] = 1
            _powers[name] = np.multiply.accumulate(f)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the sum of code(data[k]) * STEP ** k over i <= k < j."""
    up, _ = powers(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, whatever its place."""
    _, down = powers(len(c))
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64) * PLACE[63])


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the document number of each word."""
    solid = ~BLANK[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash and document number of each word; lower: A-Z count as a-z."""
    starts, ends, doc = word_spans(data, offs)
    return span_hash(prefix_hash(LOWER[data] if lower else data), starts, ends), doc


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none no shingle."""
    words, doc = word_hashes(data, offs)
    n_docs = len(offs) - 1
    count = np.bincount(doc, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(count)])
    m = len(words) - k + 1
    h = np.zeros(max(m, 0), np.uint64)
    for i in range(k):
        h += words[i : i + max(m, 0)] * PLACE[i]
    h = mix(h)
    out = []
    for d in range(n_docs):
        n = int(count[d])
        if n >= k:
            out.append(np.unique(h[at[d] : at[d] + n - k + 1]))
        elif n:
            out.append(mix(np.array([(words[at[d] : at[d] + n] * PLACE[:n]).sum() + PLACE[40 + n]], np.uint64)))
        else:
            out.append(h[:0])
    return out
