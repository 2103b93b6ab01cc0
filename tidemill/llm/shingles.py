"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_FACTORS = _rng.integers(1, 2**62, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit integer spread evenly; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row (A-Z lower-cased), and the number of words of each text."""
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    blank = _BLANK[data]
    before = np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(~blank & before)
    stops = np.flatnonzero(blank & ~before)
    up, down = _power(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up, out=total[1:])
    ends = np.cumsum(sizes)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    return mix((total[stops] - total[starts]) * down[starts]), counts


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted. A text of fewer words is one shingle; one without words has none."""
    words, counts = word_hashes(texts)
    n = len(words)
    joined = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        joined += words[k : k + len(joined)] * _FACTORS[k]
    joined = mix(joined)
    out, a = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(joined[a : a + c - width + 1]))
        elif c:
            out.append(mix(np.array([(words[a : a + c] * _FACTORS[32 : 32 + c]).sum() + U(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        a += c
    return out
