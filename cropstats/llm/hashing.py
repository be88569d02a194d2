"""Rolling 64-bit hashes of words and n-grams, computed on whole byte arrays with numpy.

The hash of a span is a polynomial in an odd base modulo 2^64 over random
per-symbol values, so the hash of any span is a difference of prefix sums times
a power of the base's inverse: no loop over words is needed. Spans are mixed
with a finaliser before use.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 20
#: Added to a span's hash for each symbol of its length.
SPAN_VALUE = U64(0xA0761D6478BD642F)
#: Bytes of white space: blank, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (three multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64, or of the inverse; grown on demand."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, _INVERSE if inverse else _BASE, dtype=U64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(out)
        _powers[key] = have if size <= 4 * _STEP else None
        if _powers[key] is None:
            del _powers[key]
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[j] * base^j``; one element longer than ``values``."""
    out = np.empty(len(values) + 1, dtype=U64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [start, end), by the prefix sums of :func:`prefix`."""
    with np.errstate(over="ignore"):
        raw = (sums[end] - sums[start]) * powers(len(sums), inverse=True)[start]
        return mix(raw + (end - start).astype(U64) * SPAN_VALUE)


def word_spans(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of non-white-space bytes."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[a]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def hashed_words(data: bytes, table: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start byte of every word of ``data``; works through long texts in blocks cut at white space."""
    parts, at = [(np.empty(0, dtype=U64), np.empty(0, dtype=np.int64))], 0
    while at < len(data):
        stop = min(at + _STEP, len(data))
        while stop < len(data) and not SPACE[data[stop]]:
            stop += 1
        block = data[at:stop]
        start, end = word_spans(block)
        parts.append((spans(prefix(table[np.frombuffer(block, dtype=np.uint8)]), start, end), start + at))
        at = stop
    if len(parts) == 2:
        return parts[1]
    hashes, starts = zip(*parts, strict=True)
    return np.concatenate(hashes), np.concatenate(starts)


def word_hashes(data: bytes, table: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of every word of ``data``."""
    return hashed_words(data, table)[0]


def shingles_of_all(texts: list[bytes], n: int, short_whole: bool) -> list[np.ndarray]:
    """:func:`shingle_hashes` of every text with A-Z lower-cased, computed for all texts at once."""
    if not texts:
        return []
    words, at = hashed_words(b"\n".join(texts).lower())
    sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    edges = np.concatenate(([0], np.searchsorted(at, np.cumsum(sizes)))).tolist()
    every = shingle_hashes(words, n, short_whole=False)  # some reach over the end of a text; these are left out
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        whole = high - low >= n or not short_whole
        out.append(every[low:max(high - n + 1, low)] if whole else shingle_hashes(words[low:high], n, short_whole))
    return out


def shingle_hashes(words: np.ndarray, n: int, short_whole: bool) -> np.ndarray:
    """Hashes of the n-word shingles in order.

    With fewer than ``n`` words the whole sequence is one shingle if
    ``short_whole``, else there is none; without words there is none.
    """
    m = len(words)
    if m == 0 or (m < n and not short_whole):
        return np.empty(0, dtype=U64)
    width = min(n, m)
    acc = np.zeros(m - width + 1, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(width):
            acc = acc * U64(0xFF51AFD7ED558CCD) + mix(words[j:j + len(acc)] + U64(j + 1))
        return mix(acc + U64(width))
