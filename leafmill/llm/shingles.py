"""Word shingles of whole Arrow text columns, hashed with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D (none of which occurs inside a
multi-byte UTF-8 character).  Letters A-Z are lower-cased.  A shingle is ``width`` consecutive words;
a text with fewer words gives its whole sequence as one shingle, a text without words gives none.
Hashes have 64 bits, so distinct shingles of one corpus practically never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE = int(_RNG.integers(2**61, 2**62)) * 4 + 3
_INVERSE = pow(_BASE, -1, 2**64)
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False
#: Letters, digits and every byte of a character beyond ASCII: punctuation ends a word.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[str, np.ndarray] = {}

CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have


def parts(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``size`` bytes; a longer text is a run of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of True that doesn't cross an offset."""
    n = len(inside)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    return np.flatnonzero(inside & (~before | cut[:-1])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def prefix_hashes(data: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of weighted bytes, and factors that take their place in the text out of a difference of two."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * _power("up", _BASE, n)[:n], out=total[1:])
    return total, _power("down", _INVERSE, n + 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    total, down = prefix_hashes(data, fold)
    return mix(((total[ends] - total[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, word: np.ndarray = IN_WORD, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and for each text the place of its first word (one more for the end)."""
    starts, ends = runs(word[data], offsets)
    return span_hashes(data, starts, ends, fold), np.searchsorted(starts, offsets)


def roll(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` neighbouring words."""
    rolled = words
    for k in range(1, width):
        rolled = mix(rolled[: max(0, len(words) - k)] * np.uint64(_STEP[k % 2]) + words[k:])
    return rolled


def shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending (uint64)."""
    for _, data, offsets in parts(texts):
        words, first = word_hashes(data, offsets)
        rolled = roll(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = mix(np.array([whole], dtype=np.uint64) * np.uint64(_STEP[1]) + w)[0]
                yield np.array([whole], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def least_overlap(n: int, percent: int) -> int:
    """The fewest shared shingles that a set of n needs with any set to reach the similarity."""
    return -(-percent * n // 100)


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set that don't depend on order, as two signed longs."""
    if not len(found):
        return 0, 0
    a = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(found * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))
