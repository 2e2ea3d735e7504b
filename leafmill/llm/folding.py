"""Words of whole texts in a folded spelling, and hashed pieces of them, with numpy.

Folding takes back common disguises: case and accents of Latin letters, digits and signs that stand for letters, invisible
characters, signs between two letters (``i.d-i*t``), single letters one space apart (at least three), and repeated
letters (each run counts as one).  A word is a maximal run of folded letters, digits and bytes of other scripts.  A piece
is a run of PIECES bytes of a word with one space on either side, or its beginning of BEGINNINGS bytes and that space.

Texts are worked on in stretches of about CHUNK_BYTES; a longer one is cut at white space, or inside a word where there
is none for STRETCH bytes.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from leafmill.llm.shingles import mix, parts, prefix_hashes, runs, span_hashes

SPACE = 32
BITS = 20
PIECES, BEGINNINGS = (3, 4, 5), (5, 6, 7)
STRETCH = 100_000
#: Pieces take some 70 bytes of memory for each byte of text.
CHUNK_BYTES = 500_000

#: Signs and digits that stand for letters, and signs that are set between letters.
LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
BETWEEN = ".-_*'~"

_PLAIN = np.full(256, SPACE, dtype=np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[65:91] = _PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[[ord(x) for x in LOOK_ALIKE]] = [ord(x) for x in LOOK_ALIKE.values()]
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[ord(x) for x in BETWEEN]] = True


def _base(point: int) -> int:
    """The plain letter of a Latin letter beyond ASCII, by its Unicode name; a space for anything else."""
    name = unicodedata.name(chr(point), "").replace("DOTLESS ", "")
    found = re.match(r"LATIN (?:SMALL|CAPITAL) (?:LETTER|LIGATURE) (\w)", name)
    return ord(found[1].lower()) if found else SPACE


#: Of the characters U+00C0 to U+017F, two bytes each.
_LATIN = np.array([_base(x) for x in range(0xC0, 0x180)], dtype=np.uint8)


class Words(NamedTuple):
    """The words of neighbouring texts: folded bytes, starts, ends, and the number of the text each is in."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def _without(x: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = np.concatenate([[0], np.cumsum(~gone)])
    return x[~gone], kept[offsets]


def _invisible(raw: np.ndarray) -> np.ndarray:
    """Soft hyphens, combining marks, zero-width characters."""
    gone = np.zeros(len(raw), dtype=bool)
    for lead, low, high, size in ((0xC2, 0xAD, 0xAD, 2), (0xCC, 0x80, 0xBF, 2), (0xCD, 0x80, 0xAF, 2), (0xE2, 0x80, 0x80, 3)):
        at = np.flatnonzero(raw == lead)
        at = at[(raw[at + 1] >= low) & (raw[at + 1] <= high)]
        if size == 3:
            at = at[(raw[at + 2] >= 0x8B) & (raw[at + 2] <= 0x8F)]
        for k in range(size):
            gone[at + k] = True
    return gone


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of neighbouring texts with spaces around each, and where each begins (one more for the end)."""
    n = len(offsets) - 1
    raw = np.full(len(data) + 2 * n + 2, SPACE, dtype=np.uint8)
    raw[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 2, np.diff(offsets))] = data
    offsets = offsets + 2 * np.arange(n + 1)
    gone = _invisible(raw)
    if gone.any():
        raw, offsets = _without(raw, offsets, gone)
    x = _PLAIN[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))
    x[lead + 1] = _LATIN[(raw[lead].astype(np.int64) - 0xC3) * 64 + (raw[lead + 1] & 63)]
    signs = np.flatnonzero(raw == 0xC2)  # U+0080 to U+00BF, no letters but two
    x[signs] = x[signs + 1] = SPACE
    signs = np.flatnonzero((raw[:-1] == 0xE2) & (raw[1:] == 0x80))  # general punctuation
    for k in range(3):
        x[signs + k] = SPACE
    gone = np.zeros(len(x), dtype=bool)
    gone[lead] = True
    letter = x != SPACE
    gone[1:-1] |= _BETWEEN[raw[1:-1]] & letter[:-2] & letter[2:]
    x, offsets = _without(x, offsets, gone)
    starts, ends = runs(x != SPACE, offsets)
    if len(starts) > 2:
        single = ends - starts == 1
        near = single[:-1] & single[1:] & (starts[1:] - ends[:-1] == 1)
        pair = near[:-1] & near[1:]
        long = np.append(pair, False) | np.append(False, pair)
        gone = np.zeros(len(x), dtype=bool)
        gone[ends[:-1][long]] = True
        x, offsets = _without(x, offsets, gone)
    again = np.zeros(len(x), dtype=bool)
    again[1:] = (x[1:] == x[:-1]) & (x[1:] < 128) & (x[1:] != SPACE)
    return _without(x, offsets, again)


def _stretches(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) like ``parts``, but a longer text comes in several stretches of its own."""
    for row, data, offsets in parts(texts, CHUNK_BYTES):
        if len(offsets) > 2 or len(data) <= 2 * CHUNK_BYTES:
            yield row, data, offsets
            continue
        at = 0
        while at < len(data):
            end = min(len(data), at + CHUNK_BYTES)
            if end < len(data):
                space = np.flatnonzero(data[end - STRETCH : end] <= SPACE)
                end = end - STRETCH + int(space[-1]) if len(space) else end
                while data[end] & 0xC0 == 0x80:  # not inside a character
                    end -= 1
            yield row, data[at:end], np.array([0, end - at])
            at = end


def words(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """Words of runs of rows: (number of the run's first row, words with texts counted from there)."""
    for row, data, offsets in _stretches(texts):
        x, offsets = folded(data, offsets)
        starts, ends = runs(x != SPACE, np.array([0, len(x)]))
        yield row, Words(x, starts, ends, np.searchsorted(offsets, starts, side="right") - 1)


def keys(found: Words) -> np.ndarray:
    """A 64-bit hash of each word."""
    return span_hashes(found.data, found.starts, found.ends, fold=False)


def pieces(x: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, (number of the word, hash of BITS bits) of every piece."""
    n = len(x)
    total, down = prefix_hashes(x)

    def hashed(at: np.ndarray, size: int) -> np.ndarray:
        return (mix((total[at + size] - total[at]) * down[at] + np.uint64(size)) >> np.uint64(64 - BITS)).astype(np.int32)

    word = np.cumsum(np.bincount(starts, minlength=n)[:n], dtype=np.int32) - 1
    spaces = np.concatenate([[0], np.cumsum(x == SPACE, dtype=np.int32)])
    for size in PIECES:
        if n < size:
            continue
        last = n - size + 1
        at = np.flatnonzero(spaces[size - 1 : size - 1 + last] == spaces[1 : 1 + last])
        yield word[at + 1], hashed(at, size)
    for size in BEGINNINGS:
        of = np.flatnonzero(starts + size <= n)
        of = of[spaces[starts[of] + size] == spaces[starts[of]]]
        yield of.astype(np.int32), hashed(starts[of] - 1, size + 1)
