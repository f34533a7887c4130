"""Words and shingles of many texts at once, as 64-bit hashes computed on the UTF-8 bytes of an Arrow column.

A word of up to LONG bytes is hashed as a polynomial in its bytes, a longer one by xxHash, so no two
places of a long word can be exchanged unseen. Two different words, or shingles, have equal hashes with a
chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: bytes of a word up to which its hash is a polynomial
LONG = 256
_POW = np.cumprod(np.full(LONG, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
#: bytes that are hashed together; temporary arrays hold some 40 times as many
WINDOW = 1 << 20


def byte_table(separators: bytes) -> np.ndarray:
    """Value of each byte, 0 for separators; A-Z count as a-z."""
    t = _BYTE.copy()
    t[65:91] = t[97:123]
    t[list(separators)] = 0
    return t


#: words are runs of anything but space and \x09-\x0D
SPACED = byte_table(b" \x09\x0a\x0b\x0c\x0d")
#: words are runs of digits, letters (lower-cased) and everything beyond ASCII
ALNUM = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; a longer text comes alone; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of the first word of each text and the end)."""
    hashes, first, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data):  # cut at a separator
            gaps = np.flatnonzero(table[data[at:end]] == 0)
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + WINDOW, len(data))
        v = table[data[at:end]]
        m = v != 0
        st = m.copy()
        st[1:] &= ~m[:-1]
        edge = off[(off >= at) & (off < end)] - at
        st[edge] |= m[edge]
        starts = np.flatnonzero(st)
        if len(starts):
            lens = np.diff(np.append(starts, len(v)))
            rel = np.arange(starts[0], len(v)) - np.repeat(starts, lens)
            h = mix(np.add.reduceat(v[starts[0] :] * _POW[np.minimum(rel, LONG - 1)], starts - starts[0]))
            for k in np.flatnonzero(lens > LONG).tolist():  # a separator or none ends it
                size = int(m[starts[k] : starts[k] + lens[k]].sum())
                if size > LONG:
                    word = data[at + starts[k] : at + starts[k] + size].tobytes().lower()
                    h[k] = xxhash.xxh3_64_intdigest(word)
            hashes.append(h)
            first.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(first), off)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of k consecutive words; of all its words where it has fewer; none without words."""
    s = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        s = hashes[: len(hashes) - k + 1]
        for j in range(1, k):
            s = s * _A + hashes[j : len(hashes) - k + 1 + j]
        s = mix(s)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in hashes[a:b]:
                    h = h * _A + w
            yield mix(np.array([h]))
        else:
            yield s[:0]
