"""Vectorised kernels over the UTF-8 bytes of Arrow string columns.

Words are `[^\\x20\\x09-\\x0D]+`; the separators are ASCII, so splitting bytes and splitting characters agree.
Work goes in chunks of whole texts of about CHUNK bytes, which bounds memory by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEEDS = 2
#: A number for each byte value and seed.
_BYTE = [mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(0x2545F4914F6CDD1D) * U(s)) for s in range(SEEDS)]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null is the empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    data, offsets = utf8(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word."""
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words, from one prefix sum over their bytes.

    A word's hash is the sum of a mixed number for each byte and its place in the word. Mixing byte and place together isn't
    linear, so regular words don't cancel out as they do under a polynomial. Seeds give independent hashes.
    """
    long = ends - starts
    cut = np.concatenate([[0], np.cumsum(long)])
    place = np.arange(cut[-1], dtype=np.int64) - np.repeat(cut[:-1], long)
    own = data[place + np.repeat(starts, long)]
    sums = np.zeros(len(own) + 1, dtype=U)
    np.cumsum(mix(_BYTE[seed][own] + place.astype(U) * U(0xD1342543DE82EF95)), out=sums[1:])
    return mix(sums[cut[1:]] - sums[cut[:-1]] + long.astype(U))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int, seed: int = 0, second: bool = False) -> tuple[np.ndarray, ...]:
    """Sorted distinct hashes of each text's word shingles, end to end, and how many each text has; with `second`, also the
    hashes of the same shingles by another seed.

    A-Z are lower-cased. A text of fewer than `width` words, but one at least, is one shingle of all its words.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, text = words(data, offsets)
    if not len(starts):
        return (np.zeros(0, U), np.zeros(n, np.int64), np.zeros(0, U))[: 2 + second]
    own = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(own)])
    short = np.flatnonzero((own > 0) & (own < width))
    found = []
    for s in (seed, seed + 1)[: 1 + second]:
        h = word_hashes(data, starts, ends, s)
        v = h.copy()
        for j in range(1, width):
            v[: len(h) - j] = mix(v[: len(h) - j] * U(0x9E3779B97F4A7C15) + h[j:])
        for d in short:
            x = h[first[d] : first[d] + 1].copy()
            for j in range(1, own[d]):
                x = mix(x * U(0x9E3779B97F4A7C15) + h[first[d] + j : first[d] + j + 1])
            v[first[d]] = mix(x + U(own[d]))[0]
        found.append(v)
    whole = np.zeros(len(starts), dtype=bool)
    if len(starts) >= width:
        whole[: len(starts) - width + 1] = text[: len(starts) - width + 1] == text[width - 1 :]
    whole[first[short]] = True
    text = text[whole]
    found = [v[whole] for v in found]
    cut = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
    for d in np.flatnonzero(np.diff(cut) > 1):
        at = slice(cut[d], cut[d + 1])
        if second:
            order = np.argsort(found[0][at])
            found[0][at], found[1][at] = found[0][at][order], found[1][at][order]
        else:
            found[0][at].sort()
    v = found[0]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
    return (v[keep], np.bincount(text[keep], minlength=n), *(x[keep] for x in found[1:]))


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over offsets[i]:offsets[i+1]; 0 where that is empty."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
