"""Words of UTF-8 texts and their 64-bit hashes, for whole batches at once with numpy.

A word is a run of bytes that are not separators; A-Z count as a-z. A word's bytes are taken eight at a time; each
eight are mixed with their position, the results are summed and mixed with the length. The mixing is not linear, so
no pattern of a word cancels out; words of up to eight bytes and equal length never share a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _places(n: int, first: int = 0) -> np.ndarray:
    """A fixed random value for each eight bytes of a word, by their number."""
    return mix(np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_FIRST = _places(1)[0]
#: Shifts that drop what lies behind the end of a word of so many bytes.
_SHIFTS = np.array([8 * (8 - n) for n in range(9)], np.uint64) % np.uint64(64)


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Space and the five ASCII control characters that count as white space.
BLANKS = separators([(0x20, 0x20), (0x09, 0x0D)])
#: All of ASCII but digits and letters.
MARKS = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as integers; small letters, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=padded[: len(data)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _sums(eights: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums that the hashes of words of these positions and lengths are made of."""
    first = eights[starts]
    keep = np.minimum(sizes, 8)
    shift = _SHIFTS[keep]
    out = mix((first << shift >> shift) ^ _FIRST)
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) // 8
        owner = np.repeat(np.arange(len(long)), more)
        ends = np.cumsum(more)
        number = np.arange(1, len(owner) + 1) - np.repeat(ends - more, more)
        shift = _SHIFTS[np.minimum(sizes[long][owner] - 8 * number, 8)]
        part = eights[starts[long][owner] + 8 * number] << shift >> shift
        most = int(more.max())
        part = mix(part ^ _places(most, 1)[number - 1])
        out[long] += np.add.reduceat(part, ends - more)
    return out


def _finish(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return mix(sums ^ mix(sizes.astype(np.uint64) + np.uint64(0xA0761D6478BD642F)))


def _long_word(data: np.ndarray) -> int:
    """The sum of one word of any length, a segment at a time."""
    total = 0
    for lo in range(0, len(data), SEGMENT):
        part = data[lo : lo + SEGMENT]
        eights = _eights(part)[: len(part) : 8]
        total += int(mix(eights ^ _places(len(eights), lo // 8)).sum(dtype=np.uint64))
    return total & _MASK


def _segment(data: np.ndarray, cuts: np.ndarray, table: np.ndarray):
    """Words of some bytes; no word crosses one of the cuts."""
    inside = ~table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, _sums(_eights(data), starts, ends - starts)


def _one(data: np.ndarray, table: np.ndarray):
    """Words of one text of any length, cut at separators."""
    out, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        if hi < len(data):
            gaps = np.flatnonzero(table[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                while hi < len(data) and not table[data[hi]]:
                    step = np.flatnonzero(table[data[hi : hi + SEGMENT]])
                    hi = hi + int(step[0]) if len(step) else min(len(data), hi + SEGMENT)
                out.append((np.array([lo]), np.array([hi]), np.array([_long_word(data[lo:hi])], np.uint64)))
                lo = hi
                continue
        starts, ends, sums = _segment(data[lo:hi], np.zeros(0, np.int64), table)
        out.append((starts + lo, ends + lo, sums))
        lo = hi
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def batches(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Yields (first row, counts of words by row, starts, ends, hashes) for runs of rows of about SEGMENT bytes.

    starts and ends are positions in data. A text longer than SEGMENT comes alone.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[stop])
        if hi - lo > SEGMENT:
            starts, ends, sums = _one(data[lo:hi], table)
        else:
            starts, ends, sums = _segment(data[lo:hi], offsets[row:stop] - lo, table)
        counts = np.diff(np.searchsorted(starts, offsets[row : stop + 1] - lo))
        yield row, counts, starts + lo, ends + lo, _finish(sums, ends - starts)
        row = stop


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words; positions that run past the end are the caller's to mask."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size * 0x2545F4914F6CDD1D & _MASK, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * np.uint64(pow(0xE7037ED1A0B428DB, k + 1, 1 << 64))
    return mix(total)
