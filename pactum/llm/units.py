"""Tokenisation of whole texts by pieces that are encoded once for each worker.

Byte-level BPE splits a text into pre-tokens before it merges: contractions, and runs of letters, of digits or of other
marks, each with a space before it. So a space that a non-blank follows begins a pre-token, and so does a mark other
than an apostrophe behind a letter. A text is cut there, the pieces are encoded separately and their ids joined. A column's pieces are numbered by Arrow's dictionary encoding, only pieces that a worker hasn't
met are encoded, and the ids of all texts are gathered from its table at once. The table is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept by a worker, about 200 MB; then it starts anew.
KEPT = 1 << 20
#: Bytes of the pieces kept, and four times the ids: long pieces fill the table sooner.
HELD = 1 << 26
#: Bytes of texts encoded at once.
SLICE = 8 << 20
#: Bytes of new pieces that are encoded as one text.
RUN = 1 << 16

#: Whether a byte behind a space shows that no blank follows: ASCII marks, letters and digits, and first bytes of
#: characters other than those with which blanks begin. Where it doesn't show, the text isn't cut.
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x21:0x7F] = True
_FOLLOWS[0x80:] = True
_FOLLOWS[[0xC2, 0xE1, 0xE2, 0xE3]] = False

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[k for k in range(0x21, 0x7F) if not chr(k).isalnum() and chr(k) != "'"]] = True


def cuts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray = _MARK) -> np.ndarray:
    """The positions at which pieces of the texts at these offsets of data begin, and the end of the last."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    begins = np.zeros(hi - lo + 1, bool)
    np.logical_and(part[:-1] == 0x20, _FOLLOWS[part[1:]], out=begins[: hi - lo - 1])
    begins[1 : hi - lo] |= _LETTER[part[:-1]] & marks[part[1:]]
    begins[offsets - lo] = True
    return np.flatnonzero(begins) + lo


def in_runs(encode: Callable[[list[str]], list], lengths: np.ndarray) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """The ids of pieces, and how many each has, by a library that encodes texts; lengths: the bytes of each id.

    Pieces that begin with a space that a word follows are joined to longer texts, which the library encodes faster;
    where a piece ends among the ids follows from their lengths. Should the lengths not add up to the texts, each piece
    is encoded by itself.
    """

    def run(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"".join(pieces)
        line = np.frombuffer(data + b"\0", np.uint8)
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        follows = (line[starts] == 0x20) & (sizes > 1) & _FOLLOWS[line[np.minimum(starts + 1, len(data))]]
        breaks = starts[~follows | (starts // RUN != np.concatenate([[-1], starts[:-1] // RUN]))]
        texts = [data[a:b].decode() for a, b in zip(breaks.tolist(), [*breaks[1:].tolist(), len(data)])]
        made = encode(texts)
        flat = np.concatenate([np.asarray(x, np.uint32) for x in made])
        at = np.cumsum(lengths[flat])
        place = np.searchsorted(at, ends)
        if len(at) and at[-1] == len(data) and (at[place] == ends).all():
            return flat, np.diff(place + 1, prepend=0)
        made = encode([p.decode() for p in pieces])
        return np.concatenate([np.asarray(x, np.uint32) for x in made]), np.array([len(x) for x in made], np.int64)

    return run


class Encoder:
    """encode: the ids of a list of pieces in one array, and how many each has. whole: special tokens that the library
    finds in texts before it splits them; their marks cut no text."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT, whole: list[str] = ()):
        if any(" " in w for w in whole):
            raise ValueError("special tokens with spaces")
        self.encode, self.kept, self.marks = encode, kept, _MARK.copy()
        self.marks[np.frombuffer("".join(whole).encode(), np.uint8)] = False
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held, self.used = 0, 0
        self.flat, self.starts, self.sizes = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        made, sizes = self.encode(pieces)
        first, total = len(self.known), int(sizes.sum())
        self.starts, self.sizes, self.flat = _room(self.starts, first + len(pieces)), _room(self.sizes, first + len(pieces)), _room(self.flat, self.used + total)
        self.sizes[first : first + len(pieces)] = sizes
        self.starts[first : first + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = made
        self.used += total
        self.held += sum(map(len, pieces)) + 16 * total
        self.known.update(zip(pieces, range(first, first + len(pieces))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, null as empty, and where those of each text end."""
        column = pc.fill_null(texts.cast(pa.large_string()), "")
        _, where, body = column.buffers()
        offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        if body is None or not len(column) or offsets[0] == offsets[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        if len(self.known) > self.kept or self.held > HELD:
            self._clear()
        at = cuts(np.frombuffer(body, np.uint8), offsets, self.marks)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), body]).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        new = [p for p in names if p not in self.known]
        if new:
            self._learn(new)
        slot = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[pieces.indices.to_numpy()]
        sizes = self.sizes[slot]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[slot] - (ends - sizes), sizes)
        place += np.arange(len(place))
        last = np.searchsorted(at, offsets[1:])
        return self.flat[place], np.concatenate([[0], ends])[last]


def _room(table: np.ndarray, n: int) -> np.ndarray:
    """The table with room for n."""
    if n <= len(table):
        return table
    out = np.zeros(max(n, 2 * len(table)), table.dtype)
    out[: len(table)] = table
    return out


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def id_lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Texts' ids as a column of lists of 32-bit integers."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
