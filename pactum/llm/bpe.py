"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of many pre-tokens form one linked list, with a wall between any two that no token reaches across. Each
adjacent pair whose bytes together are a token waits in the bucket of that token's rank. A bitmap of two levels says
which buckets hold something: find-first-set on the upper word gives a lower word, find-first-set there gives the
rank. The bucket's positions are merged from left to right, entries that a merge made stale are skipped, and a merge
enters its two new pairs; one of a lower rank goes before the rest of the bucket. Each step costs the same whatever
the length, so n bytes take O(n) merges (and the sorting of buckets), not O(n * n).
"""

from __future__ import annotations

import base64
import functools
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.store import tidied
from pactum.llm.units import KEPT, Encoder, id_lists, slices

_WORD = 8  # bits of a rank that index a lower word
#: Pieces kept by a worker besides KEPT pre-tokens, of which pieces are made.
PIECES = 1 << 17
#: Longer pre-tokens, in characters, are encoded each time.
LONGEST = 64
_WALL = 256  # follows the values of a byte
#: Bytes of pre-tokens that share a queue; a longer pre-token has one of its own.
BATCH = 1 << 17


class Ranks:
    """Vocabulary of a ranks file: one base64 token and its rank a line. The file's path is a parameter.

    kept: pre-tokens whose ids a worker keeps, about 160 bytes each; fewer take more time and give the same ids.
    """

    def __init__(self, path: str, pattern: str, kept: int | None = None):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.table, self.lengths, self.offsets = np.frombuffer(b"".join(self.tokens), np.uint8), lengths, np.cumsum(lengths) - lengths
        self.lower = [0] * ((size >> _WORD) + 1)
        # Of bytes and of the wall: the id, the bytes, and the rank of each pair. A wall is longer than any token.
        wall = b"\0" * (int(lengths.max()) + 1)
        self.bytes = [bytes([b]) for b in range(256)] + [wall]
        self.units = np.array([self.ranks[b] for b in self.bytes[:256]] + [-1])
        self.pairs = np.full((257, 257), -1, np.int64)
        for token in (t for t in self.tokens if len(t) == 2):
            self.pairs[token[0], token[1]] = self.ranks[token]
        self.kept = KEPT if kept is None else kept
        self.known: dict[str, bytes] = {}
        self.encoder = Encoder(self.ids_of, min(PIECES, self.kept))

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else np.frombuffer(self.merge_all([data])[0], np.uint32).tolist()

    def merge_all(self, pretokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as unsigned 32-bit little-endian bytes; all lie in one list, with walls between them."""
        find, tokens, lower = self.ranks.get, self.tokens, self.lower
        line = np.frombuffer(b"\0" + b"\0".join(pretokens) + b"\0", np.uint8).astype(np.int64)
        walls = np.cumsum([0, *(len(t) + 1 for t in pretokens)])
        line[walls] = _WALL
        ids, parts = self.units[line].tolist(), [self.bytes[b] for b in line.tolist()]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank under which the pair at a position waits; -1: none.
        first = np.append(self.pairs[line[:-1], line[1:]], -1)
        waiting = first.tolist()
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        starts = np.flatnonzero(np.diff(first[order], prepend=-1))
        buckets: dict[int, list[int]] = {}
        upper = 0

        for rank, bucket in zip(first[order][starts].tolist(), np.split(order, starts[1:]) if len(starts) else ()):
            buckets[rank] = bucket.tolist()
            upper |= 1 << (rank >> _WORD)
            lower[rank >> _WORD] |= 1 << (rank & 255)
        while upper:
            word = (upper & -upper).bit_length() - 1
            bits = lower[word]
            rank = word << _WORD | (bits & -bits).bit_length() - 1
            lower[word] = bits & (bits - 1)
            if not lower[word]:
                upper &= upper - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            token = tokens[rank]
            for done, at in enumerate(bucket, 1):
                if waiting[at] != rank:
                    continue
                gone = after[at]
                left, right = before[at], after[gone]
                ids[at], ids[gone], waiting[gone], parts[at] = rank, -1, -1, token
                after[at], before[right] = right, at
                lowest = rank
                for place, pair in ((at, token + parts[right]), (left, parts[left] + token)):
                    waiting[place] = new = find(pair, -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(place)
                        else:
                            buckets[new] = [place]
                            upper |= 1 << (new >> _WORD)
                            lower[new >> _WORD] |= 1 << (new & 255)
                            if new < lowest:
                                lowest = new
                if lowest < rank:  # a lower rank goes before the rest of this one
                    if done < len(bucket):
                        buckets[rank] = bucket[done:]
                        upper |= 1 << word
                        lower[word] |= 1 << (rank & 255)
                    break
        made = np.array(ids, np.int64)
        kept = made >= 0
        ends = np.cumsum(kept)[walls] * 4
        flat = made[kept].astype("<u4").tobytes()
        return [flat[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        known, split = self.known, [self.split(piece.decode()) for piece in pieces]
        if len(known) > self.kept:
            known.clear()
        long, batch, size = [], [], 0

        def flush():
            known.update(zip(batch, self.merge_all([t.encode() for t in batch])))
            batch.clear()

        for token in set(chain.from_iterable(split)).difference(known):
            data = token.encode()
            whole = self.ranks.get(data)
            if len(token) > LONGEST:
                long.append(token)
            if whole is not None:
                known[token] = whole.to_bytes(4, "little")
                continue
            batch.append(token)
            size += len(data)
            if size >= BATCH:
                flush()
                size = 0
        if batch:
            flush()
        out = [b"".join(map(known.__getitem__, tokens)) for tokens in split]
        for token in long:
            del known[token]
        return out

    def ids_of(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        made = self.encode_pieces(pieces)
        return np.frombuffer(b"".join(made), np.uint32), np.array([len(x) // 4 for x in made], np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of the ids of several texts, which end at these places."""
        lengths = self.lengths[ids]
        stops = np.cumsum(lengths)
        place = np.repeat(self.offsets[ids] - (stops - lengths), lengths)
        place += np.arange(len(place))
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], ends])]
        data = pa.py_buffer(self.table[place])
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int64)), data]).cast(pa.binary())


@functools.cache
def ranks(path: str, pattern: str, kept: int | None = None) -> Ranks:
    """One for each worker and file."""
    return Ranks(path, pattern, kept)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kept: int | None = None) -> DataFrame:
    """One row per document: id, ids (array of int), decoded (the bytes of the ids).

    Whole texts; null and empty ones have no ids. Names of special tokens in a text are ordinary text. Repeated rows
    give a row each, other columns are not read, an empty table gives none. kept: see Ranks.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(parts):
        codec = ranks(path, pattern, kept)
        for batch in parts:
            for lo, hi in slices(batch.column(1), 1 << 20):
                ids, ends = codec.encoder.ids(batch.column(1)[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], id_lists(ids, ends), codec.decode(ids, ends)], names=["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
