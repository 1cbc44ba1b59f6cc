"""Benchmark decontamination: broadcast set of test n-grams, scanned by training windows, hits verified.

Words are runs of digits, letters and non-ASCII characters, lower-cased for A-Z. Every item gives its windows of
`size` consecutive words; an item of fewer words, but not none, is one window. A document word is hit if it lies
inside an occurrence of a window. Candidate windows come from 64-bit hashes behind a bitmap; each candidate is then
compared word by word, so a hash that agrees by chance never counts.

The broadcast set is held to `broadcast_bytes`. Beyond that bound only a bitmap of the hashes is broadcast, at most
2**MOST_BITS bits; the windows of documents that it lets through are joined with the benchmark's windows by a shuffle,
on their hashes and words, and what they hit is brought back to the documents by another. Results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.store import Workspace, keyed, tidied
from pactum.llm.words import MARKS, batches, grams, utf8

SIZE = 10
BROADCAST_BYTES = 32 << 20
_BITS = 20
#: Bits of the broadcast bitmap for each window, and in all, where the windows themselves are too many.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 30
#: Bits that a task gathers as one block.
_BLOCK = 16
_NOT_WORD = bytes(0x20 if mark else (i + 32 if 0x41 <= i <= 0x5A else i) for i, mark in enumerate(MARKS))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_NOT_WORD).split()


def _windows(items: list[tuple[object, bytes]], size: int):
    """(words of the items, one blank apart, and for each length: hashes, first and last byte, item) of all windows."""
    blob, made, at = [], {}, 0
    for number, (_, text) in enumerate(items):
        words = words_of(text)
        if not words:
            continue
        length = min(size, len(words))
        ends = at + np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[at], ends[:-1] + 1])
        many = len(words) - length + 1
        made.setdefault(length, []).append((_hashes(words, length), starts[:many], ends[length - 1 :], np.full(many, number)))
        blob.append(b" ".join(words) + b" ")
        at += len(blob[-1])
    return b"".join(blob), {length: tuple(np.concatenate(x) for x in zip(*parts)) for length, parts in sorted(made.items())}


class Windows:
    """Windows of a set of items, each once: by length the sorted hashes, a bitmap over them, where the words stand for
    the comparison, and the items that have it."""

    def __init__(self, items: list[tuple[object, bytes]], size: int):
        self.names = [name for name, _ in items]
        self.words, parts = _windows(items, size)
        self.lengths = []
        for length, (keys, starts, ends, item) in parts.items():
            texts = [self.words[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            order = sorted(range(len(texts)), key=lambda k: (keys[k], texts[k], item[k]))  # noqa: B023
            fresh = np.array([j == 0 or texts[k] != texts[order[j - 1]] for j, k in enumerate(order)])
            order = np.array(order)
            first = np.flatnonzero(fresh)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[keys >> np.uint64(64 - _BITS)] = True
            kept = order[first]
            self.lengths.append((length, keys[kept], np.packbits(bitmap), starts[kept], ends[kept], np.append(first, len(order)), item[order].astype(np.int32)))

    def items_of(self, table: tuple, key: np.uint64, window: bytes) -> list:
        """The names of the items that have a window."""
        _, keys, _, starts, ends, first, item = table
        for k in range(int(np.searchsorted(keys, key)), len(keys)):
            if keys[k] != key:
                break
            if self.words[starts[k] : ends[k]] == window:
                return [self.names[i] for i in np.unique(item[first[k] : first[k + 1]])]
        return []


def _hashes(words: list[bytes], length: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    parts = [h for _, _, _, _, h in batches(data, np.array([0, len(data)], np.int64), MARKS)]
    return grams(np.concatenate(parts), length)


def scan(column: pa.Array, windows: Windows) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]], set]]:
    """For each text: its row, number of words, hit spans (words, then bytes) merged by word, and the items found."""
    data, offsets = utf8(column)
    tables = [(table, np.unpackbits(table[2]).astype(bool)) for table in windows.lengths]
    for row, counts, starts, ends, hashes in batches(data, offsets, MARKS):
        bounds = np.concatenate([[0], np.cumsum(counts)])
        found: dict[int, list] = {}
        names: dict[int, set] = {}
        for table, bitmap in tables:
            length, keys = table[:2]
            sums = grams(hashes, length)
            at = np.flatnonzero(bitmap[sums >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, sums[at]), len(keys) - 1)
            at = at[keys[place] == sums[at]]
            owner = np.searchsorted(bounds, at, "right") - 1
            whole = at + length <= bounds[owner + 1]
            for k, doc in zip(at[whole].tolist(), owner[whole].tolist()):
                items = windows.items_of(table, sums[k], b" ".join(words_of(data[starts[k] : ends[k + length - 1]].tobytes())))
                if items:
                    base = offsets[row + doc]
                    found.setdefault(doc, []).append((k, k + length, int(starts[k] - base), int(ends[k + length - 1] - base)))
                    names.setdefault(doc, set()).update(items)
        for doc, n in enumerate(counts.tolist()):
            yield row + doc, n, _merge(found.get(doc, [])), names.get(doc, set())


def _merge(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans (first word, end, first byte, end) that meet or overlap made one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, s, e in sorted(spans):
        if out and a <= out[-1][1]:
            first, end, low, high = out[-1]
            out[-1] = (first, max(end, b), low, max(high, e))
        else:
            out.append((a, b, s, e))
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def load(items: DataFrame, size: int, broadcast_bytes: int):
    """The windows of the items as a broadcast variable, or None if they might take more than the bound."""
    # A window stands for a word: a hash, its place and its item are 32 bytes, a word and its blank 2 bytes at least.
    need = 18 * int(items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0])
    if need > broadcast_bytes:
        return None
    rows = [(r.name, r.text.encode()) for r in items.orderBy("name").collect()]
    return items.sparkSession.sparkContext.broadcast(Windows(rows, size))



def _shuffled(rows: DataFrame, items: DataFrame, size: int, work: Workspace) -> DataFrame:
    """(key, found, items) of the rows (key, text) that hit something; found are spans, not merged yet."""

    def split(parts):
        for batch in parts:
            names, texts = (batch.column(k).to_pylist() for k in range(2))
            words, made = _windows([(n, t.encode()) for n, t in zip(names, texts)], size)
            for length, (keys, starts, ends, item) in made.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), length), pa.int32()), pa.array(keys.view(np.int64)), pa.array([words[a:b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()), pa.array([names[i] for i in item.tolist()], pa.string())],
                    names=["length", "hash", "window", "name"],
                )

    windows = work.cut(items.mapInArrow(tidied(split), "length int, hash long, window binary, name string").distinct(), "windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    bits = min(MOST_BITS, max(LEAST_BITS, int(BITS_EACH * windows.count()).bit_length()))
    known = rows.sparkSession.sparkContext.broadcast(_bitmap(windows, bits))

    def look(parts):
        for batch in parts:
            if not batch.num_rows:
                continue
            keys, bitmap = batch.column(0), known.value
            data, offsets = utf8(batch.column(1))
            for row, counts, starts, ends, hashes in batches(data, offsets, MARKS):
                bounds = np.concatenate([[0], np.cumsum(counts)])
                for length in lengths:
                    sums = grams(hashes, length)
                    cell = sums >> np.uint64(64 - bits)
                    at = np.flatnonzero((bitmap[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1)
                    owner = np.searchsorted(bounds, at, "right") - 1
                    whole = at + length <= bounds[owner + 1]
                    at, owner = at[whole], owner[whole]
                    if len(at):
                        base, low, high = offsets[row + owner], starts[at], ends[at + length - 1]
                        texts = [b" ".join(words_of(data[a:b].tobytes())) for a, b in zip(low.tolist(), high.tolist())]
                        numbers = [at - bounds[owner], at - bounds[owner] + length, low - base, high - base]
                        yield pa.RecordBatch.from_arrays(
                            [keys.take(pa.array(row + owner)), pa.array(np.full(len(at), length), pa.int32()), pa.array(sums[at].view(np.int64)), pa.array(texts, pa.binary()), *(pa.array(x, pa.int64()) for x in numbers)],
                            names=["key", "length", "hash", "window", "a", "b", "s", "e"],
                        )

    seen = rows.mapInArrow(tidied(look), "key long, length int, hash long, window binary, a long, b long, s long, e long")
    found = work.cut(seen.join(windows, ["length", "hash", "window"]).select("key", "a", "b", "s", "e", "name"), "found", windows)
    spans = found.select("key", F.struct("a", "b", "s", "e").alias("span")).distinct().groupBy("key").agg(F.collect_list("span").alias("found"))
    names = found.select("key", "name").distinct().groupBy("key").agg(F.sort_array(F.collect_list("name")).alias("items"))
    return spans.join(names, "key")


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, set for the leading bits of each hash; made in blocks by the tasks."""

    def mark(parts):
        for batch in parts:
            cell = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            for block in np.unique(cell >> np.uint64(_BLOCK)).tolist():
                inside = np.zeros(1 << _BLOCK, bool)
                inside[cell[cell >> np.uint64(_BLOCK) == block] & np.uint64((1 << _BLOCK) - 1)] = True
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(inside).tobytes()], pa.binary())], names=["block", "cells"])

    def unite(parts):
        whole: dict[int, np.ndarray] = {}
        for batch in parts:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.frombuffer(cells, np.uint8)
                whole[block] = whole[block] | cells if block in whole else cells
        for block, cells in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])

    kind = "block int, cells binary"
    parts = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = windows.select("hash").mapInArrow(mark, kind).repartition(parts, "block").mapInArrow(unite, kind)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for block, cells in marked.toLocalIterator():
        at = block << (_BLOCK - 3)
        out[at : at + (1 << (_BLOCK - 3))] = np.frombuffer(cells, np.uint8)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted item names), spans (start, end in UTF-8 bytes).

    Null and empty texts have no words, so no hits; items without words match nothing; repeated item ids count once.
    Repeated documents give a row each. Other columns are not read. Empty tables give no rows or no hits.
    """
    items = _items(benchmark, item_col, item_text_col)
    known = load(items, size, broadcast_bytes)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    if known is not None:

        def run(parts):
            for batch in parts:
                if batch.num_rows:
                    yield _rows(batch.column(0), list(scan(batch.column(1), known.value)))

        return rows.mapInArrow(tidied(run), made).withColumnRenamed("id", id_col)
    work = Workspace(docs.sparkSession, "benchmark")
    rows, key = keyed(rows, "id", "smallest", work, whole=True)
    rows = rows.withColumn("key", F.col(key).cast("long"))
    some = _shuffled(rows.select("key", "text"), items, size, work)
    wide = rows.join(some, "key", "left").select("id", "text", "found", "items")

    def gather(parts):
        for batch in parts:
            if batch.num_rows:
                spans, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                words = [n for _, n, _, _ in scan(batch.column(1), Windows([], size))]
                yield _rows(batch.column(0), [(k, words[k], _merge([(x["a"], x["b"], x["s"], x["e"]) for x in spans[k] or ()]), set(names[k] or ())) for k in range(batch.num_rows)])

    return work.lend(wide.mapInArrow(tidied(gather), made).withColumnRenamed("id", id_col))


def _rows(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array([n for _, n, _, _ in found], pa.int64()), pa.array([sum(b - a for a, b, _, _ in spans) for _, _, spans, _ in found], pa.int64()),
            pa.array([sorted(names) for _, _, _, names in found], pa.list_(pa.string())), pa.array([[{"start": s, "end": e} for _, _, s, e in spans] for _, _, spans, _ in found], span),
        ],
        names=["id", "n_words", "n_hit", "items", "spans"],
    )


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, drop_share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SIZE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the hit spans of their texts; a document goes when drop_share or more of its words are hit.

    One pass over the rows, all columns pass through. Texts without hits stay as they are, null too. Rows with null or
    repeated ids are rows of their own; without items nothing goes; an empty table gives none.
    """
    items = _items(benchmark, item_col, item_text_col)
    known = load(items, size, broadcast_bytes)
    place, names = docs.columns.index(text_col), docs.columns
    if known is not None:

        def run(parts):
            for batch in parts:
                if batch.num_rows:
                    found = {row: (n, spans) for row, n, spans, _ in scan(batch.column(place), known.value) if spans}
                    yield from _cleaned(batch, place, found, drop_share)

        return docs.mapInArrow(tidied(run), docs.schema)
    work = Workspace(docs.sparkSession, "benchmark")
    rows, key = keyed(docs, id_col, "smallest", work, whole=True)
    at = rows.columns.index(key)
    rows = rows.toDF(*(f"_c{k}" for k in range(len(rows.columns))))  # by place: columns of docs may have any name
    some = _shuffled(rows.select(F.col(f"_c{at}").cast("long").alias("key"), F.col(f"_c{place}").cast("string").alias("text")), items, size, work)
    wide = rows.join(some.select(F.col("key").alias(f"_c{at}"), "found"), f"_c{at}", "left").select(*(f"_c{k}" for k in range(len(names))), "found")

    def gather(parts):
        for batch in parts:
            if batch.num_rows:
                spans = batch.column(len(names)).to_pylist()
                words = {row: n for row, n, _, _ in scan(batch.column(place), Windows([], size))} if any(spans) else {}
                found = {row: (words[row], _merge([(x["a"], x["b"], x["s"], x["e"]) for x in got])) for row, got in enumerate(spans) if got}
                yield from _cleaned(batch.select(range(len(names))), place, found, drop_share)

    return work.lend(wide.mapInArrow(tidied(gather), docs.schema))


def _cleaned(batch: pa.RecordBatch, place: int, found: dict[int, tuple[int, list]], drop_share: float) -> Iterator[pa.RecordBatch]:
    """The rows without their spans (number of words, spans), unless too much of the text goes with them."""
    if not found:
        yield batch
        return
    texts, stay = batch.column(place).to_pylist(), np.ones(batch.num_rows, bool)
    for row, (words, spans) in found.items():
        stay[row] = sum(b - a for a, b, _, _ in spans) < drop_share * words
        data, parts, at = texts[row].encode(), [], 0
        for _, _, s, e in spans:
            parts.append(data[at:s])
            at = e
        texts[row] = b"".join([*parts, data[at:]]).decode()
    columns = list(batch.columns)
    columns[place] = pa.array(texts, columns[place].type)
    out = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stay))
    if out.num_rows:
        yield out


def item_hash(names: list[str]) -> str:
    """The digest that digests() derives, for tests."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
