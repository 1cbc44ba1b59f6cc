"""Token-ID files: independent zstandard frames, a trailing seek table and a checksum of each frame.

A file holds, in ascending order of document ids:

    frames          zstandard frames of at most FRAME_IDS ids each, little-endian unsigned 32-bit; no frame holds ids
                    of two documents
    index           a skippable frame: for each document id, null flag, first frame, frames, ids ('<q?QIQ')
    seek table      a skippable frame as zstandard's seekable format has it: for each frame its compressed and
                    decompressed size and the low 32 bits of XXH64 of its content; then the number of frames and magic

Any zstandard decoder reads the file as the plain run of ids; a reader that wants one document reads the two tables
and that document's frames.
"""

from __future__ import annotations

import functools
import io
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.store import Files, Workspace, tidied
from pactum.llm.units import Encoder, in_runs, slices

FRAME_IDS = 1 << 20
_INDEX = struct.Struct("<q?QIQ")
_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")
# Fixed values of the zstandard seekable format and of skippable frames.
_SKIPPABLE, _SEEK_TABLE, _SEEKABLE, _CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


def frames_of(ids: bytes, packer: zstandard.ZstdCompressor) -> tuple[list[bytes], list[int]]:
    """Frames of a document's ids and their checksums; no ids, no frame."""
    parts = [ids[k : k + 4 * FRAME_IDS] for k in range(0, len(ids), 4 * FRAME_IDS)]
    return [packer.compress(p) for p in parts], [xxhash.xxh64_intdigest(p) & 0xFFFFFFFF for p in parts]


class Writer:
    """Writes one file; add documents in ascending order."""

    def __init__(self, out):
        self.out, self.index, self.table, self.ids = out, [], [], 0

    def add(self, doc_id: int | None, n_ids: int, frames: list[bytes], checks: list[int]) -> None:
        self.index.append(_INDEX.pack(doc_id or 0, doc_id is None, len(self.table), len(frames), n_ids))
        for k, (frame, check) in enumerate(zip(frames, checks)):
            self.out.write(frame)
            self.table.append(_ENTRY.pack(len(frame), 4 * min(FRAME_IDS, n_ids - k * FRAME_IDS), check & 0xFFFFFFFF))
        self.ids += n_ids

    def close(self) -> None:
        index = b"".join(self.index)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(index)) + index)
        table = b"".join(self.table)
        self.out.write(struct.pack("<II", _SEEK_TABLE, len(table) + _FOOTER.size) + table + _FOOTER.pack(len(self.table), _CHECKSUMS, _SEEKABLE))


class Reader:
    """Reads one file: the tables first, then frames as they are asked for."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        file.seek(size - _FOOTER.size)
        count, flags, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != _SEEKABLE or flags != _CHECKSUMS:
            raise ValueError("not a token file")
        start = size - _FOOTER.size - count * _ENTRY.size
        file.seek(start)
        entries = np.frombuffer(file.read(count * _ENTRY.size), np.uint32).reshape(count, 3)
        self.sizes, self.raw, self.checks = entries[:, 0].astype(np.int64), entries[:, 1], entries[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        data = int(self.offsets[-1])
        file.seek(data)
        magic, length = struct.unpack("<II", file.read(8))
        if magic != _SKIPPABLE or data + 8 + length != start - 8:
            raise ValueError("the index of a token file is damaged")
        self.index = list(_INDEX.iter_unpack(file.read(length)))
        self.unpack = zstandard.ZstdDecompressor()

    def parts(self, entry):
        """The frames of a document, each checked."""
        _, _, first, count, _ = entry
        for k in range(first, first + count):
            self.file.seek(int(self.offsets[k]))
            ids = self.unpack.decompress(self.file.read(int(self.sizes[k])))
            if len(ids) != self.raw[k] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.checks[k]:
                raise ValueError(f"frame {k} is damaged")
            yield ids

    def read(self, doc_id: int | None) -> np.ndarray:
        """The ids of the first document of that id."""
        for entry in self.index:
            if (None if entry[1] else entry[0]) == doc_id:
                return np.frombuffer(b"".join(self.parts(entry)), np.uint32)
        raise KeyError(doc_id)


@functools.cache
def _library(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    # A token of a byte-level vocabulary has a character for each of its bytes.
    lengths = np.array([len(tokenizer.id_to_token(k) or "") for k in range(tokenizer.get_vocab_size())], np.int64)
    encode = in_runs(lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], lengths)
    return Encoder(encode, whole=[t.content for t in tokenizer.get_added_tokens_decoder().values()])


def write(docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> list[dict]:
    """Encodes whole texts with the tokenizers library and writes token files in ascending order of ids.

    folder: a URI that all executors reach. Ids are integers; a null id comes first. Null texts count as empty and
    hold the end id alone. Repeated ids follow each other, ordered by their content. An empty table gives a manifest without files.
    Each file is written under a name of its attempt and moved when whole; manifest.json, written last, lists them.
    Returns the manifest: name, first token, documents, tokens, bytes of each file.
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Splitters come from the ids alone, so no text is encoded twice, as a range partitioning by Spark would.
    at = F.percentile_approx("id", F.array(*(F.lit(k / files) for k in range(1, files))), 10_000) if files > 1 else F.array()
    splits = sorted(set(rows.agg(at.alias("at")).first()["at"] or []))
    end = np.uint32(end_id).tobytes()

    def encode(parts):
        packer, encoder = zstandard.ZstdCompressor(level=3), _library(path)
        for batch in parts:
            for lo, hi in slices(batch.column(1)):
                ids = batch.column(0)[lo:hi]
                key = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                flat, ends = encoder.ids(batch.column(1)[lo:hi])
                stops = ends.tolist()
                packed = [(y - x + 1, *frames_of(flat[x:y].tobytes() + end, packer)) for x, y in zip([0, *stops], stops)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.searchsorted(np.array(splits, np.int64), key, "right").astype(np.int32)),
                        ids,
                        pa.array([p[0] for p in packed], pa.int64()),
                        pa.array([p[1] for p in packed], pa.list_(pa.binary())),
                        pa.array([p[2] for p in packed], pa.list_(pa.int64())),
                    ],
                    names=["part", "id", "n", "frames", "checks"],
                )

    store = Files(folder)

    def save(parts):
        writer = None
        for batch in parts:
            for part, doc_id, n, frames, checks in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if writer is None or part != writer.part:
                    if writer is not None:
                        yield _finish(writer)
                    writer = Writer(store.write(f"tokens-{part:06d}.zst"))
                    writer.part = part
                writer.add(doc_id, n, frames, checks)
        if writer is not None:
            yield _finish(writer)

    coded = rows.mapInArrow(tidied(encode), "part int, id long, n long, frames array<binary>, checks array<long>")
    placed = coded.repartitionById(files, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "n", F.col("checks"))
    done = sorted(placed.mapInArrow(tidied(save), "part int, documents long, tokens long, bytes long").collect())
    manifest, first = [], 0
    for part, documents, tokens, size in done:
        manifest.append({"name": f"tokens-{part:06d}.zst", "first": first, "documents": documents, "tokens": tokens, "bytes": size})
        first += tokens
    out = store.write("manifest.json")
    out.write(json.dumps({"end_id": end_id, "files": manifest}).encode())
    out.commit()
    return manifest


def _finish(writer: Writer) -> pa.RecordBatch:
    writer.close()
    writer.out.commit()
    return pa.RecordBatch.from_arrays(
        [pa.array([writer.part], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(writer.index), writer.ids, writer.out.bytes))], names=["part", "documents", "tokens", "bytes"]
    )


def read(spark, folder: str) -> DataFrame:
    """Each document of a folder of token files: id, start, n_tokens, ids_crc32, file; frames are checked."""
    store = Files(folder)
    with store.read("manifest.json") as f:
        files = json.loads(f.read())["files"]

    def run(parts):
        for batch in parts:
            for k in batch.column(0).to_pylist():
                name, start, out = files[k]["name"], files[k]["first"], []
                with store.read(name) as f:
                    reader = Reader(f)
                    for entry in reader.index:
                        crc, n = 0, 0
                        for ids in reader.parts(entry):
                            crc, n = zlib.crc32(ids, crc), n + len(ids) // 4
                        out.append((None if entry[1] else entry[0], start, n, crc, name))
                        start += n
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(tidied(run), "id long, start long, n_tokens long, ids_crc32 long, file string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["id", "start", "n_tokens", "ids_crc32", "file"])


def round_trip(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = docs.sparkSession
    folder = Workspace(spark, "tokens").path("files")
    write(docs, path, end_id, folder, id_col, text_col)
    return read(spark, folder).withColumnRenamed("id", id_col)
