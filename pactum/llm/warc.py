"""Deterministic sharded WARC writer and reader.

Records are range-partitioned by page id and sorted; each range is written to its own files, which roll at a
compressed size. Headers and digests are made anew from the payload. Each record is a gzip member of its own without
a time stamp, so equal input gives equal bytes. Files are written under a name of the attempt and moved when whole;
manifest.json, written last, lists them.

Of records with equal payloads of at least REVISIT_BYTES the one with the smallest id is a response and the others
are revisits that refer to it. Which records these are is found on (id, digest, size) rows alone: groups are counted
before the shuffle, and no payload moves but to its range.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.store import Files, Workspace

REVISIT_BYTES = 100
ROLL_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLAIN = re.compile(r"[^\x21-\x7e]")


def _record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}' + (f'/{repeat}' if repeat else ''))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, repeat: int = 0) -> bytes:
    """One record; repeat: how many with the same id and payload came before. The target is the url with other than printable ASCII percent-encoded; none is left out."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest, repeat)), ("WARC-Date", DATE)]
    if url:
        headers.append(("WARC-Target-URI", _PLAIN.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    headers += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest))]
        if refers_to is not None:
            headers.append(("X-Refers-To-Page", str(refers_to)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    headers += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(file, size: int = 1 << 20):
    """Yields the headers and block of each record of a file, one gzip member at a time."""
    rest = b""
    while True:
        rest = rest or file.read(size)
        if not rest:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = file.read(size)
                if not rest:
                    raise ValueError("a WARC file ends within a record")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines)
        block = tail[: int(headers["Content-Length"])]
        if version != "WARC/1.1" or len(tail) != len(block) + 4 or headers["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError("a WARC record is damaged")
        yield headers, block


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", files: int | None = None, roll_bytes: int = ROLL_BYTES) -> list[dict]:
    """Writes a record for every row to the folder, a URI that all executors reach; returns the manifest.

    Null html is an empty payload. Null ids come last and never are referred to while their group has an id; in a
    group without ids the first is the response. Repeated rows: the first of those with the smallest id is the response,
    and each has a record id of its own. An empty
    table gives a manifest without files. Other columns are not read.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    at = F.percentile_approx("id", F.array(*(F.lit(k / files) for k in range(1, files))), 10_000) if files > 1 else F.array()
    splits = sorted(set(rows.agg(at.alias("at")).first()["at"] or []))
    cuts = F.array(*(F.lit(s).cast("long") for s in splits)) if splits else F.array().cast("array<long>")
    part = F.when(F.col("id").isNull(), len(splits)).otherwise(F.size(F.filter(cuts, lambda s: s <= F.col("id"))))

    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("id", "digest")
    copies = work.cut(large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first"), "copies")
    marks = large.join(copies, "digest").select("id", "digest", F.lit(0).alias("kind"), "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    both = rows.select("id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload").unionByName(marks.distinct())
    placed = both.withColumn("part", part.cast("int")).repartitionById(len(splits) + 1, F.col("part"))
    placed = placed.sortWithinPartitions("part", F.col("id").asc_nulls_last(), "digest", "kind", "url")
    store = Files(folder)

    def save(parts):
        out, mark, used, seq = None, None, False, 0
        now, last, repeat = None, None, 0
        for batch in parts:
            for doc_id, digest, kind, first, url, payload, at in zip(*(batch.column(k) for k in range(7))):
                doc_id, digest, kind, at = doc_id.as_py(), digest.as_py(), kind.as_py(), at.as_py()
                if kind == 0:
                    mark, used = (doc_id, digest, first.as_py()), False
                    continue
                if now != at or (out is not None and out.bytes >= roll_bytes):
                    if out is not None:
                        yield _finish(out)
                    seq = 0 if now != at else seq + 1
                    now, out = at, store.write(f"pages-{at:06d}-{seq:05d}.warc.gz")
                    out.records = 0
                repeat, last = repeat + 1 if last == (doc_id, digest) else 0, (doc_id, digest)
                copy = mark is not None and mark[:2] == (doc_id, digest)
                revisit = copy and (used or (mark[2] is not None and doc_id != mark[2]))
                used = used or copy
                out.write(gzip.compress(record(doc_id, url.as_py(), payload.as_py(), mark[2] if revisit else None, revisit, repeat), 6, mtime=0))
                out.records += 1
        if out is not None:
            yield _finish(out)

    done = sorted(map(tuple, placed.mapInArrow(save, "name string, records long, bytes long").collect()))
    manifest = [dict(zip(("name", "records", "bytes"), d)) for d in done]
    out = store.write("manifest.json")
    out.write(json.dumps({"files": manifest}).encode())
    out.commit()
    return manifest


def _finish(out) -> pa.RecordBatch:
    out.commit()
    return pa.RecordBatch.from_arrays([pa.array([out.name]), pa.array([out.records], pa.int64()), pa.array([out.bytes], pa.int64())], names=["name", "records", "bytes"])


def read(spark, folder: str) -> DataFrame:
    """Every record of the folder: id, payload_bytes, payload_digest, record_type, refers_to, url. Digests are checked."""
    store = Files(folder)
    with store.read("manifest.json") as f:
        files = json.loads(f.read())["files"]

    def whole(headers, block):
        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
        payload = block.partition(b"\r\n\r\n")[2]
        if headers["WARC-Type"] == "response":
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError("a payload differs from its digest")
            size = len(payload)
        number = lambda name: int(headers[name]) if name in headers else None
        return number("X-Page-Id"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page"), headers.get("WARC-Target-URI")

    def run(parts):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for batch in parts:
            for k in batch.column(0).to_pylist():
                with store.read(files[k]["name"]) as f:
                    rows = []
                    for headers, block in records(f):
                        rows.append(whole(headers, block))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(run, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    spark = pages.sparkSession
    folder = Workspace(spark, "archive").path("files")
    write(pages, folder, id_col, url_col, html_col)
    return read(spark, folder).withColumnRenamed("id", id_col)
