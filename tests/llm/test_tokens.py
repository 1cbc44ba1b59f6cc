import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pactum.llm import bpe, token_counts, token_files, units
from pactum.llm.store import Files

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(5)
    odd = ["", " ", "  a", "a  b", "a \n b", "a\n b", "a\n\n  b\n", "it's  we'll\t'd", "x ", "  y", "a\x1c b \x1cc", "  z", "é😀 日本語 ١٢", "<|endoftext|> a", "a" * 3000, "ab" * 5000, "!" * 999, "don't, won't; x'very. a-b'S!? we'll-'t", "a.!b 's,'t", " " * 500 + "x", "0123456789" * 300]
    odd += ["".join(rnd.choice("ab '\n\t., é1sS\x1f　") for _ in range(rnd.randrange(60))) for _ in range(400)]
    return odd


def split(codec, column):
    """The ids of each text of a column."""
    ids, ends = codec.encoder.ids(column)
    return [x.tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []


def test_pieces_begin_at_texts_and_before_words():
    column = pa.array(["x  ab c", None, "", " d", "e\u00a0 \u00a0f", "日 本", "it's, a-b.!"])
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)
    at = units.cuts(np.frombuffer(data, np.uint8), offsets[: len(column) + 1])
    whole = data.to_pybytes()
    assert [whole[a:b].decode() for a, b in zip(at, at[1:])] == ["x ", " ab", " c", " d", "e\u00a0 \u00a0f", "日", " 本", "it's", ",", " a", "-b", ".!"]


def test_merge_equals_library(reference):
    codec = bpe.Ranks(RANKS, P.PATTERN)
    column = pa.array([*texts(), None, *texts()])[1:]
    ids, ends = codec.encoder.ids(column)
    for t, got in zip(column.to_pylist(), split(codec, column)):
        assert got == reference.encode_ordinary(t or ""), t
    assert codec.decode(ids, ends).to_pylist() == [(t or "").encode() for t in column.to_pylist()]
    assert not any(codec.lower)


def test_very_long_pre_token(reference):
    codec, rnd = bpe.Ranks(RANKS, P.PATTERN), random.Random(1)
    word = "".join(rnd.choice("abcdefgh") for _ in range(200_000))
    assert codec.merge(word.encode()) == reference.encode_ordinary(word)


def test_a_merge_may_make_a_pair_of_a_lower_rank(tmp_path):
    # "bc" has rank 300, what it makes with its neighbours has lower ranks.
    table = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 270, b"abcd": 260, b"cb": 290, b"cbc": 310, b"aa": 280, b"bcbc": 265}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in table.items()))
    codec = bpe.Ranks(str(tmp_path / "ranks"), r"\w+|\W+")
    library = tiktoken.Encoding("lower", pat_str=r"\w+|\W+", mergeable_ranks=table, special_tokens={}, explicit_n_vocab=None)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 30))) for _ in range(500)] + ["bc" * 40, "abcd" * 30]
    for w, ids in zip(words, codec.encode_pieces([w.encode() for w in words])):
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode_ordinary(w) == codec.merge(w.encode()), w
    assert not any(codec.lower)


def test_ids_do_not_depend_on_what_a_worker_keeps(monkeypatch):
    want = split(bpe.Ranks(RANKS, P.PATTERN), pa.array(texts()))
    for name, value in (("KEPT", 5), ("PIECES", 5), ("BATCH", 7)):
        monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr(units, "HELD", 50)
    for codec in (bpe.Ranks(RANKS, P.PATTERN), bpe.Ranks(RANKS, P.PATTERN, kept=3), bpe.Ranks(RANKS, P.PATTERN, kept=0)):
        assert [split(codec, pa.array([t]))[0] for t in texts()] == want


def rows():
    out = [(k, t, "c") for k, t in enumerate(texts())] + [(1000, None, None), (1000, "again", "c"), (1001, "long text, " * 200_000, "c")]
    random.Random(2).shuffle(out)
    return out


def test_encode_decode_query(spark, reference):
    got = bpe.digests(bpe.encode_decode(spark.createDataFrame(rows(), DOCS), RANKS, P.PATTERN)).collect()
    want = []
    for i, t, _ in rows():
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), RANKS, P.PATTERN).count() == 0


def brute_files(rows):
    tokenizer, out = Tokenizer.from_file(JSON), {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_token_files(spark, tmp_path):
    docs = [r for r in rows() if r[0] != 1000] + [(1000, None, "c"), (-5, "first", "c")]
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write(spark.createDataFrame(docs, DOCS), JSON, 2, folder, files=3)
    got = token_files.read(spark, folder).collect()
    want, start = brute_files([r[:2] for r in docs]), 0
    assert len(manifest) > 1 and len(got) == len(docs)
    for r in sorted(got, key=lambda r: r.id):
        assert (r.n_tokens, r.ids_crc32) == want[r.id][0] and r.start == start
        start += r.n_tokens
    whole, name = 1001, next(r.file for r in got if r.id == 1001)
    with Files(folder).read(name) as f:
        ids = token_files.Reader(f).read(whole)
    assert ids[-1] == 2 and len(ids) == want[whole][0][0]
    damaged = bytearray((tmp_path / "tokens" / name).read_bytes())
    damaged[6] ^= 255
    (tmp_path / "tokens" / name).write_bytes(damaged)
    with Files(folder).read(name) as f, pytest.raises(Exception):
        reader = token_files.Reader(f)
        for entry in reader.index:
            list(reader.parts(entry))


def test_token_files_edges(spark):
    none = token_files.round_trip(spark.createDataFrame([], DOCS), JSON, 2)
    assert none.count() == 0
    got = token_files.round_trip(spark.createDataFrame([(None, "a", "x"), (7, "b c", "x"), (7, "b c", "x")], DOCS), JSON, 2).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(got, key=lambda r: r.start)] == [(None, 2), (7, 3), (7, 3)]


def test_token_counts(spark, reference):
    lengths = [len(reference.encode_ordinary(t or "")) for _, t, _ in rows()]
    counted = token_counts.lengths(spark.createDataFrame(rows(), DOCS), RANKS, P.PATTERN)
    assert sorted(r.n_tokens for r in counted.collect()) == sorted(lengths)
    hist = token_counts.histogram(counted).cache()
    for r in hist.collect():
        assert r.docs == lengths.count(r.limit) and r.docs_longer == sum(n > r.limit for n in lengths)
        assert r.tokens == sum(n for n in lengths if n <= r.limit) and r.tokens_kept == sum(min(n, r.limit) for n in lengths)
    for limit in (0, 7, 1500, 10**9):
        assert token_counts.truncated(hist, limit) == sum(min(n, limit) for n in lengths)
    assert token_counts.quantile(hist, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    empty = token_counts.histogram(token_counts.lengths(spark.createDataFrame([], DOCS), RANKS, P.PATTERN))
    assert empty.count() == 0 and token_counts.quantile(empty, 0.5) is None and token_counts.truncated(empty, 5) == 0


def test_counts_beside_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, None, None)], "doc_id long, text string, n_tokens long, docs string")
    counted = token_counts.lengths(docs, RANKS, P.PATTERN)
    assert sorted(map(tuple, counted.collect())) == [(1, 2), (2, 0)]
    assert sorted(map(tuple, token_counts.histogram(counted).collect())) == [(0, 1, 1, 0, 0), (2, 1, 0, 2, 2)]
