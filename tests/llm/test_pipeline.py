import base64
import hashlib

import brute
import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from pactum.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    """Exact dedup and BPE against plain versions on what each stage was given; the other stages keep rows they got."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs.collect()
        schema = docs.schema
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema if name != "byte_level_bpe" else None)
        if name != "byte_level_bpe":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in seen[name]}
    first = {}
    for r in sorted(seen["exact_dedup"], key=lambda r: r.doc_id):
        first.setdefault(r.text or "", r.doc_id)
    assert sorted(first.values()) == sorted(r.doc_id for r in seen["ngram_jaccard_join"])
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in seen["byte_level_bpe"]:
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, docs.collect())) == sorted(want) and want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)


EDGES = [(1, None, "x", 1), (1, "", "y", 2), (2, "", None, 3), (None, "a b c d e f g h i j k", "z", 4), (None, "a b c d e f g h i j k", "z", 4), (3, "A b c d e f g h i j k", "q", 5), (3, "unique words of its own", "q", 6), (4, "one two three four five six seven eight nine ten tail", "q", 7), (5, "short item", "q", 8), (6, "x" * 300_000, "q", 9)]
ODD = "doc_id long, text string, n_hit string, found int"
ITEMS = [("7", "one two three four five six seven eight nine ten eleven"), ("8", "Short, item")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_each_stage_on_an_empty_table_and_on_edges(spark, folder, name, stage):
    none = stage(spark, spark.createDataFrame([], ODD), folder)
    assert none.count() == 0
    docs = spark.createDataFrame(EDGES, ODD)
    out = stage(spark, docs, folder)
    if name != "byte_level_bpe":
        assert out.schema.names == docs.schema.names
    got = [tuple(r) for r in out.collect()]
    if name == "exact_dedup":
        first = {}
        for r in sorted(EDGES, key=lambda r: (r[0] is None, r[0] or 0, r[3])):
            first.setdefault(r[1] or "", r[0])
        assert sorted((r[1] or "", str(r[0])) for r in got) == sorted((t, str(i)) for t, i in first.items())
    if name == "ngram_jaccard_join":
        # The empty rows are linked with nothing; of the three near copies that with an id stays.
        assert len(got) == len(EDGES) - 2 and (3, "A b c d e f g h i j k", "q", 5) in got
    if name == "benchmark_decontamination":
        want = [(r[0], t, r[2], r[3]) for r in EDGES if (t := brute.clean(r[1], ITEMS)) is not None or r[1] is None]
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) == len(EDGES) - 1
    if name == "byte_level_bpe":
        assert len(got) == len(EDGES) and sorted((r[0] or 0, r[1]) for r in got if r[1] == 0) == [(1, 0), (1, 0), (2, 0)]
    if name == "quality_classifier":
        assert len(got) <= len(EDGES)


def test_near_copies_and_benchmark_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, c in brute.jaccard(rows, 5, 80) if i == c)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {i for i, _, n, *_ in brute.decontaminate(rows, items) if n}
    some = {i: brute.clean(t, items) for i, t in rows if i in sorted(hit)[:6] or i % 40 == 0}
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, SF).collect()}
    text = dict(rows)
    assert all(got.get(i) == t for i, t in some.items()) and all(got[i] == text[i] for i in text if i not in hit) and hit


def test_quality_stage_keeps_what_a_plain_version_accepts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, SF).collect()}
    for r in docs.where("n_chars < 3000").limit(60).collect():
        score = brute.attention(model, brute.passages(r.text))
        assert abs(score - 0.5) < 1e-4 or (r.doc_id in got) == (score >= 0.5)
