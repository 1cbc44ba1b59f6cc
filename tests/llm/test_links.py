import random

import brute
import pytest
from test_dedup import DOCS, FIXTURE, near_copies

from pactum.llm import jaccard, queries


def links(rows, size, percent):
    """rows: (id, text) -> sorted (id, n, class, number of links, component), by comparing all pairs."""
    sets = [(i, brute.shingles(t, size)) for i, t in rows]
    by = {}
    for i, s in sets:
        by.setdefault(s, []).append(i)
    count = dict.fromkeys(by, 0)
    for x in by:
        if x:
            for y in by:
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(x & y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        count[x] += len(by[y])
    component = {i: c for i, _, c in brute.jaccard(rows, size, percent)}
    return sorted((i, len(s), min(by[s]) if s else i, count[s] - 1 if s else 0, component[i]) for i, s in sets)


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 512), (5, 80, 512), (5, 80, 7)])
def test_links_equal_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    rows = near_copies()
    got = sorted(map(tuple, jaccard.linked(spark.createDataFrame(rows, DOCS), size=size, percent=percent).collect()))
    assert got == links(rows, size, percent)


def test_op2_lists_links_inside_a_component(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    got = sorted(map(tuple, queries.op2_ngram_jaccard_join(spark, FIXTURE).collect()))
    assert got == links([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    assert any(links for _, _, _, links, _ in got)


def test_links_of_empty_and_unlinked_tables(spark):
    assert jaccard.linked(spark.createDataFrame([], DOCS)).count() == 0
    got = jaccard.linked(spark.createDataFrame([(1, "a b"), (2, None), (3, "a c")], DOCS)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 0, 1), (2, 0, 2, 0, 2), (3, 1, 3, 0, 3)]


def thue_morse(n, a, b):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


def test_patterned_words_do_not_link(spark):
    rows = [(1, thue_morse(1024, "a", "b")), (2, thue_morse(1024, "b", "a")), (3, "abababab babababa"), (4, "babababa abababab")]
    got = jaccard.join(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {1, 2, 3, 4}


def test_repeated_null_and_text_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("b", text), ("b", text + " x"), (None, text + " y"), ("a", "alone"), ("b", "alone too")], "doc_id string, text string")
    got = sorted(map(tuple, jaccard.linked(docs).collect()), key=str)
    assert got == sorted([("b", 56, "b", 2, "b"), ("b", 57, "b", 2, "b"), (None, 57, None, 2, "b"), ("a", 1, "a", 0, "a"), ("b", 1, "b", 0, "b")], key=str)


def test_frequent_shingles_and_many_batches(spark, monkeypatch):
    """Small batches and a low bar, so that batches, ranges and frequent shingles all take part."""
    rows = near_copies()
    wanted = links(rows, 5, 80)
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(jaccard, "LEAST", 1)
    monkeypatch.setattr(jaccard, "BATCH_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 3)
    monkeypatch.setattr(jaccard, "FOLLOWERS", 5)
    assert sorted(map(tuple, jaccard.linked(docs).collect())) == wanted


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_near_copies_beside_frequent_shingles(spark, monkeypatch, share):
    """Documents that share a long common passage, of which some are near copies in their own words: frequent shingles are
    in every set, and in the prefix of some."""
    monkeypatch.setattr(jaccard, "LEAST", 1)
    rnd = random.Random(2)
    word = lambda: "w%d" % rnd.randrange(3000)
    common, rows = " ".join(word() for _ in range(60)), []
    for k in range(60):
        own = [word() for _ in range(int(60 * (1 - share) / share))]
        for j in range(3):
            copy = list(own)
            for _ in range(j):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((10 * k + j, common + " " + " ".join(copy)))
    docs = spark.createDataFrame(rows, DOCS)
    for size, percent in ((4, 85), (5, 80)):
        assert sorted(map(tuple, jaccard.linked(docs, size=size, percent=percent).collect())) == links(rows, size, percent)


def test_more_edges_than_one_task_takes(spark, monkeypatch):
    from pactum.llm import components
    from pactum.llm.store import Workspace

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(149, 7)]
    monkeypatch.setattr(components, "SMALL", 10)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), len(edges), Workspace(spark, "test")).collect()
    assert {r.id: r.component for r in got} == {k: 0 for k in [*range(1, 41), *range(100, 150)]}
