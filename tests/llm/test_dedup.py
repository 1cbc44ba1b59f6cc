import random

import brute
import pytest
from pyspark.sql import functions as F

from pactum.llm import decontaminate, exact_dedup, jaccard

DOCS = "doc_id long, text string"
FIXTURE = "/root/testdata/sf0.001"


def near_copies(seed=3):
    """Documents with edits, exact copies, short, empty and null texts, one very long word and one very long text."""
    rnd = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    rows, base = [], [rnd.choice(words) for _ in range(120)]
    for i in range(80):
        copy = list(base)
        for _ in range(rnd.randrange(9)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        rows.append((i, " ".join(copy)))
    for i in range(80, 120):
        rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))))
    rows += [(200 + k, rows[3][1]) for k in range(20)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "Two words"), (304, "two WORDS"), (305, "x" * 2_500_000), (306, "x" * 2_500_000 + " y")]
    rows += [(307, " ".join(rnd.choice(words) for _ in range(300_000))), (308, "Ä ä É é"), (309, "Ä ä É é")]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, size, percent):
    rows = near_copies()
    got = jaccard.join(spark.createDataFrame(rows, DOCS), size=size, percent=percent).collect()
    assert sorted(map(tuple, got)) == brute.jaccard(rows, size, percent)


@pytest.mark.parametrize(("folder", "size", "percent"), [(FIXTURE, 4, 85), ("/root/testdata/sf0.01", 4, 85), ("/root/testdata/sf0.01", 5, 80)])
def test_jaccard_on_the_table(spark, folder, size, percent):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, jaccard.join(docs, size=size, percent=percent).collect())) == brute.jaccard(rows, size, percent)


def test_jaccard_dedup_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5, "q"), (2, "A b c d e f g", 6, None), (3, "z", 7, "r"), (4, None, 8, None)], "doc_id long, text string, n int, component_id string")
    out = jaccard.dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.join(none).count() == 0
    assert exact_dedup.groups(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], DOCS)
    assert decontaminate.digests(decontaminate.hits(some, items)).first().n_hit == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_equals_brute_force(spark, keep):
    rows = near_copies() + [(400 + k, "hot text") for k in range(400)]
    got = exact_dedup.groups(spark.createDataFrame(rows, DOCS), keep=keep).collect()
    assert sorted(map(tuple, got)) == brute.exact(rows, min if keep == "smallest" else max)


def test_exact_repeated_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", None), (None, "b", "z")], "doc_id long, text string, _text string")
    got = exact_dedup.groups(docs)
    assert sum(r.kept for r in got.collect()) == 2
    assert {r.group_size for r in got.where(F.col("doc_id") <= 2).collect()} == {3}


def test_exact_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{FIXTURE}/documents.parquet")
    plan = exact_dedup.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short Item"), (3, ""), (4, None), (5, "--- !!"), (6, "two three four five six seven eight nine ten eleven twelve"), (2, "short item")]


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_BYTES, 5000])
def test_decontamination_equals_brute_force(spark, bound):
    rows = [(1, "x ONE two,three four five six seven eight nine ten eleven twelve y"), (2, "a short--item here"), (3, None), (4, ""), (5, "one two three four five six seven eight nine"), (6, "ß" * 300_000 + " short item")]
    rows += [(7, "x " * 400_000 + "short item"), (8, "y" * 2_000_000 + " short item"), (1, "short item")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, items string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.digests(decontaminate.hits(docs, items, broadcast_bytes=bound))
    assert sorted(map(tuple, got.collect())) == brute.decontaminate(rows, ITEMS)


def test_decontamination_by_shuffle_on_the_table_and_on_odd_rows(spark):
    """The path for benchmarks too large to broadcast: whole table, repeated and null ids, columns of its own names."""
    docs, items = (spark.read.parquet(f"{FIXTURE}/{t}.parquet") for t in ("documents", "benchmark"))
    for make in (lambda **o: decontaminate.digests(decontaminate.hits(docs, items, **o)), lambda **o: decontaminate.clean(docs, items, **o)):
        assert sorted(map(str, make(broadcast_bytes=0).collect())) == sorted(map(str, make().collect()))
    odd = spark.createDataFrame([(None, "a short item", 1, "k"), (None, "a short item", 2, None), (3, None, 3, ""), (3, "short item", 4, "")], "doc_id long, text string, found int, _key string")
    few = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.clean(odd, few, broadcast_bytes=0)
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, decontaminate.clean(odd, few).collect())) and got.count() == 3
    assert decontaminate.clean(odd.limit(0), few, broadcast_bytes=0).count() == 0
    assert decontaminate.hits(odd, few.limit(0), broadcast_bytes=-1).where("n_hit > 0").count() == 0


def test_decontamination_on_the_table(spark):
    docs, items = (spark.read.parquet(f"{FIXTURE}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, decontaminate.digests(decontaminate.hits(docs, items)).collect()))
    assert got == brute.decontaminate([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(r[-1] for r in got)


def test_clean_removes_spans(spark):
    docs = spark.createDataFrame([(1, "Ä before, short item. after", "k"), (2, "short item", "k"), (3, None, None), (4, "none", "k")], "doc_id long, text string, spans string")
    out = {r.doc_id: r.text for r in decontaminate.clean(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert out == {1: "Ä before, . after", 3: None, 4: "none"}
