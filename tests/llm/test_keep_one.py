"""Near duplicates: one row of each component, whatever ids repeat or lack."""

import random

from boardlake.llm import simhash


def text(seed, n=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def test_distinct_texts_of_one_id_all_stay(spark):
    rows = [(1, text(i)) for i in range(30)] + [(1, text(0)), (2, text(3)), (3, text(99)), (0, text(99))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect())
    assert out == sorted([(1, text(i)) for i in range(30)] + [(0, text(99))])


def test_copies_without_an_id_go(spark):
    rows = [(None, text(1))] * 3 + [(None, text(2)), (5, text(3)), (4, text(3)), (None, text(3)), (None, text(3))]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, text(1)), (0, text(2)), (4, text(3))])
