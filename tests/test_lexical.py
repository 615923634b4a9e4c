"""R5 against all pairs."""

import random

import numpy as np

from boardlake.operators import retrieval


def result(spark, queries, docs, k):
    q = spark.createDataFrame(queries, "query_id bigint, query string")
    d = spark.createDataFrame(docs, "doc_id bigint, content string, updated_at bigint").repartition(4)
    return sorted((r.query_id, r.doc_id, r.place) for r in retrieval.lexical_search(q, d, k).collect())


def plain(queries, docs, k):
    out = []
    for i, q in queries:
        hits = sorted((-u, d) for d, t, u in docs if q and t is not None and q.lower() in t.lower())
        out += [(i, d, n + 1) for n, (_, d) in enumerate(hits[:k])]
    return sorted(out)


def test_equals_all_pairs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcé日") for _ in range(r.randint(1, 4)))
    docs = [(i, r.choice([None, ""]) if i % 20 == 0 else " ".join(word() for _ in range(r.randint(1, 30))).upper(), r.randint(0, 9)) for i in range(150)]
    queries = [(i, " ".join(word() for _ in range(r.randint(1, 2)))) for i in range(60)] + [(60, "a"), (61, "é"), (62, ""), (63, None), (64, "日b"), (65, "%_"), (66, "ab"), (67, "q" * 50)]
    for k in (3, 1000):
        assert result(spark, queries, docs, k) == plain(queries, docs, k)


def test_empty(spark):
    assert result(spark, [], [(1, "a", 1)], 5) == [] and result(spark, [(1, "a")], [], 5) == []


def test_no_nested_loop(spark):
    q = spark.createDataFrame([(1, "abc")], "query_id bigint, query string")
    d = spark.createDataFrame([(1, "xabcx", 1)], "doc_id bigint, content string, updated_at bigint")
    plan = retrieval.lexical_search(q, d, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_known_grams():
    """Those of a text among a set, of each size, once."""
    rng = np.random.default_rng(1)
    bits = rng.random(1 << 24) < 0.5
    for text in ("", "a", "ab", "abcabc", "é\ud800x", "abcd" * 500):
        every = np.concatenate([retrieval._grams(text, size) for size in (1, 2, 3)])
        assert retrieval._known_grams(text, bits).tolist() == sorted(every[bits[every]].tolist())
