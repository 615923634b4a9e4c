"""R4 against all pairs, and that most cells are never opened where vectors come in clusters."""

import tracemalloc

import numpy as np

from boardlake.functions import vectorized

DOCS, QUERIES = "doc_id bigint, vector array<double>", "query_id bigint, vector array<double>"


def frames(spark, docs, queries):
    rows = lambda x: [(i, v.tolist() if v is not None else None) for i, v in x]
    return spark.createDataFrame(rows(queries), QUERIES), spark.createDataFrame(rows(docs), DOCS).repartition(5)


def plain(docs, queries, k):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    out = {}
    for q, v in queries:
        if v is not None:
            scored = sorted((-round(float(unit(v) @ unit(d)), 9), i) for i, d in docs if d is not None)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(spark, docs, queries, k, **kw):
    out = {}
    for r in sorted(vectorized.cosine_top_k(*frames(spark, docs, queries), k, **kw).collect(), key=lambda r: (r.query_id, r.place)):
        out.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    return out


def clustered(n, seed, size=16, kinds=12):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(kinds, size))
    return [(i, middles[i % kinds] + 0.05 * r.normal(size=size)) for i in range(n)]


def test_equals_all_pairs(spark):
    r = np.random.default_rng(1)
    spread = [(i, r.normal(size=8)) for i in range(400)]
    odd = [(1000, np.zeros(8)), (1001, np.zeros(8)), (1002, None), (1003, spread[0][1] * 3), (1004, spread[0][1])]
    queries = [(1, spread[0][1]), (2, np.zeros(8)), (3, None), (4, r.normal(size=8)), (5, -spread[0][1])]
    for kw in ({}, {"block": 20, "most_cells": 16}, {"block": 7, "most_cells": 3}):
        for k in (1, 12):
            assert found(spark, spread + odd, queries, k, **kw) == plain(spread + odd, queries, k)
    few = spread[:3] + odd
    assert found(spark, few, queries, 10, block=1) == plain(few, queries, 10)


def test_most_cells_stay_closed(spark):
    docs, queries = clustered(600, 2), clustered(24, 2)
    q, d = frames(spark, docs, queries)
    placed, pairs, sizes = vectorized.opened_cells(q, d, 20, 40, 5)
    assert len(sizes) > 20 and sum(sizes.values()) == 600 and placed.count() == 600
    assert pairs.count() < 0.3 * len(sizes) * len(queries)
    assert found(spark, docs, queries, 5, block=20, most_cells=40) == plain(docs, queries, 5)


def test_empty(spark):
    assert found(spark, [], [(1, np.ones(3))], 3) == {} and found(spark, [(1, np.ones(3))], [], 3) == {}
    assert found(spark, [(1, np.zeros(3))], [(1, np.ones(3))], 3) == {1: [(1, 0.0)]}


def test_memory_of_a_block_is_bounded():
    r = np.random.default_rng(3)
    a, b = (vectorized._unit(r.normal(size=(1500, 16))) for _ in range(2))
    ids, ones = np.arange(250, dtype=np.int32), np.ones(250)
    tracemalloc.start()
    held = 0
    for part in vectorized.opened_by(np.tile(a, (4, 1)), b[:250], ids, ones * 9, ones * 2, 5, True):
        held = max(held, len(part[0]))
    found = [np.concatenate(x) for x in zip(*vectorized.nearest(a, b, np.arange(1500), 5))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sims = np.round(a @ b.T, 12)
    assert held < 300_000 and peak < 30_000_000  # of 1.5 million pairs, and of 18 MB for each table of products
    assert (found[0] == np.argsort(-sims, axis=1, kind="stable")[:, :5]).all() and (found[1] == -np.sort(-sims, axis=1)[:, :5]).all()
