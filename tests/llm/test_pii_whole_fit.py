"""Personal data: the fit learns from every distinct text, and parts of a table give what the whole gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from boardlake.llm import boosting, pii


def same(a, b):
    for kind in pii.KINDS:
        assert len(a.trees[kind].trees) == len(b.trees[kind].trees) and a.trees[kind].base == b.trees[kind].base
        for s, t in zip(a.trees[kind].trees, b.trees[kind].trees, strict=True):
            assert all((u == v).all() for u, v in zip(s, t, strict=True))
    assert a.thresholds == b.thresholds


def test_the_fit_is_that_of_all_texts(spark, monkeypatch):
    """More texts than were once sampled: trees and thresholds are those of all their examples, learnt from in memory."""
    monkeypatch.setattr(pii, "ENOUGH", 1)
    monkeypatch.setattr(pii, "TREES", {"rounds": 6})
    docs = spark.range(0, 9_000, 1, 6).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("Ü𝒳 text of"), F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit("and so on "), 12)).alias("text"))
    copies = docs.union(docs.filter("doc_id % 3 = 0")).repartition(5)
    places = pii._places(docs.select("text", F.xxhash64("text").alias("h")), 1).collect()
    assert len(places) == 9_000
    rows = []
    for r in places:
        assert len(r.places) == 1 and all(p.at <= pii.AROUND and p.at <= len(p.text) <= p.at + pii.AROUND for p in r.places)
        rows += pii.examples_at([(p.text[: p.at], p.text[p.at :]) for p in r.places], random.Random(r.h), r.h % len(pii.KINDS))
    same(pii.fit(copies), pii.Model(rows))


def test_places_are_of_the_text(spark):
    texts = ["", "a", "é𝒳ü" * 100, "".join(chr(97 + i % 26) for i in range(119))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("h", F.xxhash64("text"))
    by = {r.h: r.text for r in docs.collect()}
    for r in pii._places(docs, 40).collect():
        text = by[r.h]
        around = {(text[max(0, i - pii.AROUND) : i], text[i : i + pii.AROUND]) for i in range(len(text) + 1)}
        assert len(r.places) == 40 and all((p.text[: p.at], p.text[p.at :]) in around for p in r.places)


def test_sums_of_parts_are_those_of_the_whole():
    r = np.random.default_rng(0)
    x = r.random((5000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    whole = boosting.BoostedTrees(rounds=10).fit(x, y)
    parts = boosting.BoostedTrees(rounds=10)
    order = r.permutation(5000)
    c = boosting.codes(x)
    assert parts.begin(5000, int(y.sum()), whole.edges)
    bins = parts.binned(c)
    boosting.boost({0: parts}, lambda trees: {0: sum(trees[0].sums(bins[:, p], y[p]) for p in np.array_split(order, 37))})
    assert (whole.probability(x) == parts.probability(x)).all()
    assert (np.floor(boosting.LEVELS * whole.probability(x)) == whole.levels(bins)).all()


def test_thresholds_of_counted_scores():
    r = np.random.default_rng(1)
    p, n = np.floor(r.random(300) * 40) / 40, r.integers(1, 9, 300)
    y = (r.random(300) < p).astype(int)
    for precision in (0.6, 0.8, 0.9):
        assert boosting.calibrated_threshold(p, y, precision, n=n) == boosting.calibrated_threshold(np.repeat(p, n), np.repeat(y, n), precision)
