"""Successors where one id, or none, holds a large share of the rows."""

import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from boardlake.llm import order_minhash


@pytest.mark.parametrize("hot", [None, 7, 2**63 - 1, -(2**63)])
def test_every_row_is_once_the_next(spark, hot):
    r = random.Random(3)
    ids = [hot] * 400 + r.sample(range(100, 10_000), 300) + [50, 50, 51]
    r.shuffle(ids)
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    base = df.withColumn("ord", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    plan = order_minhash.with_next(base, ["text"], 16)
    out = {x.text: x.next_text for x in plan.collect()}
    for ranges in (1, 3):  # the same, however many ranges there are
        assert {x.text: x.next_text for x in order_minhash.with_next(base, ["text"], ranges).collect()} == out
    order = {t: -(2**63) if i is None else i for i, t in rows}
    assert len(out) == len(rows) and set(out.values()) == set(out)
    start = max(out, key=lambda t: order[t])
    seen, t = [], start
    for _ in rows:
        seen.append(order[t])
        t = out[t]
    falls = sum(a < b for a, b in zip(seen, seen[1:] + seen[:1], strict=True))
    assert t == start and falls == 1  # one cycle that only falls, but for its end


def test_the_hot_id_is_dealt_to_several_tasks(spark):
    df = spark.range(1000).select(F.lit(5).cast("long").alias("ord"), F.col("id").cast("string").alias("text"))
    out = order_minhash.with_next(df, ["text"], 16)
    assert out.count() == 1000 and out.filter("next_text is null").count() == 0
    assert out.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0] < 900


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "a")], "ord long, text string")
    assert order_minhash.with_next(df, ["text"]).first().next_text == "a" and order_minhash.with_next(df.limit(0), ["text"]).count() == 0


@pytest.mark.parametrize("ranges", [1, 8, 40])
def test_repeated_ids_and_copies_follow_by_hash(spark, ranges):
    """A brute-force order, with one id and one text of it that take most rows."""
    r = random.Random(7)
    rows = [(5, "hot")] * 60 + [(5, f"t{r.randrange(40)}") for _ in range(60)] + [(r.randrange(10), f"u{r.randrange(9)}") for _ in range(40)]
    r.shuffle(rows)
    signed = lambda t: (xxhash.xxh64_intdigest(t, seed=42) + (1 << 63)) % (1 << 64) - (1 << 63)
    order = sorted(rows, key=lambda x: (-x[0], signed(x[1])))
    want = Counter(zip(order, order[1:] + order[:1], strict=True))
    df = spark.createDataFrame(rows, "ord long, text string").repartition(5)
    got = Counter(((x.ord, x.text), (x.next_ord, x.next_text)) for x in order_minhash.with_next(df, ["ord", "text"], ranges).collect())
    # of copies that are dealt by row numbers each has a copy or what follows them next
    assert sum(got.values()) == len(rows) and set(got) == set(want)
    if ranges == 1:
        assert got == want
