"""Components where one bucket holds most fingerprints, cut by a second family of masks."""

import random

import pytest

from boardlake.llm import simhash


def test_every_family_covers_the_radius():
    r = random.Random(2)
    for family in (0, 1):
        ms = simhash.masks(family=family)
        assert len(set(ms)) == 31
        for _ in range(2000):
            bits = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not m & bits & (2**64 - 1) for m in ms)


@pytest.mark.parametrize("deep", [1, 10**6])
def test_a_hot_bucket_gives_the_same_components(spark, deep):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << x for x in r.sample(range(20), r.randint(0, 9))) for b in base for _ in range(90)} | {r.getrandbits(64) for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    linked = {f: f for f in signed}
    links = [(x.a, x.b) for x in simhash.links(df, block=8, deep=deep).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in links)

    def top(x):
        while linked[x] != x:
            x = linked[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        linked[max(x, y)] = min(x, y)
    assert {f: top(f) for f in signed} == {f: find(f) for f in signed}
