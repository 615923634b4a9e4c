"""Ranks of groups that lie over many ranges, and names compared in blocks, against plain versions."""

import random

from boardlake.functions.ranks import stable_ranks
from boardlake.functions.vectorized import name_score, scored_pairs, similar_names, similar_players


def plain(rows):
    out = {}
    for board in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == board), key=lambda r: (-r[1], r[2] is None, r[2] or 0, r[3], r[4]))
        tie, before = 1, None
        for i, r in enumerate(own, 1):
            if before and (before[1] != r[1] or (before[2] is not None and before[2] != r[2])):
                tie += 1
            out[r[4]] = (i, 1 + sum(x[1] > r[1] for x in own), tie)
            before = r
    return out


def test_ranks_over_many_ranges(spark):
    r = random.Random(4)
    rows = [("hot", r.choice([5, 5, 5, 7, 9]), r.choice([None, 1, 1, 2]), f"n{r.randint(0, 3)}", i) for i in range(600)]
    rows += [("cold", r.randint(0, 3), None, "x", 1000 + i) for i in range(20)] + [("one", 1, 1, "y", 2000)]
    df = spark.createDataFrame(rows, "type string, value long, source_rank int, name string, id long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {x.id: (x.stable_index, x.display_rank, x.tie_group) for x in stable_ranks(df, ["type"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == plain(rows)
    assert stable_ranks(df.limit(0), ["type"]).count() == 0


def names(r, n):
    return list({"".join(r.choice("abcde é日"[: r.choice([4, 8])]) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13]))) for _ in range(n)}) + ["x" * 70 + "ab", "ab" * 40]


def test_scores_of_pairs(spark):
    r = random.Random(2)
    for least in (0.3, 0.72, 0.93):
        q, k = names(r, 60), names(r, 60)
        want = sorted((i, j, name_score(a, b)) for i, a in enumerate(q) for j, b in enumerate(k) if name_score(a, b) >= least)
        assert sorted((int(i), int(j), float(s)) for part in scored_pairs(q, k, least) for i, j, s in zip(*part, strict=True)) == want


def test_similar_names_in_blocks(spark):
    r = random.Random(3)
    q, k = names(r, 50), names(r, 50)
    queries = spark.createDataFrame([(x,) for x in q], "query string")
    players = spark.createDataFrame(list(enumerate(k)), "player long, key string")
    want = sorted((a, i, name_score(a, b)) for a in q for i, b in enumerate(k) if a and b and name_score(a, b) >= 0.72)
    assert sorted((x.query, x.player, x.score) for x in similar_names(queries, players, block=9).collect()) == want


def test_the_better_of_key_and_shown_name(spark):
    queries = spark.createDataFrame([("q1", "abcdef", "zzzzzz"), ("q2", "kkkkkk", "iron lord")], "query string, key string, shown string")
    players = spark.createDataFrame([(1, "abcdeg", "qqqq"), (2, "mmmm", "iron lorf")], "player long, key string, shown string")
    got = {(x.query, x.player): x.score for x in similar_players(queries, players).collect()}
    assert got == {("q1", 1): name_score("abcdef", "abcdeg"), ("q2", 2): name_score("iron lord", "iron lorf")}
