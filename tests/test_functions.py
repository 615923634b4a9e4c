"""Literal cases of the functions and operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boardlake.functions import alliances, text, vectorized, weeks
from boardlake.operators import activity, dedupe, guards, observations, ranking, retrieval, scores
from boardlake.sources import sinks


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()])).first()[0]


def test_names_of_boards_and_metrics(spark):
    assert one(spark, text.board_type, a="INDIVIDUAL POWER RANKINGS") == "individual_power"
    assert one(spark, text.board_type, a="") == "unknown"
    assert one(spark, text.metric_key, a="KP") == "kill_points"
    bad = one(spark, text.board_check, a="Kill Points", b="power")
    assert not bad.ok and bad.expected == "kill_points" and "requires" in bad.reason


@pytest.mark.parametrize("raw, digits", [("2O,1I8,S34", "20118534"), ("B6,9Z0", "86920"), ("", "")])
def test_repaired_digits(spark, raw, digits):
    assert one(spark, text.repaired_digits, a=raw) == digits


def test_grouping(spark):
    assert not one(spark, text.metric_evidence, a="54'26 8607").grouping_ok
    assert one(spark, text.metric_evidence, a="1,234,567").grouping_ok


@pytest.mark.parametrize("name, key", [("[GODt] Gd Hama", "godtgdhama"), ("Игрок №1", "игрок1"), ("Łukasz", "lukasz"), ("", ""), (None, "")])
def test_alias_keys(name, key):
    assert vectorized.alias_key(name) == key


def test_name_scores():
    assert vectorized.name_score("smokealph", "smokealpha") >= 0.95
    assert vectorized.name_score("abcd", "axyz") == pytest.approx(0.55)
    assert vectorized.name_score("", "x") == 0
    for a, b in [("smoke", "msoke"), ("ring", "bring"), ("aabb", "bbaa")]:
        from collections import Counter

        assert vectorized.score_bound(a, Counter(a), b) >= vectorized.name_score(a, b)


def test_similar_names_against_brute_force(spark):
    names = ["smokealpha", "smokealphx", "thunderking", "omegalegend", "knightone", "łukasz", "a"]
    queries = ["smokealph", "knightoen", "omega", "zzz", ""]
    players = spark.createDataFrame(list(enumerate(names)), "player bigint, key string")
    got = {(r.query, r.player): r.score for r in vectorized.similar_names(spark.createDataFrame([(q,) for q in queries], "query string"), players).collect()}
    want = {(q, i): s for q in queries for i, n in enumerate(names) if (s := vectorized.name_score(q, n)) >= 0.72}
    assert got == want


def test_weeks(spark):
    ts = datetime(2026, 4, 13, 0, 30)
    for offset, key in (("+00:00", "2026-W16"), ("+03:00", "2026-W16"), ("-05:00", "2026-W15")):
        assert one(spark, lambda t, o: weeks.week_identity(t, weeks.offset_minutes(o))["key"], t=ts, o=offset) == key
    assert one(spark, weeks.offset_minutes, o="+15:00") is None and one(spark, weeks.offset_minutes, o="+3:00") is None
    r = one(spark, lambda k: weeks.week_range(k, F.lit(0)), k="2026-W15")
    assert (r.starts_at, r.ends_at) == (datetime(2026, 4, 6), datetime(2026, 4, 13))
    for bad in ("2026-15", "abc", "2026-W77"):
        assert one(spark, lambda k: weeks.week_range(k, F.lit(0)), k=bad) is None


def test_alliance_names(spark):
    d = one(spark, lambda n: alliances.detected(n), n="[V 57] : Monkey D Luffy")
    assert d.label == "[V57] Legacy of Velmora"
    assert one(spark, alliances.stripped, n="[V 57] : Monkey D Luffy") == "Monkey D Luffy"
    assert one(spark, lambda n: alliances.detected(n), n="Nobody").label is None


def test_stable_ranking(spark):
    rows = [("c", 100, 2, "beta"), ("a", 120, 3, "gamma"), ("b", 120, 1, "alpha"), ("d", 120, 1, "alpha")]
    df = spark.createDataFrame([(1, *r) for r in rows], "g int, id string, value bigint, source_rank int, name string")
    out = ranking.stable_ranking(df, ["g"]).orderBy("stable_index").collect()
    assert [r.id for r in out] == ["b", "d", "a", "c"]
    df = spark.createDataFrame([(1, "x", 100, 1, "a"), (1, "y", 100, 2, "b"), (1, "z", 90, 1, "c")], "g int, id string, value bigint, source_rank int, name string")
    out = ranking.stable_ranking(df, ["g"]).orderBy("stable_index").collect()
    assert [r.display_rank for r in out] == [1, 1, 3] and [r.tie_group for r in out] == [1, 2, 3]


def test_observation_precedence(spark):
    at = [datetime(2026, 1, 1), datetime(2026, 1, 2)]
    df = spark.createDataFrame([("w", 1, "m", 50, at[1], "a"), ("w", 1, "m", 99, at[0], "b"), ("w", 1, "m", 50, at[1], "c")], "period string, player int, metric string, value bigint, observed_at timestamp, ref string")
    assert [(r.value, r.ref) for r in observations.current(df).collect()] == [(50, "c")]


def test_compliance(spark):
    for statuses, want in ((["PASS", "FAIL"], "FAIL"), (["PASS", "NO_STANDARD"], "PARTIAL"), (["PASS", "PASS"], "PASS"), (["NO_BASELINE", "NO_STANDARD"], "NO_STANDARD")):
        assert spark.range(1).select(activity.overall_status(F.array(*[F.lit(s) for s in statuses]))).first()[0] == want


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, 100_000_000, 5_000_000, 5_000_000, 1_000_000, -3_000_000)], "g int, player int, start_power bigint, t4 bigint, t5 bigint, deads bigint, power_delta bigint")
    r = scores.contribution_scores(df, ["g"]).first()
    assert r.expected == 40_000_000 and r.actual == 20_000_000 and r.score == 50.0 and r.tier == "Frontline Fighter"


def test_snapshot_anomalies(spark):
    df = spark.createDataFrame([(1, "w", 10, 5, 9, 7, 50)], "player int, at string, power bigint, kp bigint, t4 bigint, t5 bigint, deads bigint")
    assert {r.code for r in scores.snapshot_anomalies(df).collect()} == {"KILLS_EXCEED_KP", "DEADS_GT_POWER"}


def test_uniformity(spark):
    df = spark.createDataFrame([(1, v) for v in (7, 7, 7, 7, 1)], "run int, value bigint")
    assert guards.uniformity(df).first().suspicious


def test_near_duplicate_runs_are_bounded(spark):
    runs = spark.createDataFrame([(i, "b", i) for i in range(12)], "run int, board string, created_at int")
    items = spark.createDataFrame([(i, w) for i in range(12) for w in ("x", "y")], "run int, item string")
    got = {r.run: r.other for r in dedupe.near_duplicates(items, runs).collect()}
    assert got == {i: i - 1 for i in range(1, 12)}


def test_upsert_and_log(spark):
    a = spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "k int, v int, t int")
    b = spark.createDataFrame([(1, 9, 1), (3, 7, 0)], "k int, v int, t int")
    new = sinks.upserted(a, b, ["k"], ["t"])
    assert sorted(map(tuple, new.collect())) == [(1, 9, 1), (2, 6, 1), (3, 7, 0)]
    assert {(r.k, r.action) for r in sinks.change_log(a, new, ["k"]).collect()} == {(1, "updated"), (3, "created")}


def test_chunks_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "  "), (3, "a" * 2801)], "doc_id int, text string")
    assert [(r.doc_id, r.chunk, len(r.content)) for r in retrieval.chunks(df).orderBy("doc_id", "chunk").collect()] == [(3, 0, 1400), (3, 1, 1400), (3, 2, 1)]


def test_context_pack_keeps_critical(spark):
    rows = [(1, 0, "x" * 400, "y" * 40, False, 1, 60), (1, 1, "z" * 400, None, True, 0, 60)]
    df = spark.createDataFrame(rows, "pack bigint, place bigint, content string, summary string, critical boolean, priority int, budget int")
    out = vectorized.pack_context(df).collect()
    assert [(r.place, r.how) for r in out] == [(1, "clipped")] and sum(r.tokens for r in out) <= 60


def test_numbers_over_ranges(spark):
    from boardlake.functions.ranks import numbered

    rows = [(g, i) for g, n in (("hot", 500), ("a", 3), (None, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = {(r.g, r.i): r.nth for r in numbered(df, ["g"], ["i"]).collect()}
    assert got == {(g, i): i + 1 for g, i in rows}


def test_stable_ranking_does_not_depend_on_row_order(spark):
    import random

    rows = [(1, str(i), i // 3 % 5, [None, 1, 2][i % 3], f"n{i % 4}") for i in range(60)]
    schema = "g int, id string, value bigint, source_rank int, name string"
    runs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        runs.append(sorted(map(tuple, ranking.stable_ranking(spark.createDataFrame(rows, schema), ["g"]).collect()), key=lambda r: r[5]))
    assert runs[0] == runs[1]


def test_consistent_fields_are_brute_force(spark):
    import itertools
    import random

    from boardlake.operators.quality import consistent_fields, scored_candidates

    r = random.Random(4)
    rows = [(e, f, i, str(r.randrange(1, 9) * 10 ** r.randrange(1, 5)), float(r.randrange(100)), r.random() < 0.7) for e in range(12) for f in ("kp", "t4", "t5") for i in range(r.randrange(1, 7))]
    ranked = scored_candidates(spark.createDataFrame(rows, "ext int, field string, id int, value string, confidence double, valid boolean")).cache()
    top = {}
    for x in ranked.filter("place <= 3").collect():
        top.setdefault(x.ext, {}).setdefault(x.field, []).append((int(x.value), x.score, -x.place))
    for got in consistent_fields(ranked).collect():
        combos = []
        for a, b, c in itertools.product(*(top[got.ext][f] for f in ("kp", "t4", "t5"))):
            excess = b[0] + c[0] - a[0]
            combos.append((round(a[1] + b[1] + c[1] - (1.25 + min(2, excess / max(1, a[0])) if excess > 0 else 0), 9), a[2], b[2], c[2], a[0], b[0], c[0]))
        best = max(combos)
        assert (got.total, got.kp, got.t4, got.t5) == (best[0], *best[4:]) and got.inconsistent == (best[4] < best[5] + best[6])


def test_best_suggestions(spark):
    from boardlake.operators.identity import best_per_player

    rows = [("q", p, f"n{p}", s, src) for p, s, src in ((1, 0.9, "name"), (1, 0.95, "alias"), (2, 0.95, "name"), (3, 0.7, "name"), (4, 0.8, "name"), (5, 0.8, "name"), (6, 0.71, "name"))]
    out = best_per_player(spark.createDataFrame(rows, "query string, player bigint, name string, score double, source string")).orderBy("place").collect()
    assert [(x.player, x.score) for x in out] == [(1, 0.95), (2, 0.95), (4, 0.8), (5, 0.8), (6, 0.71)] and out[0].source == "alias"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b", c'), (1, "x\ty"), (3, None)], "k int, v string")
    sinks.write_csv(df, f"{tmp_path}/out", ["k"])
    back = spark.read.option("header", True).option("escape", '"').schema("k int, v string").csv(f"{tmp_path}/out")
    assert [tuple(r) for r in back.orderBy("k").collect()] == [(1, "x\ty"), (2, 'a "b", c'), (3, None)]
