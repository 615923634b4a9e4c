"""Operators on small inputs whose results are known."""

import pytest
from pyspark.sql import functions as F

from boardlake.functions import alliances, text
from boardlake.operators import activity, guards, ops, quality, ranking
from boardlake.streaming import jobs

GODT, V57, P57R = "[GODt] GOD of Thunder", "[V57] Legacy of Velmora", "[P57R] PHOENIX RISING 4057"


def column(spark, values, f):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, a string" + (", b string" if isinstance(values[0], tuple) else ""))
    return [r[1] for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("x")).orderBy("i").collect()]


def test_alliances_in_names(spark):
    cases = [("[GODt] Gd Hama", None, GODT), (None, "Legacy of Velmora", V57), ("GdMarshall", "", GODT), ("[V'57] Monkey D Luffy", None, V57), ("[V`57] Monkey D Luffy", None, V57), ("Monkey", "qq9", None), (None, None, None)]
    got = column(spark, [c[:2] for c in cases], lambda a, b: alliances.detected(a, b)["label"])
    assert got == [c[2] for c in cases]


@pytest.mark.parametrize("raw, clean", [("[P57R] xPortgas Ace", "xPortgas Ace"), ("[V 57] : Monkey D Luffy", "Monkey D Luffy"), ("gd_Hama", "gd_Hama"), ("Monkey D Luffy", "Monkey D Luffy")])
def test_names_without_tags(spark, raw, clean):
    assert column(spark, [raw], alliances.stripped) == [clean]


def test_filter_labels(spark):
    df = spark.createDataFrame([(0, "god of thunder"), (1, "[V57]"), (2, "P57R"), (3, "v57"), (4, " "), (5, "Others")], "seq long, raw string")
    assert [r.value for r in alliances.filter_labels(df).orderBy("seq").collect()] == [GODT, V57, P57R, "Others"]


def test_headers(spark):
    boards = {"MADSCIENTIST RANKINGS": "mad_scientist", "KILLPOINTS RANKINGS": "kill_point", "* INDIVIDUAL  POWER RANKINGS": "individual_power", "": "unknown"}
    metrics = {"Tech Contribution": "contribution_points", "Forts Destroyed": "fort_destroying", "Power": "power", "": "metric"}
    assert column(spark, list(boards), alliances.board_header) == list(boards.values())
    assert column(spark, list(metrics), alliances.metric_header) == list(metrics.values())
    assert column(spark, ["KILL POINTS and MADSCIENTIST", "nothing"], lambda c: F.array_join(alliances.board_tokens(c), ",")) == ["MAD SCIENTIST,KILL POINT", ""]


def test_cleaned_names_and_subtitles(spark):
    assert column(spark, ["a0b  1O5", "m1n5o", "a --- b", None], alliances.cleaned_name) == ["aOb 105", "mlnSo", "a - b", ""]
    assert column(spark, ["Officer of x", "The Best", ""], lambda c: alliances.subtitle(c)["alliance"]) == [None, "The Best", None]
    assert column(spark, ["Officer of x", "The Best", ""], lambda c: alliances.subtitle(c)["title"]) == ["Officer of x", None, None]


def test_the_shown_alliance(spark):
    players = spark.createDataFrame([(1, "[GODt] a", "old"), (2, "qq9", " Own qq "), (3, "zq9", "")], "player long, name string, alliance string")
    rows = spark.createDataFrame([(1, "raw"), (2, "raw"), (2, "V57"), (3, "raw"), (3, ""), (9, "raw"), (None, "raw")], "linked long, alliance_raw string")
    got = sorted((str(r.linked), r.alliance_raw, r.alliance) for r in alliances.canonical_alliances(rows, players).collect())
    assert got == sorted([("1", "raw", GODT), ("2", "raw", "Own qq"), ("2", "V57", V57), ("3", "raw", "raw"), ("3", "", None), ("9", "raw", "raw"), ("None", "raw", "raw")])


def test_a_member_without_rows_fails(spark):
    members = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "player long, name string, alliance string")
    periods = spark.createDataFrame([("w1", None), ("w2", "w1")], "period string, previous string")
    cols = "period string, player long, contribution long, fort long, kp long, power long, t4 long, t5 long, deads long"
    metrics = spark.createDataFrame([("w1", 1, 5, 1, 10, 100, 0, 0, 0), ("w2", 1, 50, 2, 30, 90, 0, 0, 0), ("w1", 2, 9, 0, 7, 70, 0, 0, 0)], cols)
    standards = spark.createDataFrame([("x", "contribution", 10), ("x", "kp_growth", 1)], "alliance string, metric string, minimum long")
    rows = {(r.period, r.player): r for r in activity.scored(activity.report(activity.growth(metrics, periods), members, periods), standards).collect()}
    assert len(rows) == 6
    nobody = rows["w2", 3]
    assert (nobody.contribution, nobody.fort, nobody.power, nobody.power_growth, nobody.status_contribution, nobody.status_kp_growth, nobody.overall) == (0, 0, 0, None, "FAIL", "NO_BASELINE", "FAIL")
    left = rows["w2", 2]  # was there the week before only
    assert (left.contribution, left.p_power, left.p_kp, left.kp_growth, left.power_baseline) == (0, 70, 7, None, False)
    assert (rows["w2", 1].kp_growth, rows["w2", 1].power_growth, rows["w2", 1].overall) == (20, -10, "PARTIAL")
    assert (rows["w1", 1].overall, rows["w1", 1].kp_growth) == ("FAIL", None)


def test_performance_and_movement(spark):
    rows = spark.createDataFrame([("w1", 1, 100, 50, 10, 8), ("w1", 2, 50, 0, 20, 4), ("w2", 1, 100, 0, 0, 0), ("w2", 2, 100, 10, 5, 5)], "period string, player long, contribution long, power_growth long, kp_growth long, fort long")
    scores = {(r.period, r.player): r.score for r in activity.performance(rows).collect()}
    assert scores["w1", 1] == pytest.approx(45 + 30 + 15 + 5) and scores["w1", 2] == pytest.approx(22.5 + 7.5 + 10)
    points = spark.createDataFrame([("w1", p, s) for p, s in ((1, 10.0), (2, 20.0), (3, 30.0))] + [("w2", 1, 15.0), ("w2", 2, 20.0), ("w3", 1, 1.0), ("w3", 3, 90.0)], "period string, player long, score double")
    periods = spark.createDataFrame([("w1", None), ("w2", "w1"), ("w3", "w2")], "period string, previous string")
    got = sorted((r.period, r.player, r.delta, r.side, r.compared) for r in activity.movement(points, periods).collect())
    assert got == [("w2", 1, 5.0, "up", 2), ("w3", 1, -14.0, "down", 1)]


def test_digit_counts(spark):
    rows = [("a", i, d, 90.0) for i, d in enumerate(["54268607", "53712011", "54890765", "526807"])] + [("b", i, d, 90.0) for i, d in enumerate(["", "", "", "1234567", "7654321"])] + [("c", 0, "", 90.0)]
    out = guards.digit_plausibility(spark.createDataFrame(rows, "run string, pos int, digits string, confidence double")).collect()
    assert {(r.run, r.baseline) for r in out} == {("a", 8), ("b", 7), ("c", 0)}
    assert [(r.run, r.pos, r.confidence) for r in out if r.outlier] == [("a", 3, 82.0)]


@pytest.mark.parametrize("ranks, want", [([None, 3, 9], [2, 3, 4]), ([0, -1, 5], [3, 4, 5]), ([None, None], [1, 2]), ([None, None, 1], [1, 2, 3]), ([4, 5, 6], [4, 5, 6])])
def test_ranks_in_sequence(spark, ranks, want):
    rows = [("a", i, k, 90.0) for i, k in enumerate(ranks)]
    out = guards.rank_repair(spark.createDataFrame(rows, "run string, pos int, source_rank int, confidence double")).orderBy("pos").collect()
    assert [r.repaired_rank for r in out] == want
    assert [r.confidence for r in out] == [90.0 if a == b else 85.0 for a, b in zip(ranks, want, strict=True)]


def test_one_violation_takes_the_best_candidate(spark):
    kind = "run string, pos int, value long, confidence double, candidates array<struct<value:long,score:double,confidence:double>>"
    rows = [("a", 0, 100, 80.0, []), ("a", 1, 900, 80.0, [(95, 0.5, 60.0), (90, 0.8, 70.0), (200, 0.9, 99.0)]), ("a", 2, 80, 80.0, []), ("b", 0, 1, 80.0, []), ("b", 1, 2, 80.0, [(1, 1.0, 90.0)]), ("b", 2, 3, 80.0, [])]
    out = {(r.run, r.pos): (r.fixed, r.confidence) for r in guards.monotonic_guard(spark.createDataFrame(rows, kind)).collect()}
    assert out["a", 1] == (90, 75.0) and out["b", 1] == (2, 73.0) and out["b", 2] == (3, 73.0) and out["a", 2] == (80, 80.0)


def test_uniform_metrics(spark):
    rows = [("a", 777777)] * 4 + [("a", 700001)] + [("b", v) for v in (781234, 779100, 776500, 772200, 769999)]
    out = {r.run: r.suspicious for r in guards.uniformity(spark.createDataFrame(rows, "run string, value long"), 4, 0.75).collect()}
    assert out == {"a": True, "b": False}


def test_profiles_for_sizes(spark):
    kind = "profile string, place int, archetype string, min_width int, max_width int, min_aspect double, max_aspect double"
    profiles = spark.createDataFrame([("wide", 0, "rankboard", 1800, 2040, 1.7, 1.85), ("tall", 1, "governor-profile", 600, 900, 0.4, 0.7), ("any", 2, None, None, None, None, None)], kind)
    images = spark.createDataFrame([(1, 1920, 1080), (2, 700, 1400), (3, 5000, 100)], "id int, width int, height int")
    run = lambda *a: {r.id: (r.profile, r.match) for r in ops.best_profile(images, profiles, *a).collect()}
    assert run() == {1: ("wide", "exact"), 2: ("any", "exact"), 3: ("any", "exact")}
    assert run("rankboard")[1] == ("wide", "exact") and run("governor-profile")[2] == ("tall", "exact")
    assert set(run(None, "tall").values()) == {("tall", "manual")} and run(None, "none")[1] == ("wide", "exact")


def test_metering(spark):
    at = "timestamp '2024-01-01'"
    rows = spark.range(8).select("id", F.lit(1).cast("long").alias("ws"), F.expr(f"{at} + make_interval(0, 0, 0, 0, cast(id as int))").alias("at"), (F.col("id") != 1).alias("ok"))
    settings = spark.createDataFrame([(1, True, 10, 3)], "ws long, enabled boolean, budget long, cost long")
    out = ops.metering(rows, settings).orderBy("id").collect()
    assert [r.reason for r in out] == ["ok", "provider-failed", "ok", "ok", *["monthly-budget-exceeded"] * 4]
    assert [r.spent for r in out] == [0, 3, 3, 6, 9, 9, 9, 9]
    for enabled, budget, why in ((False, 10, "fallback-disabled"), (True, 0, "monthly-budget-cap-zero")):
        out = ops.metering(rows, spark.createDataFrame([(1, enabled, budget, 3)], "ws long, enabled boolean, budget long, cost long")).collect()
        assert {r.reason for r in out} == {why}
    assert {r.reason for r in ops.metering(rows, settings.filter("ws = 2")).collect()} == {"fallback-disabled"}


def test_merges_are_a_replay(spark):
    import random

    r = random.Random(6)
    rows = [(i, r.randint(0, 3), r.randint(0, 4), r.randint(0, 4), r.choice(["ACTIVE", "UNRESOLVED", "REJECTED"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int, run int, row int, status string").select("id", "k", F.timestamp_seconds("run").alias("created_at"), F.timestamp_seconds("row").alias("updated_at"), "status")
    got = {x.id: x.decision for x in ranking.merge_decisions(df, ["k"]).collect()}
    stands = {}
    for i, k, run, row, status in rows:
        s = stands.get(k)
        if s is None:
            want = "created"
        elif s[0] > run:
            want = "existing-run-is-newer"
        elif s[0] == run and s[1] > row:
            want = "existing-row-is-newer"
        elif s[2] == "ACTIVE" and status != "ACTIVE":
            want = "non-active-row-cannot-overwrite-active"
        else:
            want = "updated"
        assert got[i] == want
        if want in ("created", "updated"):
            stands[k] = (run, row, status)


def test_severity_and_checks(spark):
    kind = "id int, governorId string, name string, power string, killPoints string, t4Kills string, t5Kills string, deads string"
    rows = [(1, "12345", "A", "1000", "", "", "", ""), (2, "987654321", "Nova", "125,000,000", "400", "300", "200", "0"), (3, "222289750", "Łac", "0", "6000000000", "", "", "x")]
    out = {(r.id, r.field): (r.valid, r.severity, r.warning) for r in quality.field_checks(spark.createDataFrame(rows, kind)).collect()}
    assert out[1, "governorId"] == (False, "error", "Governor ID should be 6-12 digits") and out[1, "power"] == (False, "warning", "Power (1,000) seems too low")
    assert out[1, "killPoints"] == (True, "error", "Kill Points could not be parsed as a number") and out[1, "t4Kills"] == (True, "ok", None)
    assert out[2, "killPoints"] == (True, "warning", "Kill points less than T4+T5 sum — check values") and out[2, "name"] == (True, "ok", None)
    assert out[3, "power"] == (False, "error", "Power is zero or missing") and out[3, "killPoints"] == (False, "warning", "Kill Points (6,000,000,000) seems too high") and out[3, "name"][1] == "warning"
    args = lambda status, low, k, e, w: [F.lit(status), F.lit(low), F.lit(k), F.lit(e), F.lit(w)]
    for a, failures, level, reasons in (
        (("RAW", False, 42, 1, 0), None, "HIGH", ["Very low confidence field (42%).", "1 validation error(s)."]), (("RAW", False, 90, 0, 0), [], "LOW", ["OCR confidence and validation are healthy."]),
        (("REJECTED", True, 1, 9, 9), ["x"], "LOW", ["Marked as rejected."]), (("RAW", True, 70, 0, 2), ["a", "b", "c", "d"], "HIGH", ["Engine marked this extraction as low-confidence.", "OCR failure reasons: a, b, c.", "Low confidence field (70%).", "2 validation warning(s)."]),
    ):
        f = F.lit(None).cast("array<string>") if failures is None else F.array(*map(F.lit, failures)).cast("array<string>")
        r = spark.range(1).select(quality.severity(*args(*a)).alias("l"), quality.severity_reasons(*args(*a), f).alias("r")).first()
        assert (r.l, r.r) == (level, reasons)


def test_ids_put_right(spark):
    players = spark.createDataFrame([("111111", "Nova", "nova"), ("222222", "Twin", "twin"), ("333333", "TWIN", "twin"), ("44", "Short", "short")], "player string, name string, alias_key string")
    rows = spark.createDataFrame([(1, "12", "nova", "nova"), (2, "999999", "NOVA", "nova"), (3, "999999", "twin", "twin"), (4, "222222", "Nova", "nova"), (5, "", "who", "who"), (6, None, "short", "short"), (7, "5", "twin", "twin")], "id int, player string, name string, alias_key string")
    got = {r.id: (r.player, r.repair) for r in quality.repaired_ids(rows, players).collect()}
    assert got == {1: ("111111", "by-name"), 2: ("111111", "by-alias"), 3: ("999999", "kept"), 4: ("222222", "kept"), 5: (None, "invalid"), 6: (None, "invalid"), 7: ("222222", "by-name")}


@pytest.mark.parametrize("n, shown", [(0, "0"), (999, "+999"), (-1500, "-1.5K"), (1_000_000, "+1M"), (1_250_000_000, "+1.3B"), (-950, "-950")])
def test_compact_numbers(spark, n, shown):
    assert spark.range(1).select(text.signed_compact(F.lit(n).cast("long"))).first()[0] == shown


def test_a_drained_backlog(spark):
    rows = spark.createDataFrame([(1, 1, "w1", 5, "PENDING", 0), (2, 9, "w1", 5, "FAILED", 2), (3, 1, "w9", 5, "PENDING", 0), (4, 1, "w1", 0, "PENDING", 1), (5, 1, "w1", 5, "PROCESSING", 1)], "id int, player int, period string, value int, status string, attempts int")
    out = jobs.drained(rows, spark.createDataFrame([(1,), (1,)], "player int"), spark.createDataFrame([("w1",)], "period string"))
    assert {r.id: (r.status, r.attempts, r.error) for r in out.collect()} == {1: ("SUCCEEDED", 1, None), 2: ("FAILED", 3, "unknown player"), 3: ("FAILED", 1, "unknown event"), 4: ("FAILED", 2, "Skipped invalid profile metrics"), 5: ("PROCESSING", 1, None)}
    assert tuple(jobs.drain_counts(out).first()) == (4, 1, 3)


def test_state_of_a_stream_in_deltas(spark, tmp_path):
    src, kind = tmp_path / "in", "period string, player long, metric string, value long, observed_at timestamp, ref string"
    rows = [("w", i % 3, "m", i, f"2024-01-0{1 + i % 9}", str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, kind.replace("timestamp", "string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for k in range(8):
        df.filter(F.col("value") % 8 == k).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    jobs.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), compact_every=3).awaitTermination()
    got = sorted((r.player, r.value) for r in jobs.read_state(spark, str(tmp_path / "state")).collect())
    best = {}
    for _, p, _, v, at, ref in rows:
        best[p] = max(best.get(p, ("", -1, "")), (at, v, ref))
    assert got == sorted((p, v) for p, (_, v, _) in best.items())
