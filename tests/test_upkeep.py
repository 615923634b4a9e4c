"""Upkeep of stored tables, and rows of the survey whose rules are easiest seen in small cases."""

import datetime as dt
import os
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from boardlake.functions import text, vectorized
from boardlake.operators import dedupe, guards, identity, ops, quality, ranking, upkeep

NOW = "2024-06-01 00:00:00"


def tables(spark, folder):
    runs = [("2024-01", 1, "MERGED", dt.datetime(2024, 1, 5), {"own": "x"}), ("2024-01", 2, "REVIEW", dt.datetime(2024, 1, 6), None), ("2024-02", 3, "FAILED", dt.datetime(2024, 2, 5), None), ("2024-03", 4, "MERGED", dt.datetime(2024, 3, 5), None), ("2024-05", 5, "MERGED", dt.datetime(2024, 5, 30), None)]
    spark.createDataFrame(runs, "month string, run bigint, status string, processed_at timestamp, metadata map<string,string>").write.partitionBy("month").parquet(f"{folder}/runs")
    rows = [(m, run, f"n{i}", "trace", "[]") for m, run, *_ in runs for i in range(3)]
    spark.createDataFrame(rows, "month string, run bigint, name string, ocr_trace string, candidates string").write.partitionBy("month").parquet(f"{folder}/rows")
    return f"{folder}/runs", f"{folder}/rows"


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_archive_touches_only_partitions_of_stale_runs(spark, tmp_path):
    runs, rows = tables(spark, str(tmp_path))
    before = files(rows)
    for _ in range(2):  # a repeated run ends in the same tables
        got = upkeep.archive_runs(spark, runs, rows, NOW, 30, limit=2).first()
        assert tuple(got) == (2, 2, 6)
        after = files(rows)
        kept = [p for p in before if "2024-01" not in p and "2024-02" not in p]
        assert all(after[p] == before[p] for p in kept) and not any(p in after for p in before if p not in kept)
        table = spark.read.parquet(rows)
        assert table.count() == 15 and {r.run for r in table.filter("ocr_trace is null and candidates is null").collect()} == {1, 3}
        notes = {r.run: r.metadata for r in spark.read.parquet(runs).collect()}
        stamp = {"archivedRawRowsAt": NOW, "archivedRawRowsOlderThanDays": "30"}
        assert notes == {1: {"own": "x", **stamp}, 2: None, 3: stamp, 4: None, 5: None}
        assert sum(r["count"] for r in spark.read.parquet(runs).groupBy("run").count().collect()) == 5


def test_archive_without_stale_runs(spark, tmp_path):
    runs, rows = tables(spark, str(tmp_path))
    before = files(rows)
    assert tuple(upkeep.archive_runs(spark, runs, rows, "2024-01-02 00:00:00").first()) == (0, 0, 0) and files(rows) == before
    assert upkeep.archive_runs(spark, runs, rows, NOW, 1).first().scanned == 3  # 7 days at the least, but run 5 is two days old


def test_weeks_between(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 29, 12)), (2, dt.datetime(2026, 4, 13, 0, 30)), (3, None)], "ws bigint, at timestamp")
    settings = spark.createDataFrame([(2, "-05:00")], "ws bigint, offset string")
    none = spark.createDataFrame([], "ws bigint, week_key string")
    weeks = lambda **kw: sorted((r.ws, r.week_key) for r in upkeep.missing_weeks(rows, none, settings, F.lit(NOW), **kw).collect())
    assert weeks() == [(1, "2024-W01"), (1, "2024-W05"), (2, "2026-W15")]
    assert weeks(between=True) == [(1, f"2024-W0{i}") for i in range(1, 6)] + [(2, "2026-W15")]


def test_compact_is_as_the_double_is(spark):
    """Against the exact value of the double, rounded half up."""
    values = [*range(-3000, 3000, 10), *range(1_000_000, 1_400_000, 12_345), 1_250_000, 1_350_000, 999_949, 999_950, 999_999, 1_000_000, 10**9 + 50_000_000, 123_456_789_012, 0, 999, -999, -1000, -1150, -1250]
    got = {r.v: r.t for r in spark.createDataFrame([(v,) for v in values], "v bigint").select("v", text.compact(F.col("v")).alias("t")).collect()}
    for v in values:
        unit, by = next(((u, b) for u, b in (("B", 1e9), ("M", 1e6), ("K", 1e3)) if abs(v) >= b), ("", 0))
        want = str(v) if not by else ("-" if v < 0 else "") + str(Decimal(abs(v) / by).quantize(Decimal("0.1"), ROUND_HALF_UP)).removesuffix(".0") + unit
        assert got[v] == want, v
    assert got[1150] == "1.1K"


def test_job_progress(spark):
    tasks = spark.createDataFrame([(1, "QUEUED"), (1, "QUEUED"), (2, "FAILED"), (3, "FAILED"), (3, "COMPLETED"), (4, "PROCESSING"), (4, "COMPLETED")], "job bigint, status string")
    jobs = spark.createDataFrame([(i,) for i in range(1, 6)], "job bigint")
    low = spark.createDataFrame([(1, True), (1, True), (1, False), (5, True)], "job bigint, low_confidence boolean")
    got = {r.job: (r.job_status, r.total, r.processed, r.low_confidence) for r in ops.job_progress(tasks, jobs, low).collect()}
    assert got == {1: ("PROCESSING", 2, 0, 2), 2: ("FAILED", 1, 1, 0), 3: ("REVIEW", 2, 2, 0), 4: ("PROCESSING", 2, 1, 0), 5: ("QUEUED", 0, 0, 1)}


def test_golden_cases(spark):
    cases = [("a", "power", "1,234", "1 ,2 34", 90.0, 80.0, 50.0, True), ("b", "power", "1,234", "1234", 90.0, 80.0, 50.0, True), ("c", "name", "Ab", "aB", 70.0, 80.0, 50.0, False), ("d", "name", "x", "x", 40.0, 30.0, 50.0, False), ("e", "name", "x", "y", 10.0, 30.0, 5.0, False)]
    df = spark.createDataFrame(cases, "case string, field string, expected string, actual string, confidence double, least double, least_mean double, numeric boolean")
    got = {r.case: (r.mismatches, r.low, r.low_mean, r.passed) for r in quality.golden(df).collect()}
    assert got == {"a": (0, 0, False, True), "b": (1, 0, False, False), "c": (0, 1, False, False), "d": (0, 0, True, False), "e": (1, 0, False, False)}
    s = quality.golden_suite(df).first()
    assert (s.total, s.passed, s.failed, s.numeric_total, s.numeric_exact, s.numeric_rate, s.numeric_passed) == (5, 1, 4, 2, 2, 1.0, True)
    none = quality.golden_suite(df.limit(0)).first()
    assert (none.total, none.numeric_rate, none.numeric_passed) == (0, 1.0, True)


def test_manifest(spark):
    jobs = spark.createDataFrame([(1, 3, 2, "PROCESSING"), (2, 1, 1, "REVIEW"), (3, 0, 2, "QUEUED")], "job bigint, total int, expected int, status string")
    manifest = spark.createDataFrame([(1, 2, "r2", None, None, "FAILED", None), (1, 1, "r1", "f", None, "", "boom"), (1, 3, "r3", "f", "t", "failed", "x"), (2, 1, "r", "f", None, "failed", None)], "job bigint, place int, row string, file string, task string, status string, error string")
    tasks = spark.createDataFrame([(1,), (1,), (2,)], "job bigint")
    got = {r.job: (r.expected, r.enqueued, r.missing, r.status, r.entries and [tuple(e) for e in r.entries]) for r in ops.manifest_gaps(jobs, manifest, tasks).collect()}
    assert got == {1: (3, 2, 2, "FAILED", [("r1", "f", "failed", "boom"), ("r2", None, "FAILED", "not-enqueued")]), 2: (1, 1, 0, "REVIEW", None), 3: (2, 0, 2, "FAILED", None)}


def test_suggestions_are_read_one_by_one(spark):
    good = '{"governorId":"1","governorGameId":"2","name":" n ","source":"alias"}'
    cases = {f"[7,{good}]": 1, f"[null,[],{good},{good}]": 1, '[{"governorId":7,"governorGameId":"2","name":"n","source":"name"}]': 0, '[{"governorId":"1","governorGameId":{"z":1},"name":"n","source":"name"}]': 0, '[{"governorId":"1","governorGameId":"2","name":"  ","source":"name"}]': 0, '"x"': 0, "{": 0}
    df = spark.createDataFrame([(k, f'{{"identitySuggestions":{k}}}') for k in cases] + [("none", None), ("list", f"[{good}]")], "k string, j string")
    got = {r.k: r.s for r in df.select("k", quality.identity_suggestions(F.col("j")).alias("s")).collect()}
    assert {k: len(v) for k, v in got.items()} == {**cases, "none": 0, "list": 0} and tuple(got[f"[7,{good}]"][0]) == ("1", "2", "n", "alias")


def test_long_numbers_are_no_noughts(spark):
    df = spark.createDataFrame([("12",), ("9" * 25,), ("x",), (None,), ("1-2",)], "t string")
    assert [r[0] for r in df.select(quality.number_of(F.col("t"))).collect()] == [12, None, 0, 0, 0]


def test_values_of_twenty_digits_are_consistent(spark):
    big = 10**20
    rows = [(1, "kp", 1, str(5 * big), 90.0, True), (1, "t4", 2, str(big), 90.0, True), (1, "t5", 3, str(big), 90.0, True), (2, "kp", 4, "1", 90.0, True)]
    df = spark.createDataFrame(rows, "ext int, field string, id int, value string, confidence double, valid boolean")
    got = quality.consistent_fields(quality.scored_candidates(df)).collect()
    assert [(r.ext, int(r.kp), r.inconsistent) for r in got] == [(1, 5 * big, False)]


def test_free_requests_get_through(spark):
    df = spark.createDataFrame([(i, 1, dt.datetime(2024, 1, 1 + i), True) for i in range(5)], "id bigint, ws bigint, at timestamp, ok boolean")
    settings = spark.createDataFrame([(1, True, 10, 0)], "ws bigint, enabled boolean, budget bigint, cost bigint")
    assert [(r.spent, r.reason) for r in ops.metering(df, settings).collect()] == [(0, "ok")] * 5


def test_context_packs(spark):
    rows = [(1, 0, "x" * 400, None, True, None, 25), (1, 1, "", "only a summary", True, None, 25), (1, 2, "y" * 90, "z" * 8, True, 60, 25), (2, 0, "a\r\n\n\n\nb\x07", None, False, None, 5), (3, 0, "w" * 4000, None, True, None, 100)]
    df = spark.createDataFrame(rows, "pack bigint, place bigint, content string, summary string, critical boolean, priority int, budget int")
    got = {(r.pack, r.place): (r.how, r.tokens) for r in vectorized.pack_context(df).collect()}
    assert got == {(1, 2): ("full", 23), (2, 0): ("full", 1), (3, 0): ("clipped", 100)}


def test_artifacts_bars_peers_and_runs(spark):
    a = spark.createDataFrame([(1, 2, "COMPLETED", 5, " x ", "u"), (1, 1, "COMPLETED", 5, "x", ""), (1, 3, "COMPLETED", 4, "x", "u"), (1, 4, "QUEUED", 1, "y", "u"), (1, 5, "COMPLETED", 1, None, "u"), (2, 6, "COMPLETED", 9, "x", "u")], "job bigint, task bigint, status string, created_at bigint, artifact string, url string")
    none = F.lit(None).cast("map<string,string>")
    assert {(r.job, r.artifact): r.task for r in dedupe.first_artifacts(a.withColumns({"meta": none, "task_meta": none})).collect()} == {(1, "x"): 3, (2, "x"): 6}
    b = spark.createDataFrame([("p", 10, dt.datetime(2024, 5, 1)), ("p", 4, dt.datetime(2024, 5, 31)), ("p", -4, None), ("p", None, None), ("q", 0, None)], "page string, value bigint, updated_at timestamp")
    assert sorted((r.page, r.hundredths, r.tone) for r in ranking.bars(b, ["page"], F.lit(NOW).cast("timestamp")).collect() if r.page == "p") == [("p", 0, "good"), ("p", 0, "good"), ("p", 4000, "good"), ("p", 10000, "good")]
    p = spark.createDataFrame([(1, i, "APPROVED" if i < 3 else "PENDING", 5, 1234) for i in range(4)] + [(2, i, "APPROVED", 0, 0) for i in range(3)], "job bigint, id bigint, status string, power bigint, kp bigint")
    assert {(r.job, r.id): (r.kp_peers, r.skip_sync) for r in guards.repeated_values(p).collect()} == {(1, 0): (2, True), (1, 1): (2, True), (1, 2): (2, True), (1, 3): (3, True), (2, 0): (2, True), (2, 1): (2, True), (2, 2): (2, True)}
    rows = spark.createDataFrame([(1, 90.0, 90.0, 90.0, 90.0, True, False), (2, 90.0, 90.0, 90.0, 90.0, False, False), (3, 90.0, 90.0, 90.0, 90.0, True, True)], "run bigint, rank_conf double, name_conf double, metric_conf double, title_conf double, grouping_ok boolean, failed boolean")
    runs = spark.createDataFrame([(1, None), (2, ["x"]), (3, []), (4, None)], "run bigint, guard_failures array<string>")
    assert {r.run: (r.confidence, r.low_confidence) for r in guards.run_quality(rows, runs).collect()} == {1: (90.0, False), 2: (83.0, True), 3: (90.0, True), 4: (0.0, True)}


@pytest.mark.parametrize(("status", "low", "failures", "confidence", "want"), [("RAW", True, None, 90, "HIGH"), ("APPROVED", True, [], 90, "MEDIUM"), ("APPROVED", False, ["x"], 90, "HIGH"), ("RAW", False, None, 69, "MEDIUM"), ("RAW", None, None, 70, "LOW")])
def test_read_severity(spark, status, low, failures, confidence, want):
    df = spark.createDataFrame([(status, low, failures, confidence)], "s string, l boolean, f array<string>, c int")
    assert df.select(quality.read_severity(*map(F.col, "slfc"))).first()[0] == want


def test_aliases(spark):
    names = spark.createDataFrame([(1, 7, "Lord A", "P57", True), (2, 8, "lord a", "X", False), (3, 7, "Unknown", "P57", True), (4, None, "Gone", "", False), (5, 9, "Own", "", True)], "seq bigint, player bigint, name string, tag string, tracked boolean")
    seeded = identity.seed_aliases(identity.alias_candidates(names), spark.createDataFrame([("own", 9)], "alias_key string, player bigint"))
    got = sorted((r.seq, r.alias_key, r.outcome) for r in seeded.collect())
    assert got == [(1, "lorda", "seeded"), (1, "p57lorda", "seeded"), (2, "lorda", "conflict"), (3, "p57unknown", "seeded"), (4, "", "skipped"), (5, "own", "skipped")]
    assert tuple(identity.alias_outcomes(seeded).first()) == (3, 1, 2)


def test_suggestions_are_parsed_once(spark):
    item = '{"governorId":"%s","governorGameId":"1","name":"n","source":"name"}'
    text = '{"identitySuggestions":[' + ",".join(item % (i // 2) for i in range(30)) + "]}"
    df = spark.createDataFrame([(text,)], "j string").select(quality.identity_suggestions(F.col("j")).alias("s"))
    assert [s.id for s in df.first().s] == [str(i) for i in range(8)]
    assert df._jdf.queryExecution().analyzed().toString().count("try_parse_json") <= 2  # the value and its type



def test_each_cell_is_read_once(spark):
    rows = [(1, 1, i, text) for i, text in enumerate(['{"name":"a","power":0,"powerRaw":"7"}', '{"governorId":5,"kp":false,"metricRaw":"9","metricKey":" KP"}', '{"name":""}', "no json", None, '{"name":"b\\t c","rank":"0","power":"false"}'])]
    out = quality.analysis_rows(spark.createDataFrame(rows, "plan bigint, read bigint, at bigint, row string"))
    got = {r["at"]: (r["place"], r["rank"], r["player"], r["player_id"], r["kp"], r["power"]) for r in out.collect()}
    assert got == {0: (1, "-", "a", "-", "-", "7"), 1: (2, "-", "-", "5", "9", "-"), 5: (3, "0", "b c", "-", "-", "false")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.governorNameRaw") == plan.count("$.metricRaw") == 1
