"""Queries of the weekly report, and of what builds on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.operators import activity, observations, scores, upkeep
from boardlake.plans import registry as r
from boardlake.plans.registry import query
from boardlake.sources.scratch import scratch

WEEKLY_SQL = """,
periods AS (SELECT period, min(date_trunc('week', observed_at)) AS starts_at, lag(period) OVER (ORDER BY period) AS previous FROM obs GROUP BY period),
members AS (SELECT period, p.player, p.name, p.alliance FROM periods, players p),
cur AS (SELECT period, player, coalesce(max(CASE metric WHEN 'contribution_points' THEN value END), 0) AS contribution, coalesce(max(CASE metric WHEN 'fort_destroying' THEN value END), 0) AS fort,
  max(CASE metric WHEN 'kill_points' THEN value END) AS okp, max(CASE metric WHEN 'power' THEN value END) AS opow FROM obs GROUP BY 1, 2),
brd AS (SELECT strftime(CAST('2024-01-01' AS TIMESTAMP) + INTERVAL 1 DAY * (id % 30), '%G-W%V') AS period, identity AS player, arg_max(value, row(updated_at, value)) AS bpow FROM board WHERE status = 'ACTIVE' AND type = '1-URGENT' GROUP BY 1, 2),
ws AS (SELECT period, player, max(value) AS power, max(value // 2) AS kp, max(value // 10) AS t4, max(value // 20) AS t5, max(value) AS deads FROM obs WHERE metric = 'deads' GROUP BY 1, 2),
keys AS (SELECT period, player FROM cur UNION SELECT period, player FROM brd UNION SELECT period, player FROM ws),
m AS (SELECT k.period, k.player, coalesce(contribution, 0) AS contribution, coalesce(fort, 0) AS fort, coalesce(okp, s.kp) AS kp, coalesce(bpow, opow, s.power) AS power FROM keys k LEFT JOIN cur USING (period, player) LEFT JOIN brd USING (period, player)
  LEFT JOIN ws s ON s.player = k.player AND s.period = k.period),
gk AS (SELECT period, player FROM m UNION SELECT p.period, m.player FROM m JOIN periods p ON p.previous = m.period),
g AS (SELECT k.period, k.player, m.contribution, m.fort, m.kp, m.power, m.power - q.power AS power_growth, m.kp - q.kp AS kp_growth, q.kp AS p_kp, q.power AS p_power
  FROM gk k JOIN periods USING (period) LEFT JOIN m ON m.period = k.period AND m.player = k.player LEFT JOIN m q ON q.period = periods.previous AND q.player = k.player),
rep AS (SELECT mb.period, mb.player, mb.name, mb.alliance, coalesce(g.contribution, 0) AS contribution, coalesce(g.fort, 0) AS fort, coalesce(g.kp, 0) AS kp, coalesce(g.power, 0) AS power, coalesce(g.p_kp, 0) AS p_kp, coalesce(g.p_power, 0) AS p_power,
  g.power_growth, g.kp_growth FROM members mb LEFT JOIN g ON g.period = mb.period AND g.player = mb.player),
std AS (SELECT n_name AS alliance, 20000 + n_nationkey * 100 AS min_contribution, CASE WHEN n_nationkey % 5 > 0 THEN 5000 END AS min_fort, CASE WHEN n_nationkey % 3 > 0 THEN 0 END AS min_power_growth, CASE WHEN n_nationkey % 4 > 0 THEN -2000 END AS min_kp_growth FROM nation),
sc0 AS (SELECT g.period, g.player, g.name, g.alliance, g.contribution, g.fort, g.kp, g.power, g.p_kp, g.p_power, g.power_growth, g.kp_growth,
  CASE WHEN min_contribution IS NULL THEN 'NO_STANDARD' WHEN contribution >= min_contribution THEN 'PASS' ELSE 'FAIL' END AS s1,
  CASE WHEN min_fort IS NULL THEN 'NO_STANDARD' WHEN fort >= min_fort THEN 'PASS' ELSE 'FAIL' END AS s2,
  CASE WHEN power_growth IS NULL THEN 'NO_BASELINE' WHEN min_power_growth IS NULL THEN 'NO_STANDARD' WHEN power_growth >= min_power_growth THEN 'PASS' ELSE 'FAIL' END AS s3,
  CASE WHEN kp_growth IS NULL THEN 'NO_BASELINE' WHEN min_kp_growth IS NULL THEN 'NO_STANDARD' WHEN kp_growth >= min_kp_growth THEN 'PASS' ELSE 'FAIL' END AS s4
  FROM rep g JOIN std USING (alliance)),
sc AS (SELECT *, CASE WHEN 'FAIL' IN (s1, s2, s3, s4) THEN 'FAIL' WHEN s1 = 'PASS' AND s2 = 'PASS' AND s3 = 'PASS' AND s4 = 'PASS' THEN 'PASS' WHEN 'PASS' IN (s1, s2, s3, s4) THEN 'PARTIAL' ELSE 'NO_STANDARD' END AS overall FROM sc0)
"""


def periods(spark: SparkSession, d: str) -> DataFrame:
    p = r.observations(spark, d).groupBy("period").agg(F.min(F.date_trunc("week", "observed_at")).alias("starts_at")).withColumn("created_at", F.col("starts_at"))
    return activity.previous_periods(p)


def metrics(spark: SparkSession, d: str) -> DataFrame:
    obs = r.observations(spark, d).filter("metric <> 'deads'")
    day = F.timestamp_add("DAY", (F.col("id") % 30).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    b = r.boards(spark, d).filter("status = 'ACTIVE' and type = '1-URGENT'").select(week.alias("period"), F.col("identity").alias("player"), "metric", "value", F.lit("individual_power").alias("type"), "updated_at")
    # profiles are the fifth kind of event, so a week of a player may lack one
    own = F.col("value")
    parts = {"power": own, "kp": F.expr("value div 2"), "t4": F.expr("value div 10"), "t5": F.expr("value div 20"), "deads": own}
    s = r.observations(spark, d).filter("metric = 'deads'").groupBy("period", "player").agg(*[F.max(v).alias(c) for c, v in parts.items()])
    # players without any observation that week are known by their board rows only
    seen = r.observations(spark, d).select("period", "player", F.lit("deads").alias("metric"), F.lit(0).cast("long").alias("value"))
    return activity.weekly_metrics(obs.select("period", "player", "metric", "value").unionByName(seen), b, s)


def standards(spark: SparkSession, d: str) -> DataFrame:
    n = r.t(spark, d, "nation")
    k = F.col("n_nationkey")
    wide = n.select(F.col("n_name").alias("alliance"), (20000 + k * 100).cast("long").alias("contribution"), F.when(k % 5 > 0, F.lit(5000)).cast("long").alias("fort"), F.when(k % 3 > 0, F.lit(0)).cast("long").alias("power_growth"), F.when(k % 4 > 0, F.lit(-2000)).cast("long").alias("kp_growth"))
    return wide.unpivot(["alliance"], activity.METRICS, "metric", "minimum").filter("minimum is not null")


def scored(spark: SparkSession, d: str) -> DataFrame:
    p = periods(spark, d)
    g = activity.growth(metrics(spark, d), p)
    return activity.scored(activity.report(g, r.players(spark, d).select("player", "name", "alliance"), p), standards(spark, d))


@query("a5_report_summary", WEEKLY_SQL + "SELECT period, count(*) AS members, count(*) FILTER (power_growth IS NULL) AS no_power_baseline, count(*) FILTER (kp_growth IS NULL) AS no_kp_baseline, (SELECT count(*) FROM board WHERE status = 'UNRESOLVED') AS unresolved, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS pending FROM sc GROUP BY 1")
def report_summary(spark, d):
    waiting = r.boards(spark, d).filter("status = 'UNRESOLVED'"), r.t(spark, d, "lineitem").filter("l_linestatus = 'O'")
    return activity.report_summary(scored(spark, d), *waiting)


@query("a5_weekly_report", WEEKLY_SQL + "SELECT period, player, name, alliance, contribution, fort, kp, power, p_kp, p_power, power_growth, kp_growth, s1 AS status_contribution, s2 AS status_fort, s3 AS status_power_growth, s4 AS status_kp_growth, overall FROM sc")
def weekly_report(spark, d):
    return scored(spark, d).select("period", "player", "name", "alliance", "contribution", "fort", "kp", "power", "p_kp", "p_power", "power_growth", "kp_growth", *[f"status_{m}" for m in ("contribution", "fort", "power_growth", "kp_growth")], "overall")


@query("j3_previous_period", WEEKLY_SQL + "SELECT period, previous FROM periods")
def previous(spark, d):
    return periods(spark, d).select("period", "previous")


@query("a4_alliance_summary", WEEKLY_SQL + """SELECT p.period, n_name AS alliance, count(sc.player) AS members, count(*) FILTER (overall = 'PASS') AS passed, count(*) FILTER (overall = 'FAIL') AS failed, count(*) FILTER (overall = 'PARTIAL') AS partial, count(*) FILTER (overall = 'NO_STANDARD') AS no_standard,
  CAST(coalesce(sum(contribution), 0) AS BIGINT) AS contribution, CAST(coalesce(sum(power_growth), 0) AS BIGINT) AS power_growth, CAST(coalesce(sum(fort), 0) AS BIGINT) AS fort, CAST(coalesce(sum(kp_growth), 0) AS BIGINT) AS kp_growth
  FROM periods p CROSS JOIN nation LEFT JOIN sc ON sc.period = p.period AND sc.alliance = n_name GROUP BY 1, 2""")
def summary(spark, d):
    catalog = periods(spark, d).select("period").crossJoin(F.broadcast(r.t(spark, d, "nation").select(F.col("n_name").alias("alliance"))))
    return activity.alliance_summary(scored(spark, d), catalog)


@query("a6_insights", WEEKLY_SQL + ", i AS (SELECT period, alliance, count(*) AS members, count(*) FILTER (overall = 'PASS') AS passed, count(*) FILTER (overall = 'FAIL') AS failed, CAST(sum(contribution) AS BIGINT) AS contribution, CAST(coalesce(sum(power_growth), 0) AS BIGINT) AS power_growth, CAST(floor(100.0 * count(*) FILTER (overall = 'PASS') / count(*) + 0.5) AS INTEGER) AS pass_rate, CAST(floor(100.0 * count(power_growth) / count(*) + 0.5) AS INTEGER) AS baseline_coverage FROM sc GROUP BY GROUPING SETS ((period, alliance), (period))) SELECT *, CASE WHEN alliance IS NOT NULL THEN row_number() OVER (PARTITION BY period, alliance IS NULL ORDER BY pass_rate DESC, passed DESC, members DESC, alliance) END AS place FROM i")
def insights(spark, d):
    return activity.insights(scored(spark, d))


@query("t2_top_members", WEEKLY_SQL + """, l AS (UNPIVOT (SELECT period, player, name, contribution, coalesce(power_growth, 0) AS power_growth, fort, coalesce(kp_growth, 0) AS kp_growth FROM sc) ON contribution, fort, power_growth, kp_growth INTO NAME metric VALUE value)
SELECT period, player, name, metric, value, place FROM (SELECT *, row_number() OVER (PARTITION BY period, metric ORDER BY value DESC, name, player) AS place FROM l) WHERE place <= 5""")
def top(spark, d):
    return activity.top_by_metric(scored(spark, d))


@query("t2_leaders", WEEKLY_SQL + """, dd AS (SELECT k.period, k.player, CASE WHEN okp IS NULL THEN coalesce(s.deads, 0) ELSE 0 END AS deads FROM keys k LEFT JOIN cur USING (period, player) LEFT JOIN ws s ON s.player = k.player AND s.period = k.period),
gr AS (SELECT sc.period, sc.player, name, coalesce(kp_growth, 0) AS kp_growth, CASE WHEN kp_growth IS NOT NULL THEN coalesce(d.deads, 0) - coalesce(q.deads, 0) ELSE 0 END AS deads_growth FROM sc JOIN periods ON periods.period = sc.period LEFT JOIN dd d ON d.period = sc.period AND d.player = sc.player LEFT JOIN dd q ON q.period = periods.previous AND q.player = sc.player),
l AS (UNPIVOT gr ON kp_growth, deads_growth INTO NAME metric VALUE value)
SELECT period, player, name, metric, value, place FROM (SELECT *, row_number() OVER (PARTITION BY period, metric ORDER BY value DESC, name, player) AS place FROM l) WHERE place <= CASE metric WHEN 'kp_growth' THEN 5 ELSE 3 END""")
def leaders(spark, d):
    return activity.leaders(scored(spark, d))


@query("t2_inactive_members", WEEKLY_SQL + "SELECT period, player, alliance FROM sc WHERE overall = 'FAIL' AND coalesce(kp_growth, 0) <= 0 AND fort <= 0")
def inactive(spark, d):
    return activity.inactive(scored(spark, d)).select("period", "player", "alliance")


PERFORMANCE_SQL = WEEKLY_SQL + """, mx AS (SELECT period, max(greatest(contribution, 0)) AS c, max(greatest(coalesce(power_growth, 0), 0)) AS pg, max(greatest(coalesce(kp_growth, 0), 0)) AS k, max(greatest(fort, 0)) AS f FROM sc GROUP BY 1),
perf AS (SELECT period, player, round(CASE WHEN c > 0 THEN (greatest(contribution, 0) * 1000) // c ELSE 0 END / 1000.0 * 45 + CASE WHEN pg > 0 THEN (greatest(coalesce(power_growth, 0), 0) * 1000) // pg ELSE 0 END / 1000.0 * 30
  + CASE WHEN f > 0 THEN (greatest(fort, 0) * 1000) // f ELSE 0 END / 1000.0 * 15 + CASE WHEN k > 0 THEN (greatest(coalesce(kp_growth, 0), 0) * 1000) // k ELSE 0 END / 1000.0 * 10, 3) AS score FROM sc JOIN mx USING (period))"""


@query("w9_performance", PERFORMANCE_SQL + "SELECT period, player, CAST(round(score * 1000) AS BIGINT) AS score_milli FROM perf")
def performance(spark, d):
    return activity.performance(scored(spark, d)).select("period", "player", F.round(F.col("score") * 1000).cast("long").alias("score_milli"))


@query("w10_movement", PERFORMANCE_SQL + """, mv AS (SELECT c.period, c.player, round(c.score - q.score, 1) AS delta FROM perf c JOIN periods USING (period) JOIN perf q ON q.period = periods.previous AND q.player = c.player), cp AS (SELECT period, count(*) AS compared FROM mv GROUP BY 1),
rk AS (SELECT *, 'up' AS side, row_number() OVER (PARTITION BY period ORDER BY delta DESC, player) AS place FROM mv WHERE delta > 0 UNION ALL SELECT *, 'down', row_number() OVER (PARTITION BY period ORDER BY delta, player) FROM mv WHERE delta < 0)
SELECT period, player, CAST(round(delta * 10) AS BIGINT) AS delta_tenths, side, place, compared FROM rk JOIN cp USING (period) WHERE place <= 4""")
def movement(spark, d):
    s = activity.performance(scored(spark, d)).select("period", "player", "score")
    return activity.movement(s, periods(spark, d)).select("period", "player", F.round(F.col("delta") * 10).cast("long").alias("delta_tenths"), "side", "place", "compared")


@query("w16_history", PERFORMANCE_SQL + """, h AS (SELECT *, dense_rank() OVER (PARTITION BY player ORDER BY period DESC) AS back FROM perf), k AS (SELECT * FROM h WHERE back <= 3)
SELECT period, player, back, CAST(round(CASE WHEN max(score) OVER (PARTITION BY player) > 0 THEN score / max(score) OVER (PARTITION BY player) ELSE 0 END, 4) * 10000 AS BIGINT) AS of_best FROM k""")
def history(spark, d):
    s = activity.performance(scored(spark, d)).select("period", "player", "score")
    return activity.history(s, 3).select("period", "player", "back", F.round(F.col("of_best") * 10000).cast("long").alias("of_best"))


@query("j11_period_of", WEEKLY_SQL + "SELECT id, period FROM obs")
def period_of(spark, d):
    p = periods(spark, d).withColumn("ends_at", F.col("starts_at") + F.expr("interval 7 days"))
    return activity.period_of(r.observations(spark, d).drop("period"), p).select("id", "period")


#: Weeks of three workspaces, each with a reset of its own; of one some weeks are there already, twice.
WEEKS_SQL = """, wk AS (SELECT id, player % 3 AS ws, observed_at AS ts, CASE player % 3 WHEN 0 THEN 0 WHEN 1 THEN 180 ELSE -330 END AS m, CASE WHEN id % 4 = 0 THEN 'linked' END AS linked, CASE WHEN id % 6 = 0 THEN 'job' END AS job FROM obs),
wx AS (SELECT *, strftime(ts + INTERVAL 1 MINUTE * m, '%G-W%V') AS week_key, date_trunc('week', ts + INTERVAL 1 MINUTE * m) - INTERVAL 1 MINUTE * m AS starts_at FROM wk)"""


def week_rows(spark, d):
    i, ws = F.col("id"), F.col("player") % 3
    rows = r.observations(spark, d).select("id", ws.alias("ws"), F.col("observed_at").cast("timestamp").alias("at"), F.when(i % 4 == 0, "linked").alias("linked_event"), F.when(i % 6 == 0, "job").alias("job_event"))
    settings = spark.createDataFrame([(0, "3:00"), (1, "+03:00"), (2, "-05:30")], "ws bigint, offset string")
    held = spark.createDataFrame([(0, "old", "2024-W02", "2024-01-01"), (0, "newer", "2024-W02", "2024-01-02"), (0, "other", "2023-W50", "2024-01-02")], "ws bigint, event string, week_key string, at string")
    none = F.lit(None).cast("timestamp")
    events = held.select("ws", "event", "week_key", F.lit("n").alias("name"), F.lit("d").alias("description"), none.alias("starts_at"), none.alias("ends_at"), F.col("at").cast("timestamp").alias("created_at"), F.lit(False).alias("auto"))
    return rows, settings, events


@query("j11_missing_weeks", WEEKS_SQL + " SELECT DISTINCT ws, ws || ':' || week_key AS event, week_key, 'Weekly Activity ' || week_key || ' (' || strftime(starts_at, '%b %-d') || ')' AS name, strftime(starts_at, '%Y-%m-%d %H:%M') AS starts_at FROM wx WHERE NOT (ws = 0 AND week_key = '2024-W02')")
def missing_weeks(spark, d):
    """Ensured twice; the second run makes no week again."""
    rows, settings, events = week_rows(spark, d)
    path = scratch(spark, "events")
    events.write.parquet(path)
    for day in ("2024-02-01", "2024-02-02"):
        held = upkeep.ensure_weeks(spark, path, rows, settings, F.lit(day))
    return held.filter("auto").select("ws", "event", "week_key", "name", F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("starts_at"))


@query("j11_row_events", WEEKS_SQL + " SELECT id, coalesce(linked, job, CASE WHEN ws = 0 AND week_key = '2024-W02' THEN 'newer' ELSE ws || ':' || week_key END) AS event FROM wx")
def row_events(spark, d):
    rows, settings, events = week_rows(spark, d)
    held = events.unionByName(upkeep.missing_weeks(rows, events, settings, F.lit("2024-02-01")))
    return upkeep.with_event(rows, held, settings).select("id", "event")


@query("w5_current_observations", " SELECT period, player, metric, arg_max(value, row(observed_at, value, ref)) AS value, arg_max(ref, row(observed_at, value, ref)) AS ref FROM obs GROUP BY 1, 2, 3")
def current(spark, d):
    return observations.current(r.observations(spark, d)).select("period", "player", "metric", "value", "ref")


@query("st7_arrival_decisions", """, a AS (SELECT *, (id * 7919) % 100003 AS arrival FROM obs), b AS (SELECT *, max(row(observed_at, value, ref)) OVER (PARTITION BY period, player, metric ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM a)
SELECT id, CASE WHEN best IS NULL THEN 'created' WHEN best < row(observed_at, value, ref) THEN 'updated' WHEN best = row(observed_at, value, ref) THEN 'equal-precedence' ELSE 'existing-is-newer' END AS decision FROM b""")
def arrivals(spark, d):
    o = r.observations(spark, d).withColumn("arrival", F.col("id") * 7919 % 100003)
    return observations.decisions(o).select("id", "decision")


@query("w7_directory", """, l AS (SELECT player, period, metric, arg_max(value, row(observed_at, value)) AS value FROM obs WHERE period IN ('2024-W02', '2024-W03') GROUP BY 1, 2, 3)
SELECT player, string_agg(metric || '=' || value, ',' ORDER BY metric) FILTER (period = '2024-W03') AS now, string_agg(metric || '=' || value, ',' ORDER BY metric) FILTER (period = '2024-W02') AS before FROM l GROUP BY 1""")
def directory(spark, d):
    out = observations.directory(r.observations(spark, d), "2024-W03", "2024-W02")
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
    return out.select("player", text("now").alias("now"), text("before").alias("before"))


@query("a14_coverage", ", s AS (SELECT metric, CASE WHEN id % 3 = 0 THEN 'profile' ELSE 'rankboard' END AS source FROM obs) SELECT metric, source, count(*) AS n FROM s GROUP BY CUBE (metric, source)")
def coverage(spark, d):
    return observations.coverage(r.observations(spark, d).withColumn("source", F.when(F.col("id") % 3 == 0, "profile").otherwise("rankboard")))


DELTA_SQL = """, dl AS (SELECT player, "at", lag(power) OVER w * 1000 AS start_power, t4 - lag(t4) OVER w AS t4, t5 - lag(t5) OVER w AS t5, deads - lag(deads) OVER w AS deads, (power - lag(power) OVER w) * 100 AS power_delta FROM snaps WINDOW w AS (PARTITION BY player ORDER BY "at")),
c AS (SELECT *, CAST(start_power AS DOUBLE) * 0.3 + CAST(start_power AS DOUBLE) * 0.02 * 5.0 AS want, t4 * 1.0::DOUBLE + t5 * 2.0::DOUBLE + deads * 5.0::DOUBLE AS got FROM dl WHERE start_power IS NOT NULL),
w AS (SELECT *, least(floor(CASE WHEN want > 0 THEN got / want * 100 WHEN got > 0 THEN 100 ELSE 0 END * 10 + 0.5) / 10, 120.0) AS score FROM c),
x AS (SELECT *, power_delta < -2000000 AND got < 100000 AS deadweight FROM w),
ws AS (SELECT *, CASE WHEN deadweight THEN 'Inactive' WHEN score >= 100 THEN 'War Legend' WHEN score >= 80 THEN 'Elite Warrior' WHEN score >= 50 THEN 'Frontline Fighter' WHEN score >= 20 THEN 'Support Role' ELSE 'Inactive' END AS tier FROM x)
"""


def score_rows(spark, d):
    w = Window.partitionBy("player").orderBy("at")
    s = r.snapshots(spark, d)
    dl = s.select("player", "at", (F.lag("power").over(w) * 1000).alias("start_power"), *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in ("t4", "t5", "deads")], ((F.col("power") - F.lag("power").over(w)) * 100).alias("power_delta"))
    return scores.contribution_scores(dl.filter("start_power is not null"), ["at"])


@query("w8_contribution_scores", DELTA_SQL + 'SELECT player, "at", CAST(floor(want + 0.5) AS BIGINT) AS expected, CAST(floor(got + 0.5) AS BIGINT) AS actual, CAST(round(score * 10) AS BIGINT) AS score_tenths, deadweight, tier, row_number() OVER (PARTITION BY "at" ORDER BY score DESC, player) AS place FROM ws')
def contribution(spark, d):
    return score_rows(spark, d).select("player", "at", "expected", "actual", F.round(F.col("score") * 10).cast("long").alias("score_tenths"), "deadweight", "tier", "place")


@query("a25_tiers", DELTA_SQL + 'SELECT tier, count(*) AS n FROM ws GROUP BY 1')
def tiers(spark, d):
    return scores.tier_counts(score_rows(spark, d))


@query("n1_comparison_anomalies", """, p AS (SELECT *, lag(power) OVER w AS ap, kp - lag(kp) OVER w AS dk, t4 - lag(t4) OVER w AS d4, t5 - lag(t5) OVER w AS d5, deads - lag(deads) OVER w AS dd FROM snaps WINDOW w AS (PARTITION BY player ORDER BY "at"))
SELECT player, "at", 'KP_NEGATIVE_DELTA' AS code, 'ERROR' AS severity, CAST(dk AS VARCHAR) AS context FROM p WHERE dk < 0
UNION ALL SELECT player, "at", 'DEADS_NEGATIVE_DELTA', 'ERROR', CAST(dd AS VARCHAR) FROM p WHERE dd < 0
UNION ALL SELECT player, "at", 'KILLS_NEGATIVE_DELTA', 'ERROR', d4 || ',' || d5 FROM p WHERE d4 < 0 OR d5 < 0
UNION ALL SELECT player, "at", 'POWER_DROP_GT_50', 'WARNING', ap || ',' || power FROM p WHERE ap > 0 AND CAST(power AS DOUBLE) / ap < 0.5
UNION ALL SELECT player, "at", 'KP_HIGH_WITHOUT_T4T5', 'WARNING', CAST(dk AS VARCHAR) FROM p WHERE dk > 100000000 AND d4 = 0 AND d5 = 0""")
def comparison(spark, d):
    return scores.comparison_anomalies(r.snapshots(spark, d)).select("player", "at", "code", "severity", "context")


@query("n2_snapshot_anomalies", """ SELECT player, "at", 'POWER_ZERO_OR_NEGATIVE' AS code, CAST(power AS VARCHAR) AS context FROM snaps WHERE power <= 0
UNION ALL SELECT player, "at", 'KILLS_EXCEED_KP', kp || ',' || (t4 + t5) FROM snaps WHERE kp > 0 AND t4 + t5 > kp UNION ALL SELECT player, "at", 'DEADS_GT_POWER', deads || ',' || power FROM snaps WHERE deads > power""")
def snapshot(spark, d):
    return scores.snapshot_anomalies(r.snapshots(spark, d)).select("player", "at", "code", "context")


@query("j8_timeline", ' SELECT player, "at", row_number() OVER (PARTITION BY player ORDER BY "at") AS place, power - lag(power) OVER (PARTITION BY player ORDER BY "at") AS power_change FROM snaps')
def timeline(spark, d):
    from boardlake.operators.quality import timeline as run

    s = r.snapshots(spark, d).withColumnRenamed("at", "event")
    return run(s, periods(spark, d).select(F.col("period").alias("event"), F.col("starts_at").alias("at"))).select("player", F.col("event").alias("at"), "place", "power_change")


@query("a1_weekly_resets", " SELECT period, player, coalesce(max(CASE metric WHEN 'contribution_points' THEN value END), 0) AS contribution, coalesce(max(CASE metric WHEN 'fort_destroying' THEN value END), 0) AS fort FROM obs GROUP BY 1, 2")
def resets(spark, d):
    known = r.observations(spark, d).select("period", "player").distinct()
    return metrics(spark, d).join(known, ["period", "player"], "left_semi").select("period", "player", "contribution", "fort")


@query("a2_progressive_metrics", WEEKLY_SQL + "SELECT period, player, kp, power FROM m")
def progressive(spark, d):
    return metrics(spark, d).select("period", "player", "kp", "power")


@query("j4_growth", WEEKLY_SQL + "SELECT period, player, power_growth, kp_growth FROM g")
def grown(spark, d):
    return activity.growth(metrics(spark, d), periods(spark, d)).select("period", "player", "power_growth", "kp_growth")


@query("a3_statuses", WEEKLY_SQL + "SELECT s1 AS contribution, s2 AS fort, s3 AS power_growth, s4 AS kp_growth, overall, count(*) AS n FROM sc GROUP BY ALL")
def statuses(spark, d):
    keys = [F.col(f"status_{m}").alias(m) for m in activity.METRICS]
    return scored(spark, d).groupBy(*keys, "overall").agg(F.count("*").alias("n"))


@query("j9_standards", WEEKLY_SQL + "SELECT player, min_contribution, min_fort, min_power_growth, min_kp_growth FROM players JOIN std USING (alliance)")
def with_standards(spark, d):
    zero = r.players(spark, d).select("player", "alliance", *[F.lit(0).cast("long").alias(m) for m in activity.METRICS])
    return activity.scored(zero, standards(spark, d)).select("player", *[f"min_{m}" for m in activity.METRICS])
