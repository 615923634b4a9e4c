"""Queries over leaderboards, captures and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.functions import hashing, text
from boardlake.operators import dedupe, guards, ops, ranking, reconcile
from boardlake.plans import registry as r
from boardlake.plans.registry import query
from boardlake.sources import buckets as bucketed
from boardlake.sources import sinks
from boardlake.sources.scratch import scratch, written

RANKED_SQL = """, a AS (SELECT * FROM board WHERE status = 'ACTIVE'), f AS (SELECT *, lag(value) OVER w AS pv, lag(source_rank) OVER w AS pr FROM a WINDOW w AS (PARTITION BY type ORDER BY value DESC, source_rank NULLS LAST, name, id)),
ranked AS (SELECT *, row_number() OVER w AS stable_index, rank() OVER (PARTITION BY type ORDER BY value DESC) AS display_rank,
  CAST(1 + sum(CASE WHEN pv IS NOT NULL AND (pv <> value OR (pr IS NOT NULL AND pr IS DISTINCT FROM source_rank)) THEN 1 ELSE 0 END) OVER (PARTITION BY type ORDER BY value DESC, source_rank NULLS LAST, name, id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS tie_group FROM f WINDOW w AS (PARTITION BY type ORDER BY value DESC, source_rank NULLS LAST, name, id))"""


def ranked(spark, d):
    return ranking.stable_ranking(r.boards(spark, d).filter("status = 'ACTIVE'"), ["type"])


@query("w1_stable_ranking", RANKED_SQL + " SELECT id, type, stable_index, display_rank, tie_group FROM ranked")
def stable(spark, d):
    return ranked(spark, d).select("id", "type", "stable_index", "display_rank", "tie_group")


@query("t1_page", RANKED_SQL + ", c AS (SELECT type, stable_index AS s FROM ranked WHERE id = 1001) SELECT id, type, stable_index FROM ranked LEFT JOIN c USING (type) WHERE stable_index > coalesce(s, 0) AND stable_index <= coalesce(s, 0) + 50")
def page(spark, d):
    return ranking.page_after(ranked(spark, d), ["type"], 1001, 50).select("id", "type", "stable_index")


@query("w2_tie_flag", RANKED_SQL + " SELECT id, count(*) OVER (PARTITION BY type, tie_group) > 1 AS is_tie FROM ranked WHERE stable_index <= 200")
def ties(spark, d):
    return ranking.with_tie_flag(ranked(spark, d).filter("stable_index <= 200"), ["type"]).select("id", "is_tie")


@query("w3_all_time_latest", " SELECT type, metric, identity, id, value FROM (SELECT *, row_number() OVER (PARTITION BY type, metric, identity ORDER BY updated_at DESC, created_at DESC, value DESC, id DESC) AS n FROM board) WHERE n = 1")
def latest(spark, d):
    return ranking.all_time_latest(r.boards(spark, d)).select("type", "metric", "identity", "id", "value")


@query("w4_merged_power", " SELECT identity, id, type, value FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY CASE type WHEN '1-URGENT' THEN 2 ELSE 1 END DESC, updated_at DESC, value DESC, id DESC) AS n FROM board WHERE type IN ('1-URGENT', '2-HIGH')) WHERE n = 1")
def merged(spark, d):
    return ranking.merged_power(r.boards(spark, d), "1-URGENT", "2-HIGH", ["identity"]).select("identity", "id", "type", "value")


@query("f1_filtered", " SELECT b.id FROM board b JOIN players p ON b.identity = p.player WHERE status IN ('ACTIVE', 'UNRESOLVED') AND type IN ('1-URGENT', '5-LOW') AND (lower(alliance) LIKE '%nation_1%' OR lower(alliance) LIKE '%nation_7%') AND (lower(b.name) LIKE '%p1%' OR CAST(identity AS VARCHAR) LIKE '%1%')")
def filtered(spark, d):
    b = r.boards(spark, d).join(r.players(spark, d).select(F.col("player").alias("identity"), "alliance"), "identity")
    return ranking.filtered(b, ["ACTIVE", "UNRESOLVED"], ["1-URGENT", "5-LOW"], "power", ["nation_1", "NATION_7"], "P1").select("id")


@query("j1_enriched", " SELECT b.id, p.name AS player_name, p.alliance FROM board b LEFT JOIN players p ON b.identity = p.player")
def enriched(spark, d):
    p = r.players(spark, d).select(F.col("player").alias("identity"), F.col("name").alias("player_name"), "alliance")
    return r.boards(spark, d).join(p, "identity", "left").select("id", "player_name", "alliance")


@query("j7_absent_players", " SELECT player, metric, max(value) AS value FROM obs o WHERE metric = 'power' AND NOT EXISTS (SELECT 1 FROM board b WHERE b.identity = o.player AND b.type = '1-URGENT' AND status = 'ACTIVE') GROUP BY 1, 2")
def absent(spark, d):
    o = r.observations(spark, d).filter("metric = 'power'").groupBy("player", "metric").agg(F.max("value").alias("value"))
    b = r.boards(spark, d).filter("type = '1-URGENT' and status = 'ACTIVE'").select(F.col("identity").alias("player"), "metric")
    return ranking.absent_players(o, b, ["player", "metric"])


@query("j2_members", " SELECT player FROM players WHERE player IN (SELECT player FROM obs) OR player IN (SELECT identity FROM board WHERE status = 'REJECTED')")
def members(spark, d):
    b = r.boards(spark, d).filter("status = 'REJECTED'").select(F.col("identity").alias("player"))
    return ops.members(r.players(spark, d), r.observations(spark, d), b).select("player")


@query("a7_status_counts", " SELECT status, count(*) AS n FROM board GROUP BY 1")
def status_counts(spark, d):
    return ranking.status_counts(r.boards(spark, d))


@query("a7_board_counts", " SELECT type, metric, count(*) AS n, strftime(max(updated_at), '%Y-%m-%d') AS last_update FROM board GROUP BY 1, 2 ORDER BY n DESC, type, metric LIMIT 25")
def board_counts(spark, d):
    return ranking.board_counts(r.boards(spark, d)).withColumn("last_update", F.date_format("last_update", "yyyy-MM-dd"))


@query("a8_distribution", " SELECT type, metric, count(*) AS n, min(value) AS low, max(value) AS high, CAST(sum(value) // count(*) AS BIGINT) AS mean, CAST(sum(value) AS VARCHAR) AS total FROM board GROUP BY 1, 2")
def distribution(spark, d):
    return ranking.distribution(r.boards(spark, d))


@query("a9_top_buckets", ", k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY value DESC, id) AS n FROM board) SELECT type, " + ", ".join(f"count(*) FILTER (n <= {k}) AS n_{k}, CAST(sum(value) FILTER (n <= {k}) AS BIGINT) AS total_{k}, CAST(sum(value) FILTER (n <= {k}) // count(*) FILTER (n <= {k}) AS BIGINT) AS mean_{k}" for k in (100, 200, 400)) + " FROM k GROUP BY 1")
def buckets(spark, d):
    return ranking.top_buckets(r.boards(spark, d), ["type"])


@query("a10_totals_by_label", " SELECT label, count(p.player) AS n, CAST(coalesce(sum(power), 0) AS BIGINT) AS total FROM (SELECT n_name AS label FROM nation) LEFT JOIN players p ON lower(p.alliance) LIKE '%' || replace(lower(label), '_', '\\_') || '%' ESCAPE '\\' GROUP BY 1")
def by_label(spark, d):
    return ranking.totals_by_label(r.players(spark, d).withColumnRenamed("power", "value"), r.t(spark, d, "nation").select(F.col("n_name").alias("label")))


@query("a11_review_summary", " SELECT type, metric, count(*) AS n FROM board WHERE status IN ('UNRESOLVED', 'REJECTED') GROUP BY GROUPING SETS ((type, metric), ())")
def review_summary(spark, d):
    return ranking.review_summary(r.boards(spark, d), ["UNRESOLVED", "REJECTED"])


@query("a12_review_groups", " SELECT identity AS run, count(*) FILTER (status = 'ACTIVE') AS n_active, count(*) FILTER (status = 'UNRESOLVED') AS n_unresolved, count(*) FILTER (status = 'REJECTED') AS n_rejected, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY coalesce(source_rank, 1073741824), id) AS ids FROM board GROUP BY 1")
def review_groups(spark, d):
    return ranking.review_groups(r.boards(spark, d).withColumnRenamed("identity", "run"), ["ACTIVE", "UNRESOLVED", "REJECTED"])


#: The rows of a key replayed one by one, as a state machine: (run, row, status) of what stands.
MERGE_SQL = """, wx AS (SELECT id, type, identity, status, created_at AS run, TIMESTAMP '2000-01-01' - INTERVAL 1 DAY * (id % 97) AS upd, row_number() OVER (PARTITION BY type, identity ORDER BY id) AS n FROM board),
wm AS (SELECT id, type, identity, n, run AS s_run, upd AS s_upd, status AS s_status, 'created' AS decision FROM wx WHERE n = 1
  UNION ALL SELECT x.id, x.type, x.identity, x.n, CASE WHEN ok THEN x.run ELSE s_run END, CASE WHEN ok THEN x.upd ELSE s_upd END, CASE WHEN ok THEN x.status ELSE s_status END,
    CASE WHEN s_run > x.run THEN 'existing-run-is-newer' WHEN s_run = x.run AND s_upd > x.upd THEN 'existing-row-is-newer' WHEN NOT ok THEN 'non-active-row-cannot-overwrite-active' ELSE 'updated' END
  FROM (SELECT x.*, s_run, s_upd, s_status, NOT (s_run > x.run) AND NOT (s_run = x.run AND s_upd > x.upd) AND NOT (s_status = 'ACTIVE' AND x.status <> 'ACTIVE') AS ok FROM wm JOIN wx x ON x.type = wm.type AND x.identity = wm.identity AND x.n = wm.n + 1) x)"""


@query("w6_merge_decisions", MERGE_SQL + " SELECT id, decision FROM wm")
def merge(spark, d):
    crossed = F.timestamp_add("DAY", -(F.col("id") % 97).cast("int"), F.lit("2000-01-01").cast("timestamp"))
    return ranking.merge_decisions(r.boards(spark, d).withColumn("updated_at", crossed), ["type", "identity"]).select("id", "decision")


#: Runs are months of a type, and come in by month of the year, so that older runs follow newer ones; those of February have no event.
RECONCILED_SQL = """, rx AS (SELECT id, type || strftime(created_at, '%Y-%m') AS run, created_at AS run_at, CAST(month(created_at) AS BIGINT) AS arrival, CASE WHEN month(created_at) <> 2 THEN 'e' || (year(created_at) % 2) END AS event, type, CASE WHEN identity % 4 > 0 THEN 'power' ELSE 'contribution_points' END AS metric,
  CASE WHEN identity % 3 > 0 THEN identity END AS player, name, source_rank, value, status, TIMESTAMP '2000-01-01' - INTERVAL 1 DAY * (id % 97) AS upd FROM board),
ry AS (SELECT *, coalesce('gov:' || player, 'name:' || name) AS key, CASE WHEN event IS NULL THEN 'none' WHEN player IS NOT NULL AND metric = 'power' THEN 'observation' ELSE 'board' END AS route FROM rx),
rz AS (SELECT *, row_number() OVER (PARTITION BY event, type, key ORDER BY arrival, run, upd, id) AS n FROM ry WHERE route = 'board'),
rm AS (SELECT id, run, event, type, key, n, id AS s_id, run AS s_run, run_at AS s_at, upd AS s_upd, status AS s_status, value AS s_value, 'created' AS decision FROM rz WHERE n = 1
  UNION ALL SELECT x.id, x.run, x.event, x.type, x.key, x.n, CASE WHEN ok THEN x.id ELSE s_id END, CASE WHEN ok THEN x.run ELSE s_run END, CASE WHEN ok THEN x.run_at ELSE s_at END, CASE WHEN ok THEN x.upd ELSE s_upd END, CASE WHEN ok THEN x.status ELSE s_status END, CASE WHEN ok THEN x.value ELSE s_value END,
    CASE WHEN s_at > x.run_at THEN 'existing-run-is-newer' WHEN s_at = x.run_at AND s_upd > x.upd THEN 'existing-row-is-newer' WHEN NOT ok THEN 'non-active-row-cannot-overwrite-active' ELSE 'updated' END
  FROM (SELECT x.*, s_id, s_run, s_at, s_upd, s_status, s_value, NOT (s_at > x.run_at) AND NOT (s_at = x.run_at AND s_upd > x.upd) AND NOT (s_status = 'ACTIVE' AND x.status <> 'ACTIVE') AS ok FROM rm JOIN rz x ON x.event = rm.event AND x.type = rm.type AND x.key = rm.key AND x.n = rm.n + 1) x),
ro AS (SELECT event, player, metric, arg_max(value, row(upd, value, CAST(id AS VARCHAR))) AS value, arg_max(name, row(arrival, run, upd, id)) AS name FROM ry WHERE route = 'observation' GROUP BY ALL),
rd AS (SELECT run, id, decision FROM rm UNION ALL SELECT run, id, CASE route WHEN 'none' THEN 'missing-event' ELSE route END FROM ry WHERE route <> 'board')"""


def capture_rows(spark, d):
    b, month = r.boards(spark, d), F.month("created_at")
    player = F.when(F.col("identity") % 3 > 0, F.col("identity"))
    event = F.when(month != 2, F.concat(F.lit("e"), F.year("created_at") % 2))
    crossed = F.timestamp_add("DAY", -(F.col("id") % 97).cast("int"), F.lit("2000-01-01").cast("timestamp"))
    metric = F.when(F.col("identity") % 4 > 0, "power").otherwise("contribution_points")
    return b.select("id", F.concat("type", F.date_format("created_at", "yyyy-MM")).alias("run"), F.col("created_at").alias("run_at"), month.cast("long").alias("arrival"), event.alias("event"), "type", metric.alias("metric"), player.alias("player"), "name", F.col("name").alias("name_key"), "source_rank", "value", F.col("status").alias("identity_status"), crossed.alias("updated_at"))


def reconciled(spark, d):
    """In two instalments, the second of which goes on from the tables that the first one left."""
    rows = capture_rows(spark, d)
    first, second = rows.filter("arrival <= 6"), rows.filter("arrival > 6")
    one = reconcile.reconcile(first)
    stored = written(one[2], "observed"), written(one[1], "snapshots")
    one = (one[0], stored[1], stored[0], one[3])
    two = reconcile.reconcile(second, one[1], one[2])
    return one, two


@query("w6_reconciled_decisions", RECONCILED_SQL + " SELECT id, run, decision FROM rd")
def reconciled_decisions(spark, d):
    one, two = reconciled(spark, d)
    return one[0].unionByName(two[0])


@query("w6_reconciled_state", RECONCILED_SQL + """ SELECT event, type, key AS identity_key, s_value AS value, s_status AS status, s_run AS last_run, s_id AS last_row FROM (SELECT *, row_number() OVER (PARTITION BY event, type, key ORDER BY n DESC) AS back FROM rm) WHERE back = 1
UNION ALL SELECT event, 'individual_power', 'gov:' || player, value, 'ACTIVE', NULL, NULL FROM ro""")
def reconciled_state(spark, d):
    return reconciled(spark, d)[1][1].select("event", "type", "identity_key", "value", "status", "last_run", "last_row")


@query("w6_reconciled_runs", RECONCILED_SQL + """, rc AS (SELECT run, count(*) FILTER (decision IN ('created', 'updated', 'observation')) AS merged, count(*) FILTER (decision NOT IN ('created', 'updated', 'observation')) AS skipped FROM rd GROUP BY 1)
SELECT run, merged, skipped, merged AS revisions, count(*) FILTER (status = 'UNRESOLVED') AS unresolved, count(*) FILTER (status = 'REJECTED') AS rejected, CASE WHEN max(event) IS NULL OR count(*) FILTER (status = 'UNRESOLVED') > 0 THEN 'REVIEW' ELSE 'MERGED' END AS status FROM ry JOIN rc USING (run) GROUP BY run, merged, skipped""")
def reconciled_runs(spark, d):
    one, two = reconciled(spark, d)
    return one[3].unionByName(two[3])


@query("w17_latest_revisions", " SELECT identity, id, place FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY created_at DESC, id DESC) AS place FROM board) WHERE place <= 3")
def revisions(spark, d):
    return ranking.latest_revisions(r.boards(spark, d), "identity", 3).select("identity", "id", "place")


@query("s4_upsert", ", n AS (SELECT identity, type, id, value, updated_at, 1 AS fresh FROM board WHERE id % 2 = 1 UNION ALL SELECT identity, type, id, value, updated_at, 0 FROM board WHERE id % 2 = 0) SELECT identity, type, id, value FROM (SELECT *, row_number() OVER (PARTITION BY identity, type ORDER BY updated_at DESC, value DESC, fresh DESC) AS k FROM n) WHERE k = 1")
def upsert(spark, d):
    b = r.boards(spark, d).select("identity", "type", "id", "value", "updated_at")
    return sinks.upserted(b.filter("id % 2 = 0"), b.filter("id % 2 = 1"), ["identity", "type"], ["updated_at", "value"]).select("identity", "type", "id", "value")


@query("s4_bucketed_upsert", ", n AS (SELECT identity, type, id, value, updated_at, 1 AS fresh FROM board WHERE id % 2 = 1 UNION ALL SELECT identity, type, id, value, updated_at, 0 FROM board WHERE id % 2 = 0) SELECT identity, type, id, value FROM (SELECT *, row_number() OVER (PARTITION BY identity, type ORDER BY updated_at DESC, value DESC, fresh DESC) AS k FROM n) WHERE k = 1")
def bucketed_upsert(spark, d):
    """In place, in two upserts."""
    b, path = r.boards(spark, d).select("identity", "type", "id", "value", "updated_at"), scratch(spark, "buckets")
    for part in ("id % 2 = 0", "id % 2 = 1"):
        bucketed.upsert(b.filter(part), path, ["identity", "type"], ["updated_at", "value"])
    return bucketed.read(spark, path, b.schema).select("identity", "type", "id", "value")


@query("s5_change_log", """, o AS (SELECT identity, max(value) AS value FROM board WHERE id % 2 = 0 GROUP BY 1), n AS (SELECT identity, max(value) AS value FROM board WHERE id % 3 > 0 GROUP BY 1)
SELECT identity, '{"value":' || o.value || '}' AS previous, '{"value":' || n.value || '}' AS next, CASE WHEN o.value IS NULL THEN 'created' WHEN n.value IS NULL THEN 'deleted' ELSE 'updated' END AS action FROM o FULL JOIN n USING (identity) WHERE o.value IS DISTINCT FROM n.value""")
def change_log(spark, d):
    b = r.boards(spark, d)
    best = lambda c: b.filter(c).groupBy("identity").agg(F.max("value").alias("value"))
    return sinks.change_log(best("id % 2 = 0"), best("id % 3 > 0"), ["identity"])


GUARD_SQL = """, g0 AS (SELECT *, CASE WHEN regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') IN ('', 'KILLPOINTS') THEN 'header-row-artifact' WHEN NOT regexp_matches(metric_raw, '[0-9]') THEN 'metric-no-raw-digit' WHEN length(digits) < 6 THEN 'metric-too-short' END AS r0 FROM captured),
guarded AS (SELECT *, coalesce(r0, CASE WHEN row_number() OVER (PARTITION BY run, coalesce(source_rank, 0), name, digits, r0 IS NULL ORDER BY pos) > 1 THEN 'duplicate' END) AS drop_reason FROM g0)"""


def guarded(spark, d):
    return guards.row_guard(r.captured(spark, d), F.lit(6))


@query("f3_row_guard", GUARD_SQL + " SELECT run, pos, drop_reason FROM guarded")
def row_guard(spark, d):
    return guarded(spark, d).select("run", "pos", "drop_reason")


UNIFORM_SQL = ", u0 AS (SELECT run, value, count(*) AS n FROM src GROUP BY 1, 2), u AS (SELECT run, sum(n) AS total, arg_max(value, row(n, -value)) AS dominant, max(n) AS m FROM u0 GROUP BY 1)"


@query("a16_uniformity", ", src AS (SELECT run, value // 1000000 AS value FROM captured)" + UNIFORM_SQL + " SELECT run, dominant, m AS dominant_count, CAST(round(m / total, 6) * 1000000 AS BIGINT) AS ratio_ppm, total >= 4 AND m >= 4 AND m / total >= 0.8 AS suspicious FROM u")
def uniformity(spark, d):
    u = guards.uniformity(r.captured(spark, d).select("run", F.expr("value div 1000000").alias("value")))
    return u.select("run", "dominant", "dominant_count", F.round(F.col("dominant_ratio") * 1000000).cast("long").alias("ratio_ppm"), "suspicious")


@query("f4_run_guard", GUARD_SQL + ", src AS (SELECT run, CAST(digits AS BIGINT) AS value FROM guarded WHERE drop_reason IS NULL)" + UNIFORM_SQL + """, c AS (SELECT run, count(*) AS n_rows, count(*) FILTER (drop_reason IS NULL) AS n_kept, count(*) FILTER (drop_reason = 'header-row-artifact') AS h FROM guarded GROUP BY 1)
SELECT run, n_rows, n_kept, concat_ws(',', CASE WHEN n_kept < 3 THEN 'insufficient-valid-rows' END, CASE WHEN n_kept < 3 AND h > 0 THEN 'header-row-artifact' END, CASE WHEN n_kept >= 3 AND coalesce(total >= 4 AND m >= 4 AND m / total >= 0.8, false) THEN 'uniform-metric-suspect' END) AS failures FROM c LEFT JOIN u USING (run)""")
def run_guard(spark, d):
    return guards.run_guard(guarded(spark, d))


@query("f5_sync_safety", ' SELECT player, "at", CASE WHEN power <= 0 THEN \'power is zero or missing\' ELSE \'\' END AS reasons FROM snaps')
def safety(spark, d):
    return r.snapshots(spark, d).select("player", "at", guards.sync_safety(F.col("power"), F.col("kp")).alias("reasons"))


@query("a17_digit_plausibility", """, x AS (SELECT run, pos, confidence, length(CASE WHEN pos % 3 = 0 THEN substr(digits, 1, 4) ELSE digits END) AS n FROM captured), y AS (SELECT run, list_sort(list(n) FILTER (n > 0)) AS ns FROM x GROUP BY 1), z AS (SELECT run, coalesce(ns[len(ns) // 2 + 1], 0) AS baseline FROM y)
SELECT run, pos, baseline, n > 0 AND abs(n - baseline) > 1 AS outlier, greatest(0, confidence - CASE WHEN n > 0 AND abs(n - baseline) > 1 THEN 8 ELSE 0 END) AS confidence FROM x JOIN z USING (run)""")
def plausibility(spark, d):
    c = r.captured(spark, d).withColumn("digits", F.when(F.col("pos") % 3 == 0, F.substring("digits", 1, 4)).otherwise(F.col("digits")))
    return guards.digit_plausibility(c).select("run", "pos", "baseline", "outlier", "confidence")


@query("a18_repeated_values", """, x AS (SELECT id, identity % 50 AS job, CASE WHEN id % 11 = 0 THEN -1234 ELSE value // 10000000 + 999 END AS kp, CASE WHEN id % 5 = 0 THEN 0 ELSE id % 3 END AS power, status = 'ACTIVE' AS ok FROM board),
p AS (SELECT id, kp, power, (SELECT count(*) FROM x o WHERE o.ok AND o.job = x.job AND o.kp = x.kp AND o.id <> x.id) AS same_kp, (SELECT count(*) FROM x o WHERE o.ok AND o.job = x.job AND o.kp = x.kp AND o.power = x.power AND o.id <> x.id) AS same_pair FROM x)
SELECT id, same_kp AS kp_peers, (kp > 0 AND length(CAST(kp AS VARCHAR)) >= 4 AND same_kp >= 2) OR (power <= 0 AND same_pair >= 2) AS skip_sync FROM p""")
def repeated(spark, d):
    i = F.col("id")
    status = F.when(F.col("status") == "ACTIVE", "APPROVED").otherwise(F.col("status"))
    b = r.boards(spark, d).select("id", (F.col("identity") % 50).alias("job"), status.alias("status"), F.when(i % 11 == 0, -1234).otherwise(F.expr("value div 10000000 + 999")).alias("kp"), F.when(i % 5 == 0, 0).otherwise(i % 3).alias("power"))
    return guards.repeated_values(b).select("id", "kp_peers", "skip_sync")


@query("w12_rank_repair", """, x AS (SELECT run, pos, confidence, source_rank - 2 AS rank, row_number() OVER (PARTITION BY run ORDER BY pos) - 1 AS i FROM captured), a AS (SELECT run, arg_min(rank, i) AS rank, min(i) AS i FROM x WHERE rank > 0 GROUP BY 1),
y AS (SELECT x.run, x.pos, x.confidence, x.rank, CAST(greatest(1, coalesce(a.rank - a.i, 1)) + x.i AS INTEGER) AS want FROM x LEFT JOIN a USING (run))
SELECT run, pos, want AS repaired_rank, want IS DISTINCT FROM rank AS corrected, greatest(0, confidence - CASE WHEN want IS DISTINCT FROM rank THEN 5 ELSE 0 END) AS confidence FROM y""")
def rank_repair(spark, d):
    return guards.rank_repair(r.captured(spark, d).withColumn("source_rank", F.col("source_rank") - 2)).select("run", "pos", "repaired_rank", "corrected", "confidence")


@query("w13_monotonic_guard", """, x AS (SELECT *, lag(value) OVER w AS pv, lead(value) OVER w AS nv FROM captured WINDOW w AS (PARTITION BY run ORDER BY pos)), y AS (SELECT *, coalesce(value > pv, false) AS violation FROM x), z AS (SELECT *, sum(CAST(violation AS INTEGER)) OVER (PARTITION BY run) AS nviol FROM y),
cd AS (SELECT run, pos, unnest([{'v': value // 10, 's': 0.4, 'c': 60}, {'v': value // 2, 's': 0.9, 'c': 80}, {'v': pv, 's': 0.9, 'c': 70}]) AS c FROM z),
best AS (SELECT z.run, z.pos, arg_max(c, row(c.s, c.c)) AS b FROM cd JOIN z ON z.run = cd.run AND z.pos = cd.pos WHERE violation AND nviol = 1 AND c.v <= pv AND (nv IS NULL OR c.v >= nv) AND length(CAST(c.v AS VARCHAR)) >= 6 GROUP BY 1, 2)
SELECT run, pos, violation, coalesce(b.v, value) AS fixed, CASE WHEN b IS NOT NULL THEN least(100, (confidence + b.c) / 2) ELSE greatest(0, confidence - CASE WHEN violation THEN 7 ELSE 0 END) END AS confidence FROM z LEFT JOIN best USING (run, pos)""")
def monotonic(spark, d):
    c = r.captured(spark, d)
    prev = F.lag("value").over(Window.partitionBy("run").orderBy("pos"))
    one = lambda v, s, k: F.struct(v.alias("value"), F.lit(s).alias("score"), F.lit(k).cast("double").alias("confidence"))
    c = c.withColumn("candidates", F.array(one(F.expr("value div 10"), 0.4, 60), one(F.expr("value div 2"), 0.9, 80), one(prev, 0.9, 70)))
    return guards.monotonic_guard(c, 6).select("run", "pos", "violation", "fixed", "confidence")


@query("p17_row_hash", """ SELECT run, pos, sha256('{"governorNameRaw":"' || name || '","metricKey":"power","metricRaw":"' || metric_raw || '","rankingType":"individual_power","sourceRank":' || coalesce(CAST(source_rank AS VARCHAR), 'null') || '}') AS row_hash FROM captured""")
def row_hash(spark, d):
    return r.captured(spark, d).select("run", "pos", hashing.row_hash(F.col("source_rank"), F.col("name"), F.col("metric_raw"), F.lit("individual_power"), F.lit("power")).alias("row_hash"))


@query("p18_run_hash", " SELECT run, sha256(string_agg(metric_raw, ',' ORDER BY pos)) AS run_hash FROM captured GROUP BY 1")
def run_hash(spark, d):
    return r.captured(spark, d).groupBy("run").agg(hashing.ordered_hash(F.col("pos"), F.col("metric_raw")).alias("run_hash"))


@query("p19_identity_key", " SELECT id, CASE WHEN id % 3 = 0 THEN 'name:' || name ELSE 'gov:' || identity END AS identity_key FROM board")
def identity_key(spark, d):
    b = r.boards(spark, d)
    return b.select("id", text.identity_key(F.when(F.col("id") % 3 != 0, F.col("identity").cast("string")), F.col("name")).alias("identity_key"))


@query("u2_exact_duplicates", " SELECT id AS run, lag(id) OVER (PARTITION BY identity, type ORDER BY created_at, id) AS duplicate_of FROM board")
def exact(spark, d):
    b = r.boards(spark, d).withColumnRenamed("id", "run")
    return dedupe.exact_duplicates(b, ["identity", "type"]).select("run", "duplicate_of")


@query("u3_near_duplicates", r""", dn AS (SELECT doc_id AS run, lang AS board, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS s FROM documents),
p AS (SELECT a.run AS run, b.run AS other, b.nth AS n0, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) AS same, len(a.s) AS x, len(b.s) AS y FROM dn a JOIN dn b ON a.board = b.board AND a.nth - b.nth BETWEEN 1 AND 8),
q AS (SELECT *, same / (x + y - same) AS j, row_number() OVER (PARTITION BY run ORDER BY same / (x + y - same) DESC, n0 DESC) AS k FROM p WHERE same / (x + y - same) >= 0.9)
SELECT run, other, CAST(round(j * 1000000) AS BIGINT) AS similarity_ppm FROM q WHERE k = 1""")
def near(spark, d):
    docs = r.t(spark, d, "documents")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    items = docs.select(F.col("doc_id").alias("run"), F.explode(words).alias("item"))
    runs = docs.select(F.col("doc_id").alias("run"), F.col("lang").alias("board"), F.col("doc_id").alias("created_at"))
    return dedupe.near_duplicates(items, runs).select("run", "other", F.round(F.col("similarity") * 1000000).cast("long").alias("similarity_ppm"))
