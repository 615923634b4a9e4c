"""Queries over extractions, identities, retrieval and operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlake.functions import vectorized
from boardlake.operators import identity, ops, quality, retrieval, upkeep
from boardlake.plans import registry as r
from boardlake.plans.registry import query
from boardlake.sources.scratch import scratch

EXT_SQL = """, ext AS (SELECT event_id AS id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, user_id, event_type, ts AS created_at, CASE event_id % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'PENDING' END AS status, value FROM events)"""


def extractions(spark, d):
    """Events as extractions: k of their JSON is the confidence, fields are made from their numbers."""
    e = r.t(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    status = F.when(F.col("event_id") % 4 == 0, "APPROVED").when(F.col("event_id") % 4 == 1, "REJECTED").otherwise("PENDING")
    return e.select(F.col("event_id").alias("id"), k.alias("k"), "user_id", "event_type", F.col("ts").alias("created_at"), status.alias("status"), "value")


@query("s2_parsed_fields", EXT_SQL + """ SELECT id, CAST(user_id AS VARCHAR) AS player_text, CASE WHEN id % 2 = 0 THEN CAST(k * 1000 AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS power, CAST(CASE WHEN id % 2 = 0 THEN k WHEN k <= 1 THEN k * 100 ELSE k END AS DOUBLE) AS power_conf FROM ext""")
def parsed(spark, d):
    e = extractions(spark, d)
    obj = F.concat(F.lit('{"power":{"value":"'), (F.col("k") * 1000).cast("string"), F.lit('","confidence":'), (F.col("k") / 100).cast("string"), F.lit("}}"))
    flat = F.concat(F.lit('{"power":"'), F.col("k").cast("string"), F.lit('"}'))
    rows = e.select("id", F.when(F.col("id") % 2 == 0, obj).alias("normalized"), flat.alias("fields"), F.col("user_id").cast("string").alias("governor_id_raw"), F.lit(None).cast("string").alias("governor_name_raw"), F.col("k").cast("double").alias("confidence"))
    return quality.parsed_fields(rows).select("id", F.col("governorId").alias("player_text"), "power", F.round("power_conf", 6).alias("power_conf"))


FIELD_SQL = EXT_SQL + """, fields AS (SELECT id, CAST(100000 + user_id AS VARCHAR) AS "governorId", CASE WHEN k % 7 = 0 THEN '' ELSE CAST(k * 40000 AS VARCHAR) END AS power, CAST(k * 90000000 AS VARCHAR) AS "killPoints", CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k * 30000000 AS VARCHAR) END AS "t4Kills", CAST(k AS VARCHAR) AS "t5Kills", '1' || k AS deads FROM (SELECT id, user_id, CAST(k AS BIGINT) AS k FROM ext)),
lng AS (UNPIVOT fields ON "governorId", power, "killPoints", "t4Kills", "t5Kills", deads INTO NAME field VALUE value)"""


def fields(spark, d):
    k = F.col("k").cast("long")
    s = lambda c: c.cast("string")
    return extractions(spark, d).select("id", s(100000 + F.col("user_id")).alias("governorId"), F.when(k % 7 == 0, "").otherwise(s(k * 40000)).alias("power"), s(k * 90000000).alias("killPoints"), F.when(k % 3 == 0, "").otherwise(s(k * 30000000)).alias("t4Kills"), s(k).alias("t5Kills"), F.concat(F.lit("1"), s(k)).alias("deads"))


CHECK_SQL = FIELD_SQL + """, chk AS (SELECT id, field, value, CASE WHEN field = 'governorId' THEN 'ok' WHEN value = '' THEN CASE WHEN field IN ('power', 'killPoints') THEN 'error' ELSE 'ok' END WHEN field = 'power' AND CAST(value AS BIGINT) <= 0 THEN 'error'
  WHEN CAST(value AS BIGINT) < CASE WHEN field = 'power' THEN 100000 ELSE 0 END OR CAST(value AS BIGINT) > CASE field WHEN 'power' THEN 3000000000 WHEN 'killPoints' THEN 5000000000 ELSE 2000000000 END THEN 'warning' ELSE 'ok' END AS severity FROM lng)"""


@query("n3_field_checks", CHECK_SQL + """, nm AS (SELECT id, CASE id % 4 WHEN 0 THEN 'Lord ' || id WHEN 1 THEN '  ' WHEN 2 THEN repeat('x', 41) ELSE 'Ł' || id END AS name FROM ext),
kp AS (SELECT id, CAST(coalesce(nullif("killPoints", ''), '0') AS BIGINT) < CAST(coalesce(nullif("t4Kills", ''), '0') AS BIGINT) + CAST(coalesce(nullif("t5Kills", ''), '0') AS BIGINT) AS less FROM fields)
SELECT id, field, CASE WHEN field = 'killPoints' AND less THEN 'warning' ELSE severity END AS severity, CASE WHEN field = 'killPoints' AND less THEN 'Kill points less than T4+T5 sum — check values' END AS cross_warning FROM chk JOIN kp USING (id)
UNION ALL SELECT id, 'name', CASE WHEN id % 4 = 0 THEN 'ok' ELSE 'warning' END, CASE id % 4 WHEN 1 THEN 'Name is empty' WHEN 2 THEN 'Name seems too long' WHEN 3 THEN 'Name contains unsupported characters for English-only OCR mode' END FROM nm""")
def checks(spark, d):
    k = F.col("id") % 4
    name = F.when(k == 0, F.concat(F.lit("Lord "), F.col("id").cast("string"))).when(k == 1, "  ").when(k == 2, "x" * 41).otherwise(F.concat(F.lit("Ł"), F.col("id").cast("string")))
    out = quality.field_checks(fields(spark, d).withColumn("name", name))
    shown = F.when(F.col("field") == "name", F.col("warning")).when(F.col("warning").startswith("Kill points less"), F.col("warning"))
    return out.select("id", "field", "severity", shown.alias("cross_warning"))


@query("n4_severity", CHECK_SQL + """, c AS (SELECT id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM chk GROUP BY 1), v AS (SELECT ext.id, status, k, e, w, ext.id % 10 = 0 AS low, CASE ext.id % 4 WHEN 0 THEN 'blur, crop, glare' WHEN 1 THEN 'blur' END AS f FROM ext JOIN c ON c.id = ext.id)
SELECT id, CASE WHEN status = 'REJECTED' THEN 'LOW' WHEN low OR e > 0 OR k < 55 THEN 'HIGH' WHEN w > 0 OR k < 75 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN status = 'REJECTED' THEN 'Marked as rejected.' ELSE concat_ws('|', CASE WHEN low THEN 'Engine marked this extraction as low-confidence.' END, 'OCR failure reasons: ' || f || '.', CASE WHEN k < 55 THEN 'Very low confidence field (' || k || '%).' WHEN k < 75 THEN 'Low confidence field (' || k || '%).' END,
    CASE WHEN e > 0 THEN e || ' validation error(s).' END, CASE WHEN w > 0 THEN w || ' validation warning(s).' END, CASE WHEN NOT low AND e = 0 AND w = 0 AND k >= 75 THEN 'OCR confidence and validation are healthy.' END) END AS reasons FROM v""")
def severities(spark, d):
    c = quality.field_checks(fields(spark, d), cross=False).groupBy("id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    some = F.when(F.col("id") % 4 == 0, F.array(*map(F.lit, ("blur", "crop", "glare", "tilt")))).when(F.col("id") % 4 == 1, F.array(F.lit("blur")))
    own = [F.col("status"), F.col("id") % 10 == 0, F.col("k"), F.col("e"), F.col("w")]
    return extractions(spark, d).join(c, "id").select("id", quality.severity(*own).alias("severity"), F.array_join(quality.severity_reasons(*own, some), "|").alias("reasons"))


@query("p25_limit_problems", FIELD_SQL + """, lim AS (SELECT *, length(value) AS n FROM lng) SELECT id, field, CASE WHEN value = '' THEN 'missing-digits' WHEN n < CASE field WHEN 'governorId' THEN 6 WHEN 'power' THEN 5 ELSE 1 END THEN 'digits-too-short' WHEN n > CASE field WHEN 'governorId' THEN 12 WHEN 'power' THEN 11 WHEN 'killPoints' THEN 11 ELSE 10 END THEN 'digits-too-long'
  WHEN CAST(value AS BIGINT) < CASE WHEN field IN ('power', 'governorId') THEN 100000 ELSE 0 END THEN 'below-range' ELSE 'above-range' END AS reason FROM lim WHERE value = '' OR n < CASE field WHEN 'governorId' THEN 6 WHEN 'power' THEN 5 ELSE 1 END OR n > CASE field WHEN 'governorId' THEN 12 WHEN 'power' THEN 11 WHEN 'killPoints' THEN 11 ELSE 10 END
  OR CAST(value AS BIGINT) < CASE WHEN field IN ('power', 'governorId') THEN 100000 ELSE 0 END OR CAST(value AS BIGINT) > CASE field WHEN 'governorId' THEN 999999999999 WHEN 'power' THEN 3000000000 WHEN 'killPoints' THEN 5000000000 ELSE 2000000000 END""")
def limits(spark, d):
    return quality.limit_problems(fields(spark, d))


@query("n5_approved_payload", FIELD_SQL + """ SELECT id, "governorId" AS player, coalesce(TRY_CAST(nullif(power, '') AS BIGINT), 0) AS power, CAST("killPoints" AS BIGINT) AS kp, coalesce(TRY_CAST(nullif("t4Kills", '') AS BIGINT), 0) AS t4 FROM fields""")
def payload(spark, d):
    return quality.approved_payload(fields(spark, d).withColumn("governorName", F.lit(" x "))).select("id", "player", "power", "kp", "t4")


@query("p27_combat_cleanup", EXT_SQL + """, a AS (SELECT id, k, CAST(k AS BIGINT) * 100 AS t4, CASE WHEN id % 11 = 0 THEN 1234567890123 ELSE CAST(k AS BIGINT) END AS t5, CASE WHEN id % 3 = 0 THEN CAST(k AS BIGINT) * 500 ELSE 7 END AS deads, CAST(k AS BIGINT) * 20 AS kp, CAST(k AS BIGINT) * 100 AS power FROM ext),
b AS (SELECT *, k < 75 AND t4 > 0 AS l4, t5 > 999999999999 AS d5 FROM a), c AS (SELECT id, k, kp, power, deads, l4, d5, CASE WHEN l4 THEN 0 ELSE t4 END AS t4, CASE WHEN d5 THEN 0 ELSE t5 END AS t5 FROM b), e AS (SELECT *, kp > 0 AND t4 + t5 > kp * 3 AS ov, power > 0 AND deads > power * 2 AS dd FROM c)
SELECT id, CASE WHEN ov THEN 0 ELSE t4 END AS t4, CASE WHEN ov THEN 0 ELSE t5 END AS t5, CASE WHEN dd THEN 0 ELSE deads END AS deads, concat_ws('|', CASE WHEN l4 THEN 't4Kills reset to 0 (low confidence ' || k || '%)' END, CASE WHEN d5 THEN 't5Kills reset to 0 (implausible digit length)' END, CASE WHEN ov THEN 't4/t5 reset to 0 (implausible vs kill points)' END, CASE WHEN dd THEN 'deads reset to 0 (implausible vs power)' END) AS notes FROM e""")
def cleanup(spark, d):
    k = F.col("k").cast("long")
    t5 = F.when(F.col("id") % 11 == 0, F.lit(1234567890123)).otherwise(k)
    e = extractions(spark, d).select("id", (k * 100).alias("t4"), t5.alias("t5"), F.when(F.col("id") % 3 == 0, k * 500).otherwise(7).alias("deads"), (k * 20).alias("kp"), (k * 100).alias("power"), k.alias("t4_conf"), F.lit(90).alias("t5_conf"), F.lit(90).alias("deads_conf"))
    return quality.combat_cleanup(e).select("id", "t4", "t5", "deads", F.array_join("notes", "|").alias("notes"))


A13_SQL = EXT_SQL + """, e AS (SELECT *, k < 50 AS low FROM ext WHERE created_at >= TIMESTAMP '2024-01-05'), c AS (SELECT doc_id AS id FROM labels WHERE quality = 0)"""


@query("a13_quality", A13_SQL + """ SELECT total, reviewed, approved, rejected, low AS low_confidence, corrections, corrected, CAST(round(approved / total, 6) * 1000000 AS BIGINT) AS approval_ppm, CAST(round(low / total, 6) * 1000000 AS BIGINT) AS low_ppm, CAST(round(corrections / total, 6) * 1000000 AS BIGINT) AS edit_ppm
FROM (SELECT count(*) AS total, count(*) FILTER (status IN ('REVIEWED', 'APPROVED', 'REJECTED')) AS reviewed, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (low) AS low FROM e), (SELECT count(*) AS corrections, count(DISTINCT id) AS corrected FROM c)""")
def figures(spark, d):
    e = extractions(spark, d).withColumnRenamed("event_type", "profile").withColumn("low_confidence", F.col("k") < 50)
    c = r.t(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"), F.lit("2025-01-01").cast("timestamp").alias("created_at"))
    ppm = lambda c, n: F.round(F.col(c) * 1000000).cast("long").alias(n)
    return quality.quality_figures(e, c, F.lit("2024-01-05").cast("timestamp")).select("total", "reviewed", "approved", "rejected", "low_confidence", "corrections", "corrected", ppm("approval_rate", "approval_ppm"), ppm("low_confidence_rate", "low_ppm"), ppm("edit_rate", "edit_ppm"))


@query("a13_profiles", A13_SQL + " SELECT CASE WHEN event_type = 'error' THEN 'unassigned' ELSE event_type END AS profile, count(*) AS total, count(*) FILTER (low) AS low_confidence, CAST(round(count(*) FILTER (low) / count(*), 6) * 1000000 AS BIGINT) AS low_ppm FROM e GROUP BY 1")
def profile_quality(spark, d):
    e = extractions(spark, d).withColumns({"profile": F.nullif("event_type", F.lit("error")), "low_confidence": F.col("k") < 50})
    return quality.profile_figures(e, F.lit("2024-01-05").cast("timestamp")).select("profile", "total", "low_confidence", F.round(F.col("low_confidence_rate") * 1000000).cast("long").alias("low_ppm"))


@query("a13_corrections_by", EXT_SQL + """, c AS (SELECT id % 500 AS id, event_type AS field, CASE WHEN status = 'RAW' THEN 'unspecified' ELSE status END AS reason FROM ext)
SELECT 'field' AS by, field AS value, count(*) AS n, count(DISTINCT id) AS extractions FROM c GROUP BY 2 UNION ALL SELECT 'reason', reason, count(*), count(DISTINCT id) FROM c GROUP BY 2""")
def corrections(spark, d):
    e = extractions(spark, d)
    return quality.corrections_by(e.select((F.col("id") % 500).alias("id"), F.col("event_type").alias("field"), F.nullif("status", F.lit("RAW")).alias("reason")))


#: Of a user's fields the ``k``-th tenth mismatches; digits alone are equal in every second of these.
GOLDEN_SQL = EXT_SQL + """, g AS (SELECT user_id AS "case", k % 10 > 0 AS ok, k % 10 > 0 OR k % 20 = 0 AS digits, k, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 40 END AS least, event_type <> 'error' AS num FROM ext WHERE user_id % 2 = 1 OR k % 10 > 0),
pc AS (SELECT "case", count(*) FILTER (NOT ok) AS mismatches, count(*) FILTER (ok AND k < least) AS low, avg(k) < 50 AS low_mean, avg(k) AS mean FROM g GROUP BY 1)"""


def golden_cases(spark, d):
    e, k = extractions(spark, d).filter("user_id % 2 = 1 or k % 10 > 0"), F.col("k")
    actual = F.when(k % 10 > 0, " a B1 ").when(k % 20 == 0, "c1").otherwise("c2")
    return e.select(F.col("user_id").alias("case"), F.col("event_type").alias("field"), F.lit("AB 1").alias("expected"), actual.alias("actual"), k.cast("double").alias("confidence"), F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(40.0).alias("least"), F.lit(50.0).alias("least_mean"), (F.col("event_type") != "error").alias("numeric"))


@query("a19_golden", GOLDEN_SQL + """ SELECT "case", mismatches, low, low_mean, CAST(round(round(mean, 4) * 10000) AS BIGINT) AS confidence, mismatches = 0 AND low = 0 AND NOT low_mean AS passed FROM pc""")
def golden(spark, d):
    return quality.golden(golden_cases(spark, d)).withColumn("confidence", F.round(F.col("confidence") * 10000).cast("long"))


@query("a19_golden_suite", GOLDEN_SQL + """ SELECT count(*) AS total, count(*) FILTER (mismatches = 0 AND low = 0 AND NOT low_mean) AS passed, count(*) FILTER (NOT (mismatches = 0 AND low = 0 AND NOT low_mean)) AS failed, any_value(nt) AS numeric_total, any_value(ne) AS numeric_exact, any_value(round(ne / nt, 6)) AS numeric_rate, any_value(ne / nt >= 0.98) AS numeric_passed
FROM pc, (SELECT count(*) FILTER (num) AS nt, count(*) FILTER (num AND digits) AS ne FROM g)""")
def golden_suite(spark, d):
    return quality.golden_suite(golden_cases(spark, d))


@query("t3_queue_page", EXT_SQL + " SELECT id FROM (SELECT *, row_number() OVER (ORDER BY k, id) AS p FROM ext WHERE status = 'PENDING') WHERE p > 100 AND p <= 150")
def queue(spark, d):
    e = extractions(spark, d).select("id", "created_at", F.col("k").alias("confidence"), F.col("status").alias("severity"))
    return quality.queue_page(e, "PENDING", "confidence", 100, 50).select("id")


@query("j10_review_queue", FIELD_SQL + """, y AS (SELECT f.*, e.status, CASE WHEN e.id % 6 > 0 THEN strftime(created_at, '%G-W%V') END AS event, user_id, CASE WHEN e.id % 2 = 0 THEN p.name ELSE 'other' END AS nm, p.name, p.player FROM fields f JOIN ext e USING (id) LEFT JOIN players p ON p.player = 100000 + user_id - CASE WHEN e.id % 3 = 0 THEN 0 ELSE 100000 END),
bl AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' ELSE 'DONE' END AS ss FROM events WHERE event_id % 5 = 0),
z AS (SELECT y.*, s.power AS sp, s.kp AS sk, s.t4 AS s4, s.t5 AS s5, s.deads AS sd, ss FROM y LEFT JOIN snaps s ON s.player = y.player AND s."at" = y.event LEFT JOIN bl USING (id))
SELECT id, CAST(sp AS VARCHAR) AS previous_power, concat_ws(',', CASE WHEN name <> nm THEN 'governorName' END, CASE WHEN CAST(sp AS VARCHAR) <> power THEN 'power' END, CASE WHEN CAST(sk AS VARCHAR) <> "killPoints" THEN 'killPoints' END, CASE WHEN CAST(s4 AS VARCHAR) <> "t4Kills" THEN 't4Kills' END, CASE WHEN CAST(s5 AS VARCHAR) <> "t5Kills" THEN 't5Kills' END, CASE WHEN CAST(sd AS VARCHAR) <> deads THEN 'deads' END) AS changed,
  CASE WHEN status = 'APPROVED' THEN CASE WHEN coalesce(ss IN ('PENDING', 'FAILED'), false) OR event IS NULL THEN 'PENDING_WEEK_LINK' ELSE 'SYNCED' END END AS sync_state, coalesce(CASE WHEN ss IS NOT NULL AND id % 2 = 0 THEN 'w' END, event) AS linked_event, CASE WHEN ss IN ('PENDING', 'FAILED') THEN 'e' || id END AS sync_message FROM z""")
def review(spark, d):
    e = extractions(spark, d).withColumn("ts", F.col("created_at")).select("id", "status", "user_id", F.when(F.col("id") % 6 > 0, r.period()).alias("event"))
    p = r.players(spark, d)
    mine = F.when(F.col("id") % 3 == 0, 100000 + F.col("user_id")).otherwise(F.col("user_id"))
    named = e.withColumn("_mine", mine).join(p.select(F.col("player").alias("_mine"), F.col("name").alias("_name")), "_mine", "left")
    rows = fields(spark, d).drop("governorId").join(named, "id").withColumn("governorId", F.col("_mine").cast("string")).withColumn("governorName", F.when(F.col("id") % 2 == 0, F.col("_name")).otherwise("other")).drop("_name", "_mine", "user_id")
    k = F.col("event_id")
    status = F.when(k % 4 == 0, "PENDING").when(k % 4 == 1, "FAILED").otherwise("DONE")
    backlog = r.t(spark, d, "events").filter("event_id % 5 = 0").select(k.alias("id"), F.when(k % 2 == 0, "w").alias("linked_event"), status.alias("sync_status"), F.concat(F.lit("e"), k.cast("string")).alias("last_error"))
    out = quality.review_queue(rows, p, r.snapshots(spark, d).withColumnRenamed("at", "event"), backlog)
    return out.select("id", F.col("previous.power").alias("previous_power"), "changed", "sync_state", "linked_event", "sync_message")


@query("n5_repaired_ids", """, pl AS (SELECT CAST(n_nationkey * 50000 + 10000 AS VARCHAR) AS player, CASE WHEN n_nationkey % 5 = 0 THEN 'Twin' ELSE n_name END AS name, CASE WHEN n_nationkey % 7 = 0 THEN 'unknown' ELSE lower(CASE WHEN n_nationkey % 5 = 0 THEN 'Twin' ELSE n_name END) END AS k FROM nation),
x AS (SELECT p_partkey AS id, CAST(CASE p_partkey % 3 WHEN 0 THEN p_partkey % 900 WHEN 1 THEN 500000 + p_partkey ELSE (p_partkey % 25) * 50000 + 10000 END AS VARCHAR) AS player, upper(CASE WHEN p_partkey % 25 % 5 = 0 THEN 'Twin' ELSE n_name END) AS name, CASE WHEN p_partkey % 25 % 7 = 0 THEN 'unknown' ELSE lower(CASE WHEN p_partkey % 25 % 5 = 0 THEN 'Twin' ELSE n_name END) END AS k FROM part JOIN nation ON n_nationkey = p_partkey % 25),
y AS (SELECT x.*, length(x.player) BETWEEN 6 AND 12 AS sound, (SELECT min(player) FROM pl WHERE lower(pl.name) = lower(x.name)) AS named, (SELECT count(*) FROM pl WHERE lower(pl.name) = lower(x.name) AND pl.k = x.k) AS c, (SELECT min(player) FROM pl WHERE lower(pl.name) = lower(x.name) AND pl.k = x.k) AS sole, x.player IN (SELECT player FROM pl) AS has FROM x)
SELECT id, CASE WHEN NOT sound THEN CASE WHEN length(named) BETWEEN 6 AND 12 THEN named END WHEN NOT has AND c = 1 AND length(sole) BETWEEN 6 AND 12 AND k <> 'unknown' THEN sole ELSE player END AS player, CASE WHEN NOT sound THEN CASE WHEN length(named) BETWEEN 6 AND 12 THEN 'by-name' ELSE 'invalid' END WHEN NOT has AND c = 1 AND length(sole) BETWEEN 6 AND 12 AND k <> 'unknown' THEN 'by-alias' ELSE 'kept' END AS repair FROM y""")
def repaired(spark, d):
    n, k = F.col("n_nationkey"), F.col("p_partkey")
    name = F.when(n % 5 == 0, "Twin").otherwise(F.col("n_name"))
    key = F.when(n % 7 == 0, "unknown").otherwise(F.lower(name))
    nation = r.t(spark, d, "nation").select(n.alias("own"), (n * 50000 + 10000).cast("string").alias("player"), name.alias("name"), key.alias("alias_key"))
    text_ = F.when(k % 3 == 0, k % 900).when(k % 3 == 1, 500000 + k).otherwise(k % 25 * 50000 + 10000).cast("string")
    rows = r.t(spark, d, "part").select(k.alias("id"), text_.alias("player"), (k % 25).alias("own")).join(F.broadcast(nation.select("own", F.upper("name").alias("name"), "alias_key")), "own").drop("own")
    return quality.repaired_ids(rows, nation).select("id", "player", "repair")


READ_SQL = EXT_SQL + ", rs AS (SELECT id, CASE WHEN (status = 'RAW' AND k % 4 = 0) OR id % 6 = 0 THEN 'HIGH' WHEN k % 4 = 0 OR k < 70 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM ext)"


def read_rows(spark, d):
    failures = F.when(F.col("id") % 6 == 0, F.array(F.lit("blur"))).when(F.col("id") % 6 == 1, F.array().cast("array<string>"))
    e = extractions(spark, d).withColumn("failures", failures)
    return e.select("id", quality.read_severity(F.col("status"), F.col("k") % 4 == 0, F.col("failures"), F.col("k")).alias("severity"))


@query("n4_read_severity", READ_SQL + " SELECT id, severity FROM rs")
def read_severities(spark, d):
    return read_rows(spark, d)


@query("t3_queue_summary", READ_SQL + " SELECT count(*) AS total, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM rs")
def queue_summary(spark, d):
    return quality.queue_summary(read_rows(spark, d))


@query("a15_job_progress", EXT_SQL + """, t AS (SELECT user_id AS job, CASE WHEN user_id % 5 = 0 THEN 'COMPLETED' WHEN user_id % 5 = 1 THEN 'FAILED' WHEN user_id % 5 = 2 THEN 'QUEUED' ELSE CASE id % 3 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'COMPLETED' ELSE 'FAILED' END END AS s FROM ext WHERE id % 7 > 0),
g AS (SELECT job, count(*) AS total, count(*) FILTER (s IN ('COMPLETED', 'FAILED')) AS processed, count(*) FILTER (s = 'FAILED') AS failed FROM t GROUP BY 1), lo AS (SELECT user_id AS job, count(*) FILTER (k < 30) AS low FROM ext GROUP BY 1)
SELECT player AS job, coalesce(total, 0) AS total, coalesce(processed, 0) AS processed, coalesce(low, 0) AS low_confidence, CASE WHEN total IS NULL THEN 'QUEUED' WHEN processed < total THEN 'PROCESSING' WHEN failed = total THEN 'FAILED' ELSE 'REVIEW' END AS job_status FROM players LEFT JOIN g ON g.job = player LEFT JOIN lo ON lo.job = player""")
def progress(spark, d):
    e, j = extractions(spark, d).withColumnRenamed("user_id", "job"), F.col("job") % 5
    s = F.when(j == 0, "COMPLETED").when(j == 1, "FAILED").when(j == 2, "QUEUED").otherwise(F.when(F.col("id") % 3 == 0, "QUEUED").when(F.col("id") % 3 == 1, "COMPLETED").otherwise("FAILED"))
    jobs = r.players(spark, d).select(F.col("player").alias("job"))
    return ops.job_progress(e.filter("id % 7 > 0").select("job", s.alias("status")), jobs, e.select("job", (F.col("k") < 30).alias("low_confidence"))).select("job", "total", "processed", "low_confidence", "job_status")


@query("f6_retention", " SELECT id FROM board WHERE status IN ('ACTIVE', 'REJECTED') AND updated_at < TIMESTAMP '1998-01-01' - CASE WHEN type = '1-URGENT' THEN INTERVAL 30 DAY ELSE INTERVAL 180 DAY END")
def retention(spark, d):
    b = r.boards(spark, d).select("id", F.col("type").alias("ws"), "status", F.col("updated_at").alias("created_at"))
    settings = b.select("ws").distinct().filter("ws = '1-URGENT'").withColumn("days", F.lit(30))
    return ops.retention(b, settings, F.lit("1998-01-01").cast("timestamp"), ["ACTIVE", "REJECTED"]).select("id")


@query("a23_metering", """, q AS (SELECT id, player % 10 AS ws, strftime(observed_at, '%Y-%m') AS month, value % 3 > 0 AS ok, row_number() OVER (PARTITION BY player % 10, strftime(observed_at, '%Y-%m') ORDER BY observed_at, id) AS n FROM obs), cfg AS (SELECT n_nationkey AS ws, n_nationkey <> 4 AS enabled, CASE WHEN n_nationkey <> 7 THEN n_nationkey * 100 + 5 ELSE 0 END AS budget, 3 + n_nationkey % 2 AS cost FROM nation WHERE n_nationkey < 9),
oks AS (SELECT ws, month, n, row_number() OVER (PARTITION BY ws, month ORDER BY n) AS nth FROM q WHERE ok),
last AS (SELECT o.ws, o.month, o.n AS n, o.nth FROM oks o), cap AS (SELECT q.id, q.ws, q.ok, cfg.enabled, cfg.budget, cfg.cost, (SELECT max(nth) FROM last l WHERE l.ws = q.ws AND l.month = q.month AND l.n < q.n AND l.nth * cfg.cost <= cfg.budget) AS paid FROM q LEFT JOIN cfg USING (ws))
SELECT id, CAST(CASE WHEN enabled AND budget > 0 THEN coalesce(paid, 0) * cost ELSE 0 END AS BIGINT) AS spent, CASE WHEN NOT coalesce(enabled, false) THEN 'fallback-disabled' WHEN coalesce(budget, 0) <= 0 THEN 'monthly-budget-cap-zero' WHEN (coalesce(paid, 0) + 1) * cost > budget THEN 'monthly-budget-exceeded' WHEN NOT ok THEN 'provider-failed' ELSE 'ok' END AS reason FROM cap""")
def metering(spark, d):
    q = r.observations(spark, d).select("id", (F.col("player") % 10).alias("ws"), F.col("observed_at").alias("at"), (F.col("value") % 3 > 0).alias("ok"))
    k = F.col("n_nationkey").cast("long")
    settings = r.t(spark, d, "nation").filter("n_nationkey < 9").select(k.alias("ws"), (k != 4).alias("enabled"), F.when(k != 7, k * 100 + 5).otherwise(0).alias("budget"), (3 + k % 2).alias("cost"))
    return ops.metering(q, settings).select("id", "spent", "reason")


@query("j12_best_profile", """, im AS (SELECT p_partkey AS id, 800 + p_size * 30 AS width, 600 + p_size * 10 AS height FROM part), pf AS (SELECT 'n' || n_nationkey AS profile, n_nationkey AS place, CASE WHEN n_nationkey % 3 > 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'rankboard' ELSE 'governor-profile' END END AS archetype, CASE WHEN n_nationkey % 6 > 0 THEN 600 + n_nationkey * 70 END AS lo, 900 + n_nationkey * 70 AS hi, 1.2 + n_nationkey * 0.03 AS ra, CASE WHEN n_nationkey % 4 > 0 THEN 1.5 + n_nationkey * 0.03 END AS rb FROM nation),
j AS (SELECT id, width, profile, place, archetype, lo, hi, CAST(ra AS DOUBLE) AS ra, CAST(rb AS DOUBLE) AS rb, width / height AS ratio FROM im, pf),
s AS (SELECT id, profile, place, CASE WHEN lo IS NOT NULL AND width < lo THEN (lo - width) / lo + 0.2 ELSE 0 END + CASE WHEN width > hi THEN (width - hi) / hi + 0.2 ELSE 0 END + CASE WHEN ratio < ra THEN ra - ratio + 0.2 ELSE 0 END + CASE WHEN rb IS NOT NULL AND ratio > rb THEN ratio - rb + 0.2 ELSE 0 END
  + CASE WHEN lo IS NULL THEN 0 ELSE abs(width - (lo + hi) / 2) / ((lo + hi) / 2) * 0.05 END + CASE WHEN archetype IS NULL THEN 0 WHEN archetype = 'rankboard' THEN -0.08 ELSE 0.25 END AS penalty FROM j)
SELECT id, arg_min(profile, row(round(penalty, 9), place)) AS profile, CASE WHEN min(penalty) <= 0.06 THEN 'exact' ELSE 'nearest' END AS match FROM s GROUP BY 1""")
def profile(spark, d):
    n = F.col("n_nationkey")
    kind = F.when(n % 3 > 0, F.when(n % 2 == 0, "rankboard").otherwise("governor-profile"))
    pf = r.t(spark, d, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("profile"), n.alias("place"), kind.alias("archetype"), F.when(n % 6 > 0, 600 + n * 70).alias("min_width"), (900 + n * 70).alias("max_width"), (1.2 + n * 0.03).alias("min_aspect"), F.when(n % 4 > 0, 1.5 + n * 0.03).alias("max_aspect"))
    im = r.t(spark, d, "part").select(F.col("p_partkey").alias("id"), (800 + F.col("p_size") * 30).alias("width"), (600 + F.col("p_size") * 10).alias("height"))
    return ops.best_profile(im, pf, "rankboard").select("id", "profile", "match")


@query("j13_manifest_gaps", """, li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS pos FROM lineitem),
mf AS (SELECT l_orderkey AS job, pos, l_quantity > 10 AS done, l_quantity <= 10 AND (l_partkey % 3 = 0 OR l_partkey % 5 = 0) AS lost, CASE WHEN l_partkey % 5 = 0 THEN 'e' || l_partkey ELSE 'not-enqueued' END AS reason FROM li),
gg AS (SELECT job, count(*) FILTER (done) AS enqueued, count(*) FILTER (lost) AS lost, string_agg(pos || ':' || reason, ',' ORDER BY pos) FILTER (lost) AS entries, count(*) AS n FROM mf GROUP BY 1),
gx AS (SELECT *, greatest(n, 2) AS expected, CASE WHEN greatest(n, 2) > enqueued THEN greatest(greatest(n, 2) - enqueued, lost) ELSE 0 END AS missing FROM gg)
SELECT job, expected, enqueued, missing, CASE WHEN missing > 0 THEN coalesce(entries, '') ELSE '' END AS entries, CASE WHEN missing > 0 THEN 'FAILED' ELSE 'PROCESSING' END AS status FROM gx""")
def gaps(spark, d):
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"))
    li = r.t(spark, d, "lineitem").withColumn("place", pos)
    done, k = F.col("l_quantity") > 10, F.col("l_partkey")
    manifest = li.select(F.col("l_orderkey").alias("job"), "place", F.col("place").cast("string").alias("row"), F.lit("f").alias("file"), F.when(done, F.lit("t")).alias("task"), F.when(k % 3 == 0, "Failed").otherwise("new").alias("status"), F.when(k % 5 == 0, F.concat(F.lit("e"), k)).alias("error"))
    jobs = li.groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("total")).withColumns({"expected": F.lit(2), "status": F.lit("PROCESSING")})
    out = ops.manifest_gaps(jobs, manifest, li.filter(done).select(F.col("l_orderkey").alias("job")))
    return out.select("job", "expected", "enqueued", "missing", F.coalesce(F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["row"], e["reason"])), ","), F.lit("")).alias("entries"), "status")


@query("a20_child_counts", " SELECT player, (SELECT count(*) FROM board b WHERE b.identity = p.player) AS orders, (SELECT count(*) FROM obs o WHERE o.player = p.player) AS events FROM players p")
def children(spark, d):
    return ops.with_child_counts(r.players(spark, d).select("player"), "player", orders=r.boards(spark, d).select(F.col("identity").alias("player")), events=r.observations(spark, d).select("player"))


@query("a21_overview", """, jb AS (SELECT o_orderkey AS id, o_orderdate AS made, o_orderkey % 20 AS total, o_orderkey % 15 AS done FROM orders), lj AS (SELECT greatest(0, total - done) AS n FROM jb ORDER BY made DESC, id DESC LIMIT 8), c AS (SELECT (SELECT count(*) FROM players) AS players, (SELECT count(DISTINCT period) FROM obs) AS weeks, (SELECT count(*) FROM jb) AS jobs,
  (SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) AS profiles_pending, (SELECT count(*) FROM board WHERE status = 'UNRESOLVED') AS rows_pending, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS identities_pending, (SELECT CAST(sum(n) AS BIGINT) FROM lj) AS scan_backlog) SELECT *, scan_backlog + identities_pending AS queue_pressure FROM c""")
def overview(spark, d):
    k = F.col("o_orderkey")
    jobs = r.t(spark, d, "orders").select(k.alias("id"), F.col("o_orderdate").alias("created_at"), (k % 20).alias("total"), (k % 15).alias("processed"))
    e = r.t(spark, d, "events").select(F.when(F.col("event_type") == "click", "RAW").when(F.col("event_type") == "view", "REVIEWED").otherwise("APPROVED").alias("status"))
    waiting = r.t(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "PENDING").otherwise("DONE").alias("status"))
    return ops.overview(jobs, e, r.boards(spark, d), waiting, players=r.players(spark, d), weeks=r.observations(spark, d).select("period").distinct())


@query("a22_player_figures", """, wk AS (SELECT player, coalesce(max(CASE metric WHEN 'contribution_points' THEN value END), 0) AS c, coalesce(max(CASE metric WHEN 'fort_destroying' THEN value END), 0) AS f FROM obs WHERE period = '2024-W03' GROUP BY 1)
SELECT count(*) AS n, CAST(round(avg(power), 4) AS DOUBLE) AS mean_power, CAST(sum(power) AS BIGINT) AS total_power, CAST(coalesce(sum(c), 0) AS BIGINT) AS total_contribution, CAST(coalesce(sum(f), 0) AS BIGINT) AS total_fort, string_agg(DISTINCT alliance, ',' ORDER BY alliance) AS alliances FROM players LEFT JOIN wk USING (player)""")
def player_figures(spark, d):
    of = lambda m, c: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0)).alias(c)
    week = r.observations(spark, d).filter("period = '2024-W03'").groupBy("player").agg(of("contribution_points", "contribution"), of("fort_destroying", "fort"))
    return ops.player_figures(r.players(spark, d), week)


@query("u1_index_tasks", """, e AS (SELECT 'governor_identity' AS corpus, 'governor' AS entity_type, CAST(player AS VARCHAR) AS entity FROM players UNION SELECT 'events', 'event', period FROM obs UNION SELECT 'ocr_extractions', 'ocr_extraction', CAST(id AS VARCHAR) FROM obs UNION SELECT 'ranking', 'ranking_run', CAST(id AS VARCHAR) FROM board
UNION SELECT 'assistant_audit', 'assistant_plan', CAST(conv_id AS VARCHAR) FROM conversations UNION SELECT 'assistant_audit', 'assistant_pending_identity', CAST(doc_id AS VARCHAR) FROM documents) SELECT corpus, entity_type, count(*) AS n FROM e GROUP BY 1, 2""")
def tasks(spark, d):
    o = r.observations(spark, d)
    sets = {
        ("governor_identity", "governor"): r.players(spark, d).select("player"), ("events", "event"): o.select("period"), ("ocr_extractions", "ocr_extraction"): o.select("id"), ("ranking", "ranking_run"): r.boards(spark, d).select("id"),
        ("assistant_audit", "assistant_plan"): r.t(spark, d, "conversations").select("conv_id"), ("assistant_audit", "assistant_pending_identity"): r.t(spark, d, "documents").select("doc_id"),
    }
    return ops.index_tasks(sets).groupBy("corpus", "entity_type").agg(F.count("*").alias("n"))


@query("a24_index_status", """ SELECT (SELECT count(*) FROM documents) AS documents, (SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)) AS by_corpus, count(*) FILTER (status = 'ACTIVE') AS pending, 0 AS processing, count(*) FILTER (status = 'REJECTED') AS failed, count(*) FILTER (status = 'UNRESOLVED' AND updated_at >= TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR) AS completed_24h FROM board""")
def index_status(spark, d):
    s = F.when(F.col("status") == "ACTIVE", "PENDING").when(F.col("status") == "REJECTED", "FAILED").otherwise("COMPLETED")
    tasks = r.boards(spark, d).select(s.alias("status"), F.col("updated_at").alias("completed_at"))
    out = ops.index_status(r.t(spark, d, "documents").select(F.col("lang").alias("corpus")), tasks, F.lit("1998-06-01").cast("timestamp"))
    return out.withColumn("by_corpus", F.array_join(F.transform(F.map_entries("by_corpus"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("st6_retry_at", " SELECT id, strftime(updated_at + least(3600, CAST(pow(2, least(id % 16, 12)) AS INTEGER)) * INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS next_at, CASE WHEN id % 16 >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS status FROM board")
def retry(spark, d):
    n = (F.col("id") % 16).cast("int")
    return r.boards(spark, d).select("id", F.date_format(ops.retry_at(F.col("updated_at"), n), "yyyy-MM-dd HH:mm:ss").alias("next_at"), ops.failure_status(n).alias("status"))


@query("r2_chunks", r""", x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents), y AS (SELECT doc_id, s, unnest(range(0, CAST(ceil(length(s) / 1400.0) AS BIGINT))) AS i FROM x)
SELECT doc_id, CAST(i AS INTEGER) AS chunk, sha1(substr(s, i * 1400 + 1, 1400)) AS hash FROM y""")
def chunks(spark, d):
    return retrieval.chunks(r.t(spark, d, "documents")).select("doc_id", "chunk", "hash")


@query("r1_run_documents", """, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY source_rank NULLS LAST, value DESC, pos) AS n FROM captured), l AS (SELECT run, string_agg(coalesce(source_rank, n) || '. ' || name || ' | alliance=' || CASE WHEN pos % 2 = 0 THEN 'a' || pos ELSE '-' END || ' | metric=' || value || ' | status=' || CASE WHEN digits = '' THEN 'UNRESOLVED' ELSE 'AUTO_LINKED' END, chr(10) ORDER BY n) AS t FROM k WHERE n <= 240 GROUP BY 1)
SELECT o_orderkey AS run, sha1('Ranking Run ' || o_orderkey || chr(10) || 'Type: ' || o_orderpriority || chr(10) || 'Metric Key: power' || chr(10) || 'Header: ' || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE 'h' || o_orderkey END || chr(10) || 'Status: ' || o_orderstatus || coalesce(chr(10) || t, '')) AS hash FROM orders LEFT JOIN l ON run = o_orderkey""")
def run_documents(spark, d):
    c = r.captured(spark, d).select("run", F.col("source_rank").alias("rank"), F.col("pos").alias("id"), "name", "value", "metric_raw", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("a"), F.col("pos").cast("string"))).alias("alliance"), F.when(F.col("digits") == "", "UNRESOLVED").otherwise("AUTO_LINKED").alias("status"))
    k = F.col("o_orderkey")
    runs = r.t(spark, d, "orders").select(k.alias("run"), F.col("o_orderpriority").alias("type"), F.lit("power").alias("metric"), F.when(k % 3 > 0, F.concat(F.lit("h"), k.cast("string"))).alias("header"), F.col("o_orderstatus").alias("status"))
    return retrieval.run_documents(c, runs).select("run", F.sha1("content").alias("hash"))


@query("r1_player_documents", """, al AS (SELECT identity AS player, name || '#' || source_rank AS alias, created_at, row_number() OVER (PARTITION BY identity ORDER BY created_at, name || '#' || source_rank) AS n FROM board), a AS (SELECT player, string_agg(alias, ' | ' ORDER BY n) AS t FROM al WHERE n <= 120 AND alias IS NOT NULL GROUP BY 1)
SELECT p.player, sha1('Governor: ' || name || chr(10) || 'Governor ID: ' || p.player || chr(10) || 'Alliance: ' || alliance || chr(10) || 'Aliases: ' || coalesce(t, '-')) AS hash FROM players p LEFT JOIN a ON a.player = p.player""")
def player_documents(spark, d):
    al = r.boards(spark, d).select(F.col("identity").alias("player"), F.concat("name", F.lit("#"), F.col("source_rank").cast("string")).alias("alias"), "created_at")
    return retrieval.player_documents(r.players(spark, d), al).select("player", F.sha1("content").alias("hash"))


@query("r1_event_documents", """, w AS (SELECT period, min(date_trunc('week', observed_at)) AS s FROM obs GROUP BY 1) SELECT period AS event, 'Event: Week ' || period || chr(10) || 'Type: WEEKLY' || chr(10) || 'Description: -' || chr(10) || 'Week Key: ' || period || chr(10) || 'Closed: ' || CASE WHEN period < '2024-W03' THEN 'yes' ELSE 'no' END || chr(10) || 'Starts: ' || strftime(s, '%Y-%m-%dT%H:%M:%S.000Z') || chr(10) || 'Ends: -' AS content FROM w""")
def event_documents(spark, d):
    w = r.observations(spark, d).groupBy(F.col("period").alias("event")).agg(F.min(F.date_trunc("week", "observed_at")).alias("starts_at"))
    e = w.withColumns({"name": F.concat(F.lit("Week "), "event"), "type": F.lit("WEEKLY"), "description": F.lit(None).cast("string"), "week": F.col("event"), "closed": F.col("event") < "2024-W03", "ends_at": F.lit(None).cast("timestamp")})
    return retrieval.event_documents(e)


@query("r1_extraction_documents", EXT_SQL + """ SELECT id, sha1('OCR Extraction ' || id || chr(10) || 'Governor ID: ' || CASE WHEN id % 3 > 0 THEN CAST(user_id AS VARCHAR) ELSE '-' END || chr(10) || 'Governor Name: -' || chr(10) || 'Confidence: ' || k || chr(10) || 'Low confidence: ' || CASE WHEN k < 50 THEN 'yes' ELSE 'no' END || chr(10) || 'Engine: ' || event_type || CASE WHEN id % 2 = 0 THEN chr(10) || 'Normalized: {"k":' || k || '}' ELSE '' END || CASE WHEN id % 5 = 0 THEN chr(10) || 'Failure reasons: ["blur"]' ELSE '' END) AS hash FROM ext""")
def extraction_documents(spark, d):
    e, k = extractions(spark, d), F.col("k")
    e = e.select("id", F.when(F.col("id") % 3 > 0, F.col("user_id")).alias("player_raw"), F.lit("").alias("name_raw"), k.alias("confidence"), (k < 50).alias("low_confidence"), F.col("event_type").alias("engine"), F.when(F.col("id") % 2 == 0, F.to_json(F.struct("k"))).otherwise("{ }").alias("normalized"), F.lit(None).cast("string").alias("fields"), F.when(F.col("id") % 5 == 0, '["blur"]').otherwise("[]").alias("failures"))
    return retrieval.extraction_documents(e).select("id", F.sha1("content").alias("hash"))


@query("r3_index_actions", " , o AS (SELECT player, 'h' || power AS h FROM players WHERE player % 3 > 0), n AS (SELECT player, 'h' || (power + CASE WHEN player % 7 = 0 THEN 1 ELSE 0 END) AS h FROM players WHERE player % 4 > 0) SELECT player, CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete' WHEN o.h <> n.h THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n USING (player)")
def actions(spark, d):
    p = r.players(spark, d)
    h = lambda c: F.concat(F.lit("h"), c.cast("string")).alias("hash")
    return retrieval.index_actions(p.filter("player % 3 > 0").select("player", h(F.col("power"))), p.filter("player % 4 > 0").select("player", h(F.col("power") + F.when(F.col("player") % 7 == 0, 1).otherwise(0))), ["player"])


VEC_SQL = """, v AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0), vk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS place FROM v)"""


def vectors(spark, d):
    e = r.t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.vector_search(q, e, 10)


@query("r4_vector_search", VEC_SQL + " SELECT query_id, doc_id, CAST(place AS INTEGER) AS place FROM vk WHERE place <= 10")
def vector(spark, d):
    return vectors(spark, d).select("query_id", "doc_id", "place")


LEX_SQL = """, lq AS (SELECT item_id AS query_id, text AS query FROM benchmark), lx AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS place FROM documents, lq WHERE contains(lower(text), lower(query)))"""


def lexical(spark, d):
    docs = r.t(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("n_chars").alias("updated_at"))
    q = r.t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.lexical_search(q, docs, 5)


@query("r5_lexical_search", LEX_SQL + " SELECT query_id, doc_id, CAST(place AS INTEGER) AS place FROM lx WHERE place <= 5")
def lexical_query(spark, d):
    return lexical(spark, d).select("query_id", "doc_id", "place")


@query("r6_fused", VEC_SQL + LEX_SQL + """, it AS (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) * 100 AS query_id FROM benchmark), l2 AS (SELECT it.query_id, doc_id, place FROM lx JOIN it ON it.item_id = lx.query_id WHERE place <= 5), f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.score, round(coalesce(1.0 / (60 + a.place), 0) + coalesce(1.0 / (60 + b.place), 0), 8) AS fused FROM (SELECT * FROM vk WHERE place <= 10) a FULL JOIN l2 b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT query_id, doc_id, CAST(round(fused * 100000000) AS BIGINT) AS fused_e8, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, coalesce(score, 0) DESC, doc_id) AS place FROM f) WHERE place <= 10""")
def fused(spark, d):
    from boardlake.functions.ranks import numbered

    items = numbered(r.t(spark, d, "benchmark").select(F.lit(1).alias("all"), "item_id"), ["all"], ["item_id"])
    items = items.select(F.col("item_id").alias("query_id"), ((F.col("nth") - 1) * 100).alias("asked"))
    x = lexical(spark, d).join(items, "query_id").select(F.col("asked").alias("query_id"), "doc_id", "score", "place")
    return retrieval.fused(vectors(spark, d), x).select("query_id", "doc_id", F.round(F.col("fused") * 100000000).cast("long").alias("fused_e8"), "place")


NAMES_SQL = """, reg AS (SELECT dense_rank() OVER (ORDER BY k) AS player, k AS key FROM (SELECT DISTINCT regexp_replace(lower(p_name || p_type), '[^a-z0-9]', '', 'g') AS k FROM part)), qs AS (SELECT DISTINCT CASE WHEN player % 3 = 0 THEN key WHEN player % 3 = 1 THEN substr(key, 1, length(key) - 1) ELSE substr(key, 2, 1) || substr(key, 1, 1) || substr(key, 3) END AS query FROM reg),
jw AS (SELECT query, player, key, jaro_similarity(query, key) AS j, CASE WHEN query[1] <> key[1] THEN 0 WHEN query[2] <> key[2] THEN 1 WHEN query[3] <> key[3] THEN 2 WHEN query[4] <> key[4] THEN 3 ELSE 4 END AS p FROM qs, reg),
sim AS (SELECT query, player, CASE WHEN query = key THEN 1.0 ELSE floor(greatest(j + p * 0.1 * (1 - j), CASE WHEN starts_with(key, query) THEN 0.95 WHEN starts_with(query, key) THEN 0.94 WHEN contains(key, query) OR contains(query, key) THEN 0.9 ELSE 0 END) * 10000 + 0.5) / 10000 END AS score FROM jw)"""


def registered(spark, d):
    from boardlake.functions.ranks import numbered

    p = r.t(spark, d, "part").select(F.regexp_replace(F.lower(F.concat("p_name", "p_type")), "[^a-z0-9]", "").alias("key")).distinct()
    reg = numbered(p.withColumn("all", F.lit(0)), ["all"], ["key"], "player").select("key", "player")
    k = F.col("player") % 3
    q = F.when(k == 0, F.col("key")).when(k == 1, F.expr("substr(key, 1, length(key) - 1)")).otherwise(F.expr("substr(key, 2, 1) || substr(key, 1, 1) || substr(key, 3)"))
    return reg, reg.select(q.alias("query")).distinct()


def shown(df, key):
    """Names as shown: the key cut in two words."""
    half = F.expr(f"concat(substr({key}, 1, length({key}) div 2), ' ', substr({key}, length({key}) div 2 + 1))")
    return df.withColumn("shown", half).withColumn("key", F.col(key))


@query("j6_similar_names")  # half swaps count here; SQL engines round them down
def similar(spark, d):
    reg, q = registered(spark, d)
    return vectorized.similar_players(shown(q, "query"), shown(reg, "key")).select("query", "player", F.round(F.col("score") * 10000).cast("long").alias("score_e4"))


#: Every second player has an alias, every eleventh a namesake; names that stay open are looked up as one of five vectors.
IDENTITY_SQL = NAMES_SQL + VEC_SQL + """, pl AS (SELECT player, key AS name FROM reg UNION ALL SELECT player + 1000000, key FROM reg WHERE player % 11 = 0),
ex AS (SELECT query, player, min(mode) AS mode FROM (SELECT query, player, 'exact_alias' AS mode FROM qs JOIN reg ON query = key WHERE player % 2 = 0 UNION ALL SELECT query, player, 'exact_name' FROM qs JOIN pl ON lower(query) = lower(name)) GROUP BY ALL),
fz AS (SELECT query, player, score FROM sim WHERE score >= 0.72 AND query NOT IN (SELECT query FROM ex) UNION ALL SELECT query, player + 1000000, score FROM sim WHERE score >= 0.72 AND player % 11 = 0 AND query NOT IN (SELECT query FROM ex)),
st AS (SELECT query, count(*) FILTER (score >= 0.93) AS n, max(CASE WHEN score >= 0.93 THEN player END) AS player, max(CASE WHEN score >= 0.93 THEN mode END) AS mode FROM (SELECT query, player, 1.0 AS score, mode FROM ex UNION ALL SELECT query, player, score, 'fuzzy' FROM fz) GROUP BY 1),
hit AS (SELECT query, doc_id % 40 + 1 AS player, max(greatest(0, least(1, greatest(score, 60.0 / (60 + place))))) AS s FROM qs LEFT JOIN st USING (query) JOIN vk ON query_id = length(query) % 5 * 100 WHERE place <= 10 AND place % (1 + length(query) % 3) = 0 AND coalesce(n, 0) <> 1 GROUP BY ALL),
em AS (SELECT h.query, h.player, s, row_number() OVER w AS k, s - coalesce(lead(s) OVER w, 0) AS lead FROM hit h JOIN pl USING (player) WINDOW w AS (PARTITION BY h.query ORDER BY s DESC, name, h.player)),
out AS (SELECT qs.query, n, st.player, mode, s, em.player AS e_player, lead FROM qs LEFT JOIN st USING (query) LEFT JOIN em ON em.query = qs.query AND em.k = 1)
SELECT query, CASE WHEN (s >= 0.93 AND lead >= 0.04) OR n = 1 THEN 'AUTO_LINKED' ELSE 'UNRESOLVED' END AS status, CASE WHEN s >= 0.93 AND lead >= 0.04 THEN e_player WHEN n = 1 THEN player END AS player,
  CASE WHEN s >= 0.93 AND lead >= 0.04 THEN 'embedding-fallback-high-confidence' WHEN n = 1 AND mode = 'exact_alias' THEN 'alias-exact' WHEN n = 1 AND mode = 'exact_name' THEN 'name-exact' WHEN n = 1 THEN 'name-fuzzy-high-confidence' WHEN n > 1 OR s >= 0.93 THEN 'ambiguous' ELSE 'no-unique-match' END AS reason FROM out"""


def identities(spark, d):
    reg, q = registered(spark, d)
    again = reg.filter("player % 11 = 0").select((F.col("player") + 1000000).alias("player"), "key")
    players = reg.select("player", "key").unionByName(again).select("player", F.concat(F.lit("g"), "player").alias("game_id"), F.col("key").alias("name"), "key", F.col("key").alias("shown"))
    near = vectors(spark, d).select("query_id", (F.col("doc_id") % 40 + 1).alias("player"), F.col("score").alias("similarity"), "place")

    def search(left):
        n = F.length("query")
        asked = left.select("query", (n % 5 * 100).alias("query_id"), (1 + n % 3).alias("step"))
        return asked.join(near, "query_id").filter("place % step = 0").select("query", "player", "similarity", (1 / (F.lit(60.0) + F.col("place"))).alias("fused"))

    aliases = reg.filter("player % 2 = 0").select(F.col("key").alias("alias_key"), "player")
    return identity.resolve_identities(q.withColumns({"key": F.col("query"), "shown": F.col("query")}), players, aliases, search)


@query("j15_resolved_names", IDENTITY_SQL)
def resolved(spark, d):
    return identities(spark, d).select("query", "status", "player", "reason")


@query("j15_suggestions")  # half swaps count in scores, as in J6
def identity_suggestions(spark, d):
    s = F.transform("suggestions", lambda x: F.concat_ws(":", x["player"], x["source"]))
    return identities(spark, d).select("query", F.array_join(s, ",").alias("suggestions"))


@query("j14_seeded_aliases", """, cand AS (SELECT p_partkey AS seq, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS alias_key, p_partkey % 10 AS player FROM part), al AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS alias_key, 3 AS owner FROM part WHERE p_name LIKE 'r%'),
x AS (SELECT c.*, owner, first_value(player) OVER w AS f, row_number() OVER w AS n FROM cand c LEFT JOIN al USING (alias_key) WINDOW w AS (PARTITION BY alias_key ORDER BY seq))
SELECT seq, CASE WHEN owner IS NULL AND n = 1 THEN 'seeded' WHEN coalesce(owner, f) = player THEN 'skipped' ELSE 'conflict' END AS outcome FROM x""")
def seeded(spark, d):
    p = r.t(spark, d, "part")
    key = F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    cand = p.select(F.col("p_partkey").alias("seq"), key.alias("alias_key"), (F.col("p_partkey") % 10).alias("player"))
    al = p.filter("p_name like 'r%'").select(key.alias("alias_key"), F.lit(3).cast("long").alias("player")).distinct()
    return identity.seed_aliases(cand, al).select("seq", "outcome")


@query("j14_alias_outcomes", """, cn AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 9 > 0 THEN c_custkey % 400 END AS player, CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'Unknown' ELSE 'Lord ' || (c_custkey % 300) END AS name, c_custkey % 2 = 0 AS tracked, CASE WHEN c_custkey % 3 > 0 THEN 'P' || c_nationkey ELSE '' END AS tag FROM customer),
ca AS (SELECT seq, 0 AS part, player, CASE WHEN player IS NULL THEN '' ELSE name END AS alias FROM cn UNION ALL SELECT seq, 1, player, '[' || tag || '] ' || name FROM cn WHERE tracked AND tag <> '' AND name <> '' AND player IS NOT NULL),
ck AS (SELECT * FROM (SELECT *, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') AS k FROM ca) WHERE alias = '' OR k <> 'unknown'), ow AS (SELECT DISTINCT 'lord' || (c_custkey % 300) AS k, 5 AS owner FROM customer WHERE c_custkey % 300 < 30),
cr AS (SELECT ck.*, owner, row_number() OVER (PARTITION BY k ORDER BY seq, part) AS n, first_value(player) OVER (PARTITION BY k ORDER BY seq, part) AS f FROM ck LEFT JOIN ow USING (k) WHERE k <> '')
SELECT count(*) FILTER (o = 'seeded') AS seeded, count(*) FILTER (o = 'conflict') AS conflict, count(*) FILTER (o = 'skipped') AS skipped FROM (SELECT CASE WHEN owner IS NULL AND n = 1 THEN 'seeded' WHEN coalesce(owner, f) = player THEN 'skipped' ELSE 'conflict' END AS o FROM cr UNION ALL SELECT 'skipped' FROM ck WHERE k = '')""")
def alias_outcomes(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 13 == 0, "").when(k % 7 == 0, "Unknown").otherwise(F.concat(F.lit("Lord "), k % 300))
    names = r.t(spark, d, "customer").select(k.alias("seq"), F.when(k % 9 > 0, k % 400).alias("player"), name.alias("name"), (k % 2 == 0).alias("tracked"), F.when(k % 3 > 0, F.concat(F.lit("P"), "c_nationkey")).otherwise("").alias("tag"))
    taken = r.t(spark, d, "customer").filter("c_custkey % 300 < 30").select(F.concat(F.lit("lord"), k % 300).alias("alias_key"), F.lit(5).cast("long").alias("player")).distinct()
    return identity.alias_outcomes(identity.seed_aliases(identity.alias_candidates(names), taken))


#: Customers' orders as captured runs of a month each.
ARCHIVE_SQL = """, ar AS (SELECT id, identity AS run, type, status, updated_at, strftime(created_at, '%Y-%m') AS month FROM board), st AS (SELECT id FROM ar WHERE status <> 'UNRESOLVED' AND updated_at < TIMESTAMP '1996-01-01' - INTERVAL 45 DAY)"""


def archived(spark, d):
    b = r.boards(spark, d).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    runs, rows = scratch(spark, "runs"), scratch(spark, "rows")
    status = F.when(F.col("status") == "ACTIVE", "MERGED").when(F.col("status") == "REJECTED", "FAILED").otherwise("REVIEW")
    b.select("month", F.col("id").alias("run"), status.alias("status"), F.col("updated_at").alias("processed_at"), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("own"), F.lit("kept"))).alias("metadata")).write.partitionBy("month").parquet(runs)
    b.select("month", F.col("id").alias("run"), "name", F.lit("trace").alias("ocr_trace"), F.lit("[]").alias("candidates")).write.partitionBy("month").parquet(rows)
    counts = upkeep.archive_runs(spark, runs, rows, "1996-01-01 00:00:00")
    return counts, spark.read.parquet(runs), spark.read.parquet(rows)


@query("f6_archived_rows", ARCHIVE_SQL + " SELECT id AS run, CASE WHEN id NOT IN (SELECT id FROM st) THEN 'trace' END AS ocr_trace, CASE WHEN id NOT IN (SELECT id FROM st) THEN '[]' END AS candidates, concat_ws(',', CASE WHEN id IN (SELECT id FROM st) THEN '45' END, CASE WHEN id % 2 = 0 THEN 'kept' END) AS metadata FROM ar")
def archived_rows(spark, d):
    _, runs, rows = archived(spark, d)
    note = F.concat_ws(",", F.col("metadata")["archivedRawRowsOlderThanDays"], F.col("metadata")["own"])
    return rows.join(runs.select("run", note.alias("metadata")), "run").select("run", "ocr_trace", "candidates", "metadata")


@query("f6_archive_counts", ARCHIVE_SQL + " SELECT count(*) AS scanned, count(*) AS archived_runs, count(*) AS archived_rows FROM st")
def archive_counts(spark, d):
    return archived(spark, d)[0]


@query("u4_best_suggestions")
def suggestions(spark, d):
    reg, q = registered(spark, d)
    s = vectorized.similar_names(q, reg).select("query", "player", F.lpad(F.col("player").cast("string"), 9, "0").alias("name"), "score", F.lit("fuzzy").alias("source"))
    return identity.best_per_player(s).select("query", "player", "place")


@query("r7_embedding_fallback", VEC_SQL + """, h AS (SELECT query_id AS query, doc_id % 40 AS player, greatest(0, least(1, greatest(score, 1.0 / (60 + place) * 60))) AS s, row_number() OVER (PARTITION BY query_id, doc_id % 40 ORDER BY score DESC, place) AS n FROM vk WHERE place <= 10), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, player) AS k, lead(s) OVER (PARTITION BY query ORDER BY s DESC, player) AS nx FROM h WHERE n = 1)
SELECT query, player, CASE WHEN s >= 0.93 AND s - coalesce(nx, 0) >= 0.04 THEN 'resolved' WHEN s >= 0.93 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM b WHERE k = 1""")
def fallback(spark, d):
    v = vectors(spark, d).select(F.col("query_id").alias("query"), (F.col("doc_id") % 40).alias("player"), F.col("score").alias("similarity"), (1 / (F.lit(60.0) + F.col("place"))).alias("fused"))
    return identity.fallback(v).select("query", "player", "status")


@query("r8_context_pack", r""", pc AS (SELECT conv_id AS pack, turn AS place, trim(substr(trim(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || ' '), 1, 30000), chr(10) || chr(9) || ' ') AS body, trim(substr(text, 1, 80), chr(10) || chr(9) || ' ') AS short, role = 'system' AS critical, turn % 3 AS priority FROM conversations),
po AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY critical DESC, priority DESC, place) AS n FROM pc WHERE body <> ''),
ps AS (SELECT pack, 0::BIGINT AS n, NULL::BIGINT AS place, NULL::VARCHAR AS how, 0::BIGINT AS tokens, 200::BIGINT AS rest FROM (SELECT DISTINCT pack FROM po)
  UNION ALL SELECT pack, n, place, how, tokens, rest - CASE WHEN how IS NULL THEN 0 ELSE tokens END FROM (SELECT y.*, CASE how WHEN 'full' THEN tb WHEN 'summary' THEN ts ELSE tc END AS tokens FROM (SELECT x.*, CASE WHEN tb <= rest THEN 'full' WHEN short <> '' AND ts <= rest THEN 'summary' WHEN critical AND tc > 0 AND tc <= rest THEN 'clipped' END AS how
    FROM (SELECT o.pack, o.n, o.place, o.critical, o.short, rest, CAST(ceil(length(body) / 4) AS BIGINT) AS tb, CAST(ceil(length(short) / 4) AS BIGINT) AS ts, CAST(ceil(length(trim(substr(body, 1, greatest(120, rest * 4)), chr(10) || chr(9) || ' ')) / 4) AS BIGINT) AS tc FROM ps JOIN po o ON o.pack = ps.pack AND o.n = ps.n + 1) x) y) z)
SELECT pack, place, how, tokens FROM ps WHERE how IS NOT NULL""")
def pack(spark, d):
    c = r.t(spark, d, "conversations").select(F.col("conv_id").alias("pack"), F.col("turn").alias("place"), F.col("text").alias("content"), F.substring("text", 1, 80).alias("summary"), (F.col("role") == "system").alias("critical"), (F.col("turn") % 3).cast("int").alias("priority"), F.lit(200).alias("budget"))
    return vectorized.pack_context(c)


FUSED_SQL = """, cd AS (SELECT player AS ext, metric, CASE metric WHEN 'kill_points' THEN 'kp' WHEN 'contribution_points' THEN 't4' WHEN 'fort_destroying' THEN 't5' WHEN 'power' THEN 'governorName' ELSE 'governorId' END AS field, id, CASE WHEN metric = 'power' THEN 'Lord ' || CASE WHEN value % 2 = 0 THEN 'é' ELSE 'e' END || value WHEN id % 9 = 0 THEN 'x' ELSE CAST(value * CASE WHEN metric = 'kill_points' THEN 1 ELSE 2 END AS VARCHAR) END AS value, CAST(value % 101 AS DOUBLE) AS confidence, id % 4 > 0 AS valid FROM obs),
sc AS (SELECT *, length(regexp_replace(value, '[^0-9]', '', 'g')) AS nd, length(value) AS n FROM cd),
fs AS (SELECT *, round(confidence / 100 * 0.62::DOUBLE + CASE WHEN field = 'governorName' THEN CASE WHEN n BETWEEN 1 AND 40 THEN 0.12::DOUBLE ELSE -0.18::DOUBLE END + CASE WHEN n > 0 THEN (1 - (n - length(replace(value, 'é', ''))) / n) * 0.2::DOUBLE ELSE 0 END + CASE WHEN valid THEN 0.1::DOUBLE ELSE -0.28::DOUBLE END
  ELSE CASE WHEN nd > 0 THEN 0.1::DOUBLE ELSE -0.45::DOUBLE END + CASE WHEN field = 'governorId' THEN CASE WHEN nd BETWEEN 6 AND 12 THEN 0.16::DOUBLE ELSE -0.22::DOUBLE END WHEN nd BETWEEN 1 AND 11 THEN 0.08::DOUBLE ELSE -0.16::DOUBLE END + CASE WHEN valid THEN 0.14::DOUBLE ELSE -0.35::DOUBLE END END, 9) AS score FROM sc),
fp AS (SELECT *, row_number() OVER w AS place, round(score - lead(score) OVER w, 9) AS lead FROM fs WINDOW w AS (PARTITION BY ext, field ORDER BY score DESC, confidence DESC, id)), fc AS (SELECT * FROM fp WHERE place <= 4)"""


def scored_candidates(spark, d):
    o = r.observations(spark, d)
    m = F.col("metric")
    field = F.when(m == "kill_points", "kp").when(m == "contribution_points", "t4").when(m == "fort_destroying", "t5").when(m == "power", "governorName").otherwise("governorId")
    name = F.concat(F.lit("Lord "), F.when(F.col("value") % 2 == 0, "é").otherwise("e"), F.col("value").cast("string"))
    value = F.when(m == "power", name).when(F.col("id") % 9 == 0, "x").otherwise((F.col("value") * F.when(m == "kill_points", 1).otherwise(2)).cast("string"))
    problem = F.when(F.col("id") % 8 == 0, F.concat(F.lit("too-long-"), "metric"))
    return o.select(F.col("player").alias("ext"), field.alias("field"), "id", value.alias("value"), (F.col("value") % 101).cast("double").alias("confidence"), (F.col("id") % 4 > 0).alias("valid"), problem.alias("problem"))


@query("w14_fused_candidates", FUSED_SQL + """ SELECT ext, field, id, CAST(place AS INTEGER) AS place, CAST(round(score * 1000000) AS BIGINT) AS score_ppm, CASE WHEN place = 1 THEN coalesce(nullif(concat_ws(',', CASE WHEN NOT valid THEN CASE WHEN id % 8 = 0 THEN 'too-long-' || metric ELSE 'validation-failed' END END, CASE WHEN confidence < 70 THEN 'low-ocr-confidence' END, CASE WHEN score < 0.55 THEN 'low-fusion-score' END, CASE WHEN lead < 0.03 THEN 'ambiguous-candidates' END), ''), 'selected-highest-fusion-score') END AS reasons FROM fc""")
def candidates(spark, d):
    return quality.fused_candidates(scored_candidates(spark, d)).select("ext", "field", "id", "place", F.round(F.col("score") * 1000000).cast("long").alias("score_ppm"), "reasons")


@query("w15_consistent_fields", FUSED_SQL + """, nm AS (SELECT *, CAST(regexp_replace(value, '[^0-9]', '', 'g') AS HUGEINT) AS v, row_number() OVER (PARTITION BY ext, field ORDER BY place) AS p FROM fp WHERE nd > 0),
cb AS (SELECT a.ext, a.v AS kp, b.v AS t4, c.v AS t5, a.place AS pa, b.place AS pb, c.place AS pc, round(a.score + b.score + c.score - CASE WHEN a.v < b.v + c.v THEN 1.25::DOUBLE + least(2.0::DOUBLE, (b.v + c.v - a.v) / greatest(1, a.v)) ELSE 0 END, 9) AS total
  FROM nm a JOIN nm b ON a.ext = b.ext JOIN nm c ON a.ext = c.ext WHERE a.field = 'kp' AND b.field = 't4' AND c.field = 't5' AND a.p <= 3 AND b.p <= 3 AND c.p <= 3),
bs AS (SELECT *, row_number() OVER (PARTITION BY ext ORDER BY total DESC, pa, pb, pc) AS k FROM cb)
SELECT ext, kp, t4, t5, CAST(round(total * 1000000) AS BIGINT) AS total_ppm, kp < t4 + t5 AS inconsistent, concat_ws(',', CASE WHEN pa > 1 THEN 'kp:adjusted-for-consistency' END, CASE WHEN pb > 1 THEN 't4:adjusted-for-consistency' END, CASE WHEN pc > 1 THEN 't5:adjusted-for-consistency' END) AS reasons FROM bs WHERE k = 1""")
def consistent(spark, d):
    return quality.consistent_fields(quality.scored_candidates(scored_candidates(spark, d))).select("ext", "kp", "t4", "t5", F.round(F.col("total") * 1000000).cast("long").alias("total_ppm"), "inconsistent", "reasons")


@query("a26_run_quality", """, x AS (SELECT run, pos, (value % 97 + confidence + value % 100 + (value % 50) * 0.35::DOUBLE) / 3.35::DOUBLE AS c, pos % 3 > 0 AS grouped, name = 'Kill Points' AS failed FROM captured WHERE run % 9 > 0),
y AS (SELECT run, avg(CASE WHEN grouped THEN c ELSE greatest(0, c - 7) END) AS m, bool_or(failed) AS failed FROM x GROUP BY 1), z AS (SELECT DISTINCT run FROM captured)
SELECT z.run, CAST(floor(coalesce(m, 0) * 100 + 0.31415926) AS BIGINT) AS hundredths, m IS NULL OR m < 72 OR failed OR z.run % 7 = 0 AS low_confidence FROM z LEFT JOIN y USING (run)""")
def run_quality(spark, d):
    from boardlake.operators.guards import run_quality as run

    c = r.captured(spark, d)
    runs = c.select("run").distinct().withColumn("guard_failures", F.when(F.col("run") % 7 == 0, F.array(F.lit("uniform-metric-suspect"))))
    rows = c.filter("run % 9 > 0").select("run", (F.col("value") % 97).alias("rank_conf"), F.col("confidence").alias("name_conf"), (F.col("value") % 100).alias("metric_conf"), (F.col("value") % 50).alias("title_conf"), (F.col("pos") % 3 > 0).alias("grouping_ok"), (F.col("name") == "Kill Points").alias("failed"))
    return run(rows, runs).select("run", F.floor(F.col("mean") * 100 + 0.31415926).cast("long").alias("hundredths"), "low_confidence")


@query("j5_exact_matches", NAMES_SQL + " SELECT query, player, 'alias' AS source FROM qs JOIN reg ON query = key UNION ALL SELECT query, player, 'name' FROM qs JOIN reg ON lower('~' || key) = lower(query)")
def exact_matches(spark, d):
    reg, q = registered(spark, d)
    players = reg.select("player", F.concat(F.lit("~"), "key").alias("name"), "key")
    return identity.exact_matches(q.withColumn("key", F.col("query")), players, reg.select(F.col("key").alias("alias_key"), "player")).select("query", "player", "source")


@query("f7_trailing_days", EXT_SQL + " SELECT id, 0 AS asked FROM ext WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 1 DAY UNION ALL SELECT id, 30 FROM ext WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY UNION ALL SELECT id, 12 FROM ext WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 12 DAY UNION ALL SELECT id, 999 FROM ext WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 180 DAY")
def trailing(spark, d):
    e, now = extractions(spark, d), F.lit("2024-01-31").cast("timestamp")
    parts = [quality.trailing_days(e, now, days).select("id", F.lit(label).alias("asked")) for days, label in ((0, 0), (None, 30), (12, 12), (999, 999))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
