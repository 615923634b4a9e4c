"""Queries of names and alliances, remaining reports, exports and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.functions import alliances
from boardlake.operators import dedupe, identity, quality, ranking
from boardlake.plans import registry as r
from boardlake.plans.registry import query
from boardlake.sources import sinks
from boardlake.sources.scratch import scratch
from boardlake.streaming import jobs, retry, stateful

TAGGED = [("'[GODt] Gd ' || name", "[GODt] GOD of Thunder", "name-tag", 98), ("'V 57 - ' || name", "[V57] Legacy of Velmora", "name-tag", 93), ("'(P57R] ' || name", "[P57R] PHOENIX RISING 4057", "name-tag", 98), ("'gd_' || name", "[GODt] GOD of Thunder", "name-tag", 60), ("name", None, None, None)]


def tagged(spark, d):
    p = r.players(spark, d)
    raw = F.lit(None).cast("string")
    for i, (expr, *_rest) in enumerate(TAGGED):
        raw = F.when(F.col("player") % 5 == i, F.expr(expr)).otherwise(raw)
    return p.withColumn("raw", raw)


def _case(k: int) -> str:
    return "CASE player % 5 " + " ".join(f"WHEN {i} THEN " + ("NULL" if t[k] is None else repr(t[k])) for i, t in enumerate(TAGGED)) + " END"


@query("p12_detected_alliance", f" SELECT player, {_case(1)} AS label, {_case(2)} AS source, CAST({_case(3)} AS BIGINT) AS confidence FROM players")
def detected(spark, d):
    return tagged(spark, d).select("player", alliances.detected(F.col("raw")).alias("a")).select("player", "a.label", "a.source", F.round(F.col("a.confidence") * 100).cast("long").alias("confidence"))


@query("p13_split_name", " SELECT player, CASE player % 5 WHEN 0 THEN 'Gd ' || name WHEN 3 THEN 'gd_' || name ELSE name END AS clean FROM players")
def split_name(spark, d):
    from boardlake.functions.vectorized import nfkc_sanitize

    return tagged(spark, d).select("player", alliances.stripped(nfkc_sanitize("raw")).alias("clean"))


@query("p14_canonical_alliance", f""", k AS (SELECT id, type, identity, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN identity ELSE -1 END AS linked, CASE WHEN id % 7 = 0 THEN '[V57] x' WHEN id % 4 = 0 THEN '' ELSE 'raw ' || type END AS raw FROM board)
SELECT k.id, CASE WHEN p.player IS NULL THEN nullif(raw, '') ELSE coalesce({_case(1)}, CASE WHEN k.id % 7 = 0 THEN '[V57] Legacy of Velmora' END, p.alliance) END AS alliance FROM k LEFT JOIN players p ON p.player = linked""")
def canonical(spark, d):
    k = F.col("id")
    raw = F.when(k % 7 == 0, "[V57] x").when(k % 4 == 0, "").otherwise(F.concat(F.lit("raw "), "type"))
    b = r.boards(spark, d).select("id", F.when(k % 3 == 1, F.col("identity")).when(k % 3 == 2, -1).alias("linked"), raw.alias("alliance_raw"))
    return alliances.canonical_alliances(b, tagged(spark, d).select("player", F.col("raw").alias("name"), "alliance")).select("id", "alliance")


@query("p7_display_name", " SELECT player, substr(regexp_replace(name, '#', '#', 'g') || ' ' || alliance, 1, 64) AS shown FROM players")
def display(spark, d):
    from boardlake.functions.vectorized import nfkc_sanitize

    p = r.players(spark, d)
    names = p.select("name", "alliance").distinct().withColumn("shown", nfkc_sanitize(F.concat(F.lit("  "), "name", F.lit("\t​ "), "alliance", F.lit(" €"))))
    return p.join(names, ["name", "alliance"]).select("player", "shown")


@query("p10_cleaned_name", " SELECT player, 'a' || CASE WHEN player % 2 = 0 THEN 'O' ELSE 'l' END || 'b 1' || CASE WHEN player % 2 = 0 THEN '0' ELSE '5' END || '2 - ' || player AS clean FROM players")
def cleaned(spark, d):
    even = F.col("player") % 2 == 0
    noisy = F.concat(F.lit("a"), F.when(even, "0").otherwise("1"), F.lit("b  1"), F.when(even, "O").otherwise("S"), F.lit("2 ---- "), F.col("player").cast("string"))
    return r.players(spark, d).select("player", alliances.cleaned_name(noisy).alias("clean"))


@query("p11_subtitle", " SELECT player, CASE WHEN player % 3 > 0 THEN alliance END AS alliance, CASE WHEN player % 3 = 0 THEN 'Officer ' || alliance END AS title FROM players")
def subtitle(spark, d):
    s = F.when(F.col("player") % 3 == 0, F.concat(F.lit("Officer "), "alliance")).otherwise(F.col("alliance"))
    return r.players(spark, d).select("player", alliances.subtitle(s).alias("s")).select("player", "s.alliance", "s.title")


HEAD_SQL = """, h AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '* INDIVIDUAL  POWER RANKINGS' WHEN 1 THEN 'MadScientist ranking' WHEN 2 THEN 'KILL POINTS!' WHEN 3 THEN p_name ELSE '' END AS s, p_name FROM part)"""


def heads(spark, d):
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, "* INDIVIDUAL  POWER RANKINGS").when(k == 1, "MadScientist ranking").when(k == 2, "KILL POINTS!").when(k == 3, F.col("p_name")).otherwise("")
    return r.t(spark, d, "part").select(F.col("p_partkey").alias("id"), s.alias("s"), "p_name")


@query("p4_headers", HEAD_SQL + " SELECT id, CASE id % 5 WHEN 0 THEN 'individual_power' WHEN 1 THEN 'mad_scientist' WHEN 2 THEN 'kill_point' WHEN 3 THEN replace(p_name, ' ', '_') ELSE 'unknown' END AS board, CASE id % 5 WHEN 0 THEN 'power' WHEN 1 THEN 'madscientist_ranking' WHEN 2 THEN 'kill_points' WHEN 3 THEN replace(p_name, ' ', '_') ELSE 'metric' END AS metric FROM h")
def headers(spark, d):
    return heads(spark, d).select("id", alliances.board_header(F.col("s")).alias("board"), alliances.metric_header(F.col("s")).alias("metric"))


@query("p5_board_tokens", HEAD_SQL + " SELECT id, CASE id % 5 WHEN 0 THEN 'INDIVIDUAL POWER' WHEN 1 THEN 'MAD SCIENTIST' WHEN 2 THEN 'KILL POINT' ELSE '' END AS tokens FROM h")
def tokens(spark, d):
    return heads(spark, d).select("id", F.array_join(alliances.board_tokens(F.col("s")), ",").alias("tokens"))


@query("f2_filter_labels", " SELECT CAST(n_nationkey AS BIGINT) AS seq, CASE n_nationkey WHEN 0 THEN '[V57] Legacy of Velmora' WHEN 1 THEN '[P57R] PHOENIX RISING 4057' ELSE n_name END AS value FROM nation WHERE n_nationkey NOT IN (2, 3)")
def labels(spark, d):
    k = F.col("n_nationkey")
    raw = F.when(k == 0, "v57").when(k == 1, "Phoenix Rising").when(k == 2, " [P57R] x").when(k == 3, "").otherwise(F.col("n_name"))
    return alliances.filter_labels(r.t(spark, d, "nation").select(k.cast("long").alias("seq"), raw.alias("raw")))


@query("w11_bars", """, wv AS (SELECT id, type, CASE WHEN id % 50 = 0 THEN -value WHEN id % 51 > 0 THEN value END AS value, CASE WHEN type = '1-URGENT' THEN updated_at - INTERVAL 2 DAY ELSE updated_at END AS updated_at FROM board),
wp AS (SELECT type, greatest(0, max(value)) AS most, CASE WHEN date_diff('second', max(updated_at), TIMESTAMP '1998-08-04') // 3600 <= 24 THEN 'good' WHEN date_diff('second', max(updated_at), TIMESTAMP '1998-08-04') // 3600 <= 72 THEN 'warn' ELSE 'bad' END AS tone FROM wv GROUP BY 1)
SELECT id, CAST(greatest(0, least(10000, coalesce(value * 10000 // nullif(most, 0), 0))) AS BIGINT) AS hundredths, tone FROM wv JOIN wp USING (type)""")
def bars(spark, d):
    i = F.col("id")
    b = r.boards(spark, d).withColumns({"value": F.when(i % 50 == 0, -F.col("value")).when(i % 51 > 0, F.col("value")), "updated_at": F.when(F.col("type") == "1-URGENT", F.timestamp_add("DAY", F.lit(-2), F.col("updated_at").cast("timestamp"))).otherwise(F.col("updated_at").cast("timestamp"))})
    return ranking.bars(b, ["type"], F.lit("1998-08-04").cast("timestamp")).select("id", "hundredths", "tone")


@query("j16_rerun_match", """, a AS (SELECT identity % 300 AS run, min(id) AS id, source_rank AS rank, name FROM board WHERE type = '1-URGENT' AND source_rank IS NOT NULL GROUP BY ALL), b AS (SELECT identity % 300 AS run, id AS new_id, source_rank AS rank, name, id AS pos FROM board WHERE type = '2-HIGH'),
br AS (SELECT run, rank, arg_min(new_id, pos) AS m FROM b WHERE rank IS NOT NULL GROUP BY 1, 2), bn AS (SELECT run, name, arg_min(new_id, pos) AS m FROM b GROUP BY 1, 2), bf AS (SELECT run, arg_min(new_id, pos) AS m FROM b GROUP BY 1)
SELECT a.run, a.id, coalesce(br.m, bn.m, bf.m) AS new_id, CASE WHEN br.m IS NOT NULL THEN 'rank' WHEN bn.m IS NOT NULL THEN 'name' WHEN bf.m IS NOT NULL THEN 'first' END AS how FROM a LEFT JOIN br ON a.run = br.run AND a.rank = br.rank LEFT JOIN bn ON a.run = bn.run AND a.name = bn.name LEFT JOIN bf ON a.run = bf.run""")
def rerun(spark, d):
    b = r.boards(spark, d).withColumn("run", F.col("identity") % 300).withColumn("rank", F.col("source_rank"))
    a = b.filter("type = '1-URGENT' and rank is not null").groupBy("run", "rank", "name").agg(F.min("id").alias("id"))
    return identity.rerun_match(a, b.filter("type = '2-HIGH'").select("run", F.col("id").alias("new_id"), "rank", "name", F.col("id").alias("pos")))


@query("u5_first_artifacts", """, ta AS (SELECT identity % 50 AS job, id AS task, created_at, CAST(identity % 70 AS VARCHAR) AS artifact FROM board WHERE status = 'ACTIVE' AND identity % 70 > 3 AND id % 6 > 0)
SELECT job, artifact, arg_min(task, row(created_at, task)) AS task FROM ta GROUP BY 1, 2""")
def artifacts(spark, d):
    k = F.col("identity") % 70
    a = F.when(k == 0, "").when(k == 1, "  ").when(k > 3, F.concat(F.lit(" "), k.cast("string")))
    rows = r.boards(spark, d).select((F.col("identity") % 50).alias("job"), F.col("id").alias("task"), "created_at", F.when(F.col("status") == "ACTIVE", "COMPLETED").otherwise("QUEUED").alias("status"), a.alias("artifact"), F.when(F.col("id") % 6 > 0, F.lit("u")).otherwise("").alias("url"), F.create_map(F.lit("type"), F.col("type")).alias("meta"), F.create_map(F.lit("type"), F.lit("task")).alias("task_meta"))
    return dedupe.first_artifacts(rows).select("job", "artifact", "task")


@query("s3_csv_export", " SELECT CAST(player AS VARCHAR) AS player, name, alliance || ' \"x\", y' AS alliance FROM players")
def csv_export(spark, d):
    path = scratch(spark, "export")
    sinks.write_csv(r.players(spark, d).select("player", "name", F.concat("alliance", F.lit(' "x", y')).alias("alliance")), path, ["player"])
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query("p29_diagnostics", """, e AS (SELECT event_id AS id, event_type AS w, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT id, CASE WHEN id % 5 > 0 THEN k / 100 END AS confidence, CASE WHEN id % 5 > 0 THEN CAST(k AS BIGINT) END AS dropped, CASE WHEN id % 5 > 0 THEN CASE id % 3 WHEN 0 THEN 'blur,' || w WHEN 1 THEN '' ELSE 'a' END END AS failures, CASE WHEN id % 5 > 0 AND id % 2 = 0 THEN w END AS worker, CASE WHEN id % 5 > 0 THEN '{"ratio":' || k || '}' END AS uniformity, id % 5 > 0 AS known FROM e""")
def diagnostics(spark, d):
    e = r.t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("w"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    i = F.col("id")
    listed = F.when(i % 3 == 0, F.concat(F.lit('["blur", 7, " ", "'), "w", F.lit('"]'))).when(i % 3 == 1, "7").otherwise('["a", null]')
    text = F.concat(F.lit('{"classificationConfidence":'), (F.col("k") / 100).cast("string"), F.lit(',"droppedRowCount":'), (F.col("k") + 0.5).cast("string"), F.lit(',"guardFailures":'), listed, F.lit(',"worker":'), F.when(i % 2 == 0, F.concat(F.lit('"'), "w", F.lit('"'))).otherwise("3"), F.lit(',"slotCount":"x","uniformity":{"ratio":'), F.col("k").cast("string"), F.lit("}}"))
    meta = F.when(i % 5 == 0, F.when(i % 2 == 0, '{"other":1}').otherwise("[1]")).otherwise(text)
    g = quality.run_diagnostics(meta)
    return e.select("id", g.alias("g")).select("id", F.col("g.classification_confidence").alias("confidence"), F.col("g.dropped_rows").alias("dropped"), F.array_join("g.guard_failures", ",").alias("failures"), F.col("g.worker").alias("worker"), F.col("g.uniformity").alias("uniformity"), F.col("g").isNotNull().alias("known"))


@query("p29_suggestions", """, b AS (SELECT type, identity AS run, 'g' || (id % 7) AS g, CASE WHEN id % 5 > 0 THEN name ELSE ' ' END AS name, CASE id % 3 WHEN 0 THEN 'alias' WHEN 1 THEN 'name' ELSE 'guess' END AS source, row_number() OVER (PARTITION BY identity ORDER BY id) AS n FROM board),
u AS (SELECT *, row_number() OVER (PARTITION BY run, g ORDER BY n) AS k FROM b WHERE name <> ' ' AND source <> 'guess'), v AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n) AS place FROM u WHERE k = 1)
SELECT r.run, coalesce(string_agg(g || ':' || source, ',' ORDER BY place) FILTER (place <= 8), '') AS suggestions FROM (SELECT DISTINCT run FROM b) r LEFT JOIN v USING (run) GROUP BY 1""")
def suggestions(spark, d):
    i = F.col("id")
    one = F.struct(F.concat(F.lit("g"), (i % 7).cast("string")).alias("governorId"), F.lit("1").alias("governorGameId"), F.when(i % 5 > 0, F.col("name")).otherwise(" ").alias("name"), F.when(i % 3 == 0, "alias").when(i % 3 == 1, "name").otherwise("guess").alias("source"))
    runs = r.boards(spark, d).groupBy(F.col("identity").alias("run")).agg(F.array_sort(F.collect_list(F.struct("id", one.alias("s")))).alias("a"))
    found = runs.select("run", quality.identity_suggestions(F.to_json(F.struct(F.transform("a", lambda x: x["s"]).alias("identitySuggestions")))).alias("s"))
    return found.select("run", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["id"], x["source"])), ",").alias("suggestions"))


@query("p28_analysis_rows", """, c AS (SELECT identity AS plan, type AS read, id, row_number() OVER (PARTITION BY identity, type ORDER BY id) AS n, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN 'raw ' || name ELSE '-' END AS player, CASE WHEN id % 4 = 3 OR identity = 0 THEN '-' ELSE CAST(identity AS VARCHAR) END AS pid, CASE WHEN id % 3 = 0 THEN CAST(value AS VARCHAR) ELSE '-' END AS power, CASE WHEN id % 3 = 1 THEN CAST(value AS VARCHAR) ELSE '-' END AS kp, coalesce(CAST(source_rank AS VARCHAR), '-') AS rank, CAST(value AS VARCHAR) AS metric FROM board),
k AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY read, id) AS place FROM c WHERE n <= 40 AND (player <> '-' OR pid <> '-')) SELECT plan, id, CAST(place AS INTEGER) AS place, player, pid AS player_id, power, kp, rank, metric FROM k WHERE place <= 20""")
def analysis(spark, d):
    b, i = r.boards(spark, d), F.col("id")
    kind = F.when(i % 3 == 0, "Power").when(i % 3 == 1, "kill_points").otherwise("x")
    row = F.to_json(F.struct(
        F.when(i % 4 == 0, F.col("name")).alias("name"), F.when(i % 4 == 1, F.concat(F.lit("raw\t"), "name")).otherwise("").alias("governorNameRaw"), F.when(i % 4 != 3, F.col("identity")).otherwise(0).alias("governorId"),
        F.col("value").cast("string").alias("metricRaw"), kind.alias("metricKey"), F.col("source_rank").alias("rank"),
    ))
    out = quality.analysis_rows(b.select(F.col("identity").alias("plan"), F.col("type").alias("read"), i.alias("at"), row.alias("row")))
    return out.select("plan", F.col("at").alias("id"), "place", "player", "player_id", "power", "kp", "rank", "metric")


def stream(spark, d):
    """Events as a stream of observations."""
    schema = r.t(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")  # a glob, as the source wants a folder otherwise
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("player"), F.col("event_type").alias("metric"), F.round(F.col("value") * 100).cast("long").alias("value"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").cast("string").alias("ref"), r.period().alias("period"))


@query("st1_stream_current", " SELECT period, player, event_type AS metric, arg_max(value, row(observed_at, value, ref)) AS value FROM obs JOIN (SELECT event_id, event_type FROM events) ON event_id = id GROUP BY 1, 2, 3")
def stream_current(spark, d):
    path = scratch(spark, "state")
    jobs.upsert_stream(stream(spark, d), path, scratch(spark, "stream")).awaitTermination()
    return jobs.read_state(spark, path).select("period", "player", "metric", "value")


@query("st2_idempotent_ingest", " SELECT DISTINCT player % 20 AS ws, event_type AS scope, player || '-' || (value % 50) AS key FROM obs JOIN (SELECT event_id, event_type FROM events) ON event_id = id")
def idempotent(spark, d):
    s = stream(spark, d).select((F.col("player") % 20).alias("ws"), F.col("metric").alias("scope"), F.concat_ws("-", "player", (F.col("value") % 50)).alias("key"), F.col("observed_at").alias("at"))
    return jobs.run_to_table(jobs.once(s), scratch(spark, "once"), scratch(spark, "stream"), "append").select("ws", "scope", "key")


#: Of a user's requests every twentieth has no key; a request takes up to two hours, and every seventh fails.
REQUEST_SQL = """, rq AS (SELECT id, player % 20 AS ws, metric AS scope, CASE WHEN id % 20 > 0 THEN CAST(player % 60 AS VARCHAR) END AS key, CAST(value % 3 AS VARCHAR) AS h, epoch_ms(observed_at) AS t, id % 7 > 0 AS ok, (id % 120) * 60000 AS took FROM obs),
rn AS (SELECT *, row_number() OVER (PARTITION BY ws, scope, key ORDER BY t, id) AS n FROM rq WHERE key IS NOT NULL),
rs AS (SELECT id, ws, scope, key, n, h, id AS owner, t + took AS done, CASE WHEN ok THEN t + 86400000 ELSE t + took END AS expires, ok, 'processed' AS outcome FROM rn WHERE n = 1
  UNION ALL SELECT x.id, x.ws, x.scope, x.key, x.n, CASE WHEN free THEN x.h ELSE s_h END, CASE WHEN free THEN x.id ELSE owner END, CASE WHEN free THEN x.t + x.took ELSE done END, CASE WHEN free THEN CASE WHEN x.ok THEN x.t + 86400000 ELSE x.t + x.took END ELSE expires END, CASE WHEN free THEN x.ok ELSE s_ok END,
    CASE WHEN free THEN 'processed' WHEN s_h <> x.h THEN 'PAYLOAD_MISMATCH' WHEN s_ok AND x.t >= done THEN 'replayed' ELSE 'IN_PROGRESS' END
  FROM (SELECT x.*, rs.h AS s_h, owner, done, expires, rs.ok AS s_ok, x.t >= expires AS free FROM rs JOIN rn x ON x.ws = rs.ws AND x.scope = rs.scope AND x.key = rs.key AND x.n = rs.n + 1) x)"""


@query("st2_request_outcomes", REQUEST_SQL + " SELECT id, outcome, CASE WHEN outcome IN ('processed', 'replayed') THEN owner END AS answer_of FROM rs UNION ALL SELECT id, 'processed', id FROM rq WHERE key IS NULL")
def request_outcomes(spark, d):
    metric = {"click": "power", "view": "kill_points", "purchase": "contribution_points", "signup": "fort_destroying"}
    names = F.create_map(*[F.lit(x) for kv in metric.items() for x in kv])
    s = stream(spark, d).select("id", (F.col("player") % 20).alias("ws"), F.coalesce(names[F.col("metric")], F.lit("deads")).alias("scope"), F.when(F.col("id") % 20 > 0, (F.col("player") % 60).cast("string")).alias("key"), (F.col("value") % 3).cast("string").alias("payload_hash"), F.col("observed_at").alias("at"), (F.col("id") % 120 * 60000).alias("took_ms"), (F.col("id") % 7 > 0).alias("ok"))
    return jobs.run_to_table(stateful.idempotent(s), scratch(spark, "outcomes"), scratch(spark, "stream"), "append")


@query("st7_stream_decisions", """, a AS (SELECT *, (id * 7919) % 100003 AS arrival FROM obs), b AS (SELECT *, max(row(observed_at, value, ref)) OVER (PARTITION BY period, player, metric ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT a.* EXCLUDE (metric), event_type AS metric FROM a JOIN events ON event_id = id))
SELECT id, CASE WHEN best IS NULL THEN 'created' WHEN best < row(observed_at, value, ref) THEN 'updated' WHEN best = row(observed_at, value, ref) THEN 'equal-precedence' ELSE 'existing-is-newer' END AS decision FROM b""")
def stream_decisions(spark, d):
    s = stream(spark, d).withColumn("arrival", F.col("id") * 7919 % 100003)
    return jobs.run_to_table(stateful.decided(s), scratch(spark, "decided"), scratch(spark, "stream"), "append")


@query("st2_key_conflicts", " SELECT ws, scope, key, count(DISTINCT h) AS payloads FROM (SELECT player % 20 AS ws, metric AS scope, player || '-' || (value % 50) AS key, value AS h FROM obs) GROUP BY 1, 2, 3 HAVING count(DISTINCT h) > 1")
def conflicts(spark, d):
    o = r.observations(spark, d).select((F.col("player") % 20).alias("ws"), F.col("metric").alias("scope"), F.concat_ws("-", "player", (F.col("value") % 50)).alias("key"), F.col("value").alias("payload_hash"))
    return jobs.key_conflicts(o)


@query("st3_stream_weekly", " SELECT strftime(date_trunc('week', observed_at + INTERVAL 180 MINUTE) - INTERVAL 180 MINUTE, '%Y-%m-%d %H:%M') AS week_start, player, event_type AS metric, max(value_c) AS value, count(*) AS n FROM (SELECT id, player, observed_at, value AS value_c FROM obs) JOIN (SELECT event_id, event_type FROM events) ON event_id = id GROUP BY 1, 2, 3")
def stream_weekly(spark, d):
    out = jobs.run_to_table(jobs.weekly(stream(spark, d), 180), scratch(spark, "weekly"), scratch(spark, "stream"))
    return out.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd HH:mm"))


@query("st4_stream_progress", """, cg AS (SELECT player AS job, id % 400 AS task, CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'PROCESSING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS s, row_number() OVER (PARTITION BY player, id % 400 ORDER BY observed_at, id) AS n FROM obs JOIN (SELECT event_id, event_type FROM events) ON event_id = id),
st AS (SELECT job, task, n, s FROM cg WHERE n = 1 UNION ALL SELECT c.job, c.task, c.n, CASE WHEN st.s || '>' || c.s IN ('QUEUED>PROCESSING', 'QUEUED>FAILED', 'PROCESSING>QUEUED', 'PROCESSING>COMPLETED', 'PROCESSING>FAILED', 'FAILED>QUEUED') THEN c.s ELSE st.s END FROM st JOIN cg c ON c.job = st.job AND c.task = st.task AND c.n = st.n + 1),
s AS (SELECT job, task, arg_max(s, n) AS s FROM st GROUP BY 1, 2)
SELECT job, count(*) AS total, count(*) FILTER (s IN ('COMPLETED', 'FAILED')) AS processed, CASE WHEN count(*) FILTER (s IN ('COMPLETED', 'FAILED')) < count(*) THEN 'PROCESSING' WHEN count(*) FILTER (s = 'FAILED') = count(*) THEN 'FAILED' ELSE 'REVIEW' END AS job_status FROM s GROUP BY 1""")
def stream_progress(spark, d):
    m = F.col("metric")
    status = F.when(m == "click", "QUEUED").when(m == "view", "PROCESSING").when(m == "error", "FAILED").otherwise("COMPLETED")
    changes = stream(spark, d).select(F.col("player").alias("job"), (F.col("id") % 400).alias("task"), status.alias("status"), F.lit(False).alias("low_confidence"), F.col("observed_at").alias("updated_at"), "id")
    states = jobs.run_to_table(jobs.moved(changes), scratch(spark, "tasks"), scratch(spark, "stream"), "update")
    return jobs.progress(states).select("job", "total", "processed", "job_status")


DRAIN_SQL = """, dr AS (SELECT id, player % 3 = 0 AS no_player, period = '2024-W05' AS no_period, value - 500 AS value, id % 3 AS attempts, CASE id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'SUCCEEDED' ELSE 'PROCESSING' END AS before FROM obs),
dn AS (SELECT id, before IN ('PENDING', 'FAILED') AS tried, CASE WHEN value <= 0 THEN 'Skipped invalid profile metrics' WHEN no_player THEN 'unknown player' WHEN no_period THEN 'unknown event' END AS e, before, attempts FROM dr)"""


def drained_rows(spark, d):
    k = F.col("id") % 4
    s = stream(spark, d).select("id", "player", "period", (F.col("value") - 500).alias("value"), F.when(k == 0, "PENDING").when(k == 1, "FAILED").when(k == 2, "SUCCEEDED").otherwise("PROCESSING").alias("status"), (F.col("id") % 3).alias("attempts"))
    players = r.observations(spark, d).filter("player % 3 > 0").select("player")
    periods = r.observations(spark, d).filter("period <> '2024-W05'").select("period")
    return jobs.run_to_table(jobs.drained(s, players, periods), scratch(spark, "drained"), scratch(spark, "stream"), "append")


@query("st5_drained_backlog", DRAIN_SQL + " SELECT id, CASE WHEN tried THEN CASE WHEN e IS NULL THEN 'SUCCEEDED' ELSE 'FAILED' END ELSE before END AS status, attempts + CASE WHEN tried THEN 1 ELSE 0 END AS attempts, CASE WHEN tried THEN e END AS error FROM dn")
def drained(spark, d):
    return drained_rows(spark, d).select("id", "status", "attempts", "error")


@query("st5_drain_counts", DRAIN_SQL + " SELECT count(*) FILTER (tried) AS processed, count(*) FILTER (tried AND e IS NULL) AS succeeded, count(*) FILTER (tried AND e IS NOT NULL) AS failed FROM dn")
def drain_counts(spark, d):
    return jobs.drain_counts(drained_rows(spark, d))


#: Events as profiles that wait to be synchronised: every third has no event of its own, every fifth names its player by game id.
QUEUE_SQL = """, qu AS (SELECT id, player, CASE WHEN id % 3 > 0 THEN period WHEN id % 2 = 0 THEN '2024-W01' END AS ev, value % 1000 - 50 AS power, value AS kp, value % 7 AS t4, value % 5 AS t5, value % 3 AS deads, observed_at, player % 4 > 0 AS known FROM obs),
qt AS (SELECT *, coalesce(ev, '2024-W02') AS event, CASE WHEN power <= 0 THEN 'Skipped invalid profile metrics: power is zero or missing' WHEN coalesce(ev, '2024-W02') = '2024-W03' THEN 'Event missing for backlog entry.' WHEN NOT known THEN 'Governor mapping missing for backlog entry.' END AS error, max(observed_at) OVER () AS now FROM qu)"""


def drained_queue(spark, d):
    s, i = stream(spark, d), F.col("id")
    by_game = i % 5 == 0
    none = F.lit(None).cast("string")
    rows = s.select(
        "id", F.col("observed_at").alias("created_at"), F.when(~by_game, F.col("player")).alias("player"), F.when(by_game, F.concat(F.lit("g"), "player")).otherwise(none).alias("game_id"), F.when(i % 3 > 0, F.col("period")).alias("linked_event"), F.when((i % 3 == 0) & (i % 2 == 0), "2024-W01").alias("job_event"),
        (F.col("value") % 1000 - 50).alias("power"), F.col("value").alias("kp"), (F.col("value") % 7).alias("t4"), (F.col("value") % 5).alias("t5"), (F.col("value") % 3).alias("deads"), "observed_at", none.alias("ref"),
    )
    o = r.observations(spark, d)
    players = o.filter("player % 4 > 0").select("player").distinct().withColumn("game_id", F.concat(F.lit("g"), "player"))
    events = o.select(F.col("period").alias("event")).unionByName(spark.createDataFrame([("2024-W01",), ("2024-W02",)], "event string")).distinct().filter("event <> '2024-W03'")
    path = scratch(spark, "retry")
    retry.drain_stream(rows, path, scratch(spark, "stream"), players, events, "2024-W02").awaitTermination()
    return path


@query("st5_retry_queue", QUEUE_SQL + " SELECT id, CASE WHEN error IS NULL THEN 'COMPLETED' ELSE 'FAILED' END AS status, 1 AS attempts, error, CASE WHEN error IS NULL THEN event END AS event, strftime(CASE WHEN error IS NULL THEN observed_at ELSE now + INTERVAL 2 SECOND END, '%Y-%m-%d %H:%M:%S') AS available_at FROM qt")
def retry_queue(spark, d):
    q = retry.read_queue(spark, drained_queue(spark, d))
    return q.select("id", "status", "attempts", "error", "event", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))


@query("st5_drained_snapshots", QUEUE_SQL + " SELECT event, player, arg_max(power, id) AS power, arg_max(kp, id) AS kp, arg_max(t4, id) AS t4, arg_max(t5, id) AS t5, arg_max(deads, id) AS deads FROM qt WHERE error IS NULL GROUP BY 1, 2")
def drained_snapshots(spark, d):
    return retry.read_effects(spark, drained_queue(spark, d))[0].drop("confidence")


@query("st5_drained_observations", QUEUE_SQL + """, ob AS (SELECT event, player, 'power' AS metric, power AS value, observed_at AS at, 'backlog:' || id || ':power' AS ref FROM qt WHERE error IS NULL UNION ALL SELECT event, player, 'kill_points', kp, observed_at, 'backlog:' || id || ':kill_points' FROM qt WHERE error IS NULL)
SELECT event, player, metric, arg_max(value, row("at", value, ref)) AS value, arg_max(ref, row("at", value, ref)) AS ref FROM ob GROUP BY 1, 2, 3""")
def drained_observations(spark, d):
    return retry.read_effects(spark, drained_queue(spark, d))[1].select("event", "player", "metric", "value", "ref")


@query("a11_workspace_tasks", " SELECT type, status, CAST(n AS BIGINT) AS n, CAST(rank() OVER (PARTITION BY type ORDER BY n DESC, status) AS INTEGER) AS place FROM (SELECT type, status, count(*) AS n FROM board GROUP BY 1, 2)")
def workspace_tasks(spark, d):
    n = r.boards(spark, d).groupBy("type", "status").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.partitionBy("type").orderBy(F.desc("n"), "status")))


@query("p30_ranking_payload", """, x AS (SELECT run, pos, source_rank, name, digits, CASE WHEN confidence > 100 THEN 100 ELSE confidence END AS c FROM captured), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) - 1 AS "at" FROM x WHERE digits <> ''),
g AS (SELECT run, count(*) FILTER (digits <> '') AS n, bool_or(c < 70) FILTER (digits <> '') AS low FROM x GROUP BY 1)
SELECT g.run, CASE WHEN n > 0 THEN 'ranking_board' ELSE 'unknown' END AS archetype, CASE WHEN g.run % 4 = 3 THEN 'blur' || CASE WHEN n = 0 THEN ',no-rows' ELSE '' END WHEN n = 0 THEN 'no-rows' ELSE '' END AS reasons, coalesce(low, false) OR g.run % 4 = 3 OR n = 0 AS low_confidence, CAST("at" AS INTEGER) AS "at", source_rank AS rank, name, digits AS metric, CAST(c AS DOUBLE) AS confidence FROM g LEFT JOIN k USING (run)""")
def ranking_payload(spark, d):
    c = r.captured(spark, d)
    row = F.struct("pos", F.struct(F.col("source_rank").cast("string").alias("rank"), F.concat(F.lit(" "), "name", F.lit("é")).alias("name"), F.concat(F.lit("p"), "digits").alias("metric"), "confidence").alias("r"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("rows")
    runs = c.groupBy("run").agg(rows).select("run", F.to_json(F.struct(F.when(F.col("run") % 4 == 3, F.array(F.lit("blur"), F.lit("blur"))).alias("failureReasons"), "rows")).alias("payload"))
    return quality.ranking_payload(runs)


@query("p30_profile_payload", """, x AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey * 1000 AS VARCHAR) ELSE '' END AS "governorId", c_name AS "governorName", CAST(round(abs(c_acctbal) * 100) AS BIGINT) || '' AS power, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS "killPoints", CAST(CASE WHEN c_custkey % 2 = 0 THEN 80 ELSE 70 END AS DOUBLE) AS confidence FROM customer)
SELECT *, CASE WHEN id % 5 = 0 THEN 'blur' ELSE '' END AS reasons, confidence < 75 OR "governorId" = '' OR "killPoints" = '' AS low_confidence FROM x""")
def profile_payload(spark, d):
    c, k = r.t(spark, d, "customer"), F.col("c_custkey")
    cents = F.round(F.abs("c_acctbal") * 100).cast("long").cast("string")
    payload = F.to_json(F.struct(
        F.when(k % 3 > 0, F.concat(F.lit("ID:"), (k * 1000).cast("string"))).alias("governorId"), F.concat(F.lit(" "), "c_name", F.lit("é")).alias("governorName"), F.concat(cents, F.lit(" pts")).alias("power"),
        F.when(k % 7 > 0, k.cast("string")).alias("killPoints"), F.when(k % 2 == 0, 0.8).otherwise(70.0).alias("confidence"), F.when(k % 5 == 0, F.array(F.lit("blur"), F.lit(" "), F.lit("blur"))).alias("failureReasons"),
    ))
    out = quality.profile_payload(c.select(k.alias("id"), payload.alias("payload")))
    return out.select("id", "governorId", "governorName", "power", "killPoints", "confidence", "reasons", "low_confidence")


@query("s1_scoped_read", " SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def scoped(spark, d):
    from boardlake.sources.tables import read_table

    return read_table(spark, f"{d}/customer.parquet", workspace="BUILDING", scope="c_mktsegment").select("c_custkey", "c_name")
