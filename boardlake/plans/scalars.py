"""Queries of the scalar functions, over names, types and numbers of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlake.functions import text, weeks
from boardlake.plans import registry as r
from boardlake.plans.registry import query

RAW_SQL = """, raw AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '  Kill   Points RANKINGS' WHEN 1 THEN 'Individual Power Ranking' WHEN 2 THEN p_name || ' Rankings' WHEN 3 THEN '__' || p_type || '--' WHEN 4 THEN 'FORT destroying' ELSE ' ' END AS s, CASE p_partkey % 4 WHEN 0 THEN 'KP' WHEN 1 THEN 'Power ' WHEN 2 THEN ' tech-contribution' ELSE p_brand END AS m,
  replace(replace(CAST(p_retailprice AS VARCHAR), '0', 'O'), '1', 'l') || CASE WHEN p_partkey % 3 = 0 THEN ' S' ELSE ',BZ0' END AS n, p_size, p_name FROM part)"""
SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
SPACES = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
BOARD = "(SELECT coalesce(MAP {'individual_power': 'individual_power', 'kill_points': 'kill_point', 'kill_point': 'kill_point', 'fort_destroying': 'fort_destroyer'}[b], b) FROM (SELECT coalesce(nullif(" + SLUG.format("trim(regexp_replace(" + SPACES.format("s") + ", '(?i)RANKINGS?$', ''))") + ", ''), 'unknown') AS b))"
METRIC = "(SELECT coalesce(MAP {'kp': 'kill_points', 'power': 'power', 'tech_contribution': 'contribution_points'}[b], b) FROM (SELECT coalesce(nullif(" + SLUG.format(SPACES.format("m")) + ", ''), 'metric') AS b))"


def raw(spark, d):
    p, k = r.t(spark, d, "part"), F.col("p_partkey")
    s = F.when(k % 6 == 0, "  Kill   Points RANKINGS").when(k % 6 == 1, "Individual Power Ranking").when(k % 6 == 2, F.concat("p_name", F.lit(" Rankings"))).when(k % 6 == 3, F.concat(F.lit("__"), "p_type", F.lit("--"))).when(k % 6 == 4, "FORT destroying").otherwise(" ")
    m = F.when(k % 4 == 0, "KP").when(k % 4 == 1, "Power ").when(k % 4 == 2, " tech-contribution").otherwise(F.col("p_brand"))
    n = F.concat(F.translate(F.col("p_retailprice").cast("string"), "01", "Ol"), F.when(k % 3 == 0, " S").otherwise(",BZ0"))
    return p.select(k.alias("id"), s.alias("s"), m.alias("m"), n.alias("n"), "p_size", "p_name")


@query("p1_board_type", RAW_SQL + f" SELECT id, {BOARD} AS board FROM raw")
def board_type(spark, d):
    return raw(spark, d).select("id", text.board_type(F.col("s")).alias("board"))


@query("p2_metric_key", RAW_SQL + f" SELECT id, {METRIC} AS metric FROM raw")
def metric_key(spark, d):
    return raw(spark, d).select("id", text.metric_key(F.col("m")).alias("metric"))


@query("p3_board_check", RAW_SQL + f""", x AS (SELECT id, {BOARD} AS board, {METRIC} AS metric FROM raw), y AS (SELECT *, MAP {{'individual_power': 'power', 'mad_scientist': 'contribution_points', 'fort_destroyer': 'fort_destroying', 'kill_point': 'kill_points'}}[board] AS expected FROM x)
SELECT id, expected IS NOT NULL AND expected = metric AS ok, expected, CASE WHEN expected IS NULL THEN 'Unsupported rankingType "' || board || '".' WHEN metric <> expected THEN 'rankingType "' || board || '" requires metricKey "' || expected || '" (received "' || metric || '").' END AS reason FROM y""")
def board_check(spark, d):
    return raw(spark, d).select("id", text.board_check(F.col("s"), F.col("m")).alias("c")).select("id", "c.ok", "c.expected", "c.reason")


@query("p8_repaired_number", RAW_SQL + ", x AS (SELECT id, regexp_replace(translate(upper(trim(n)), 'OQDI|LSBGZ', '0001115862'), '[^0-9]', '', 'g') AS digits FROM raw) SELECT id, digits, coalesce(TRY_CAST(nullif(digits, '') AS BIGINT), 0) AS value FROM x")
def repaired(spark, d):
    return raw(spark, d).select("id", text.repaired_digits(F.col("n")).alias("digits"), text.repaired_number(F.col("n")).alias("value"))


@query("p9_metric_evidence", RAW_SQL + r", x AS (SELECT id, n, list_filter(regexp_split_to_array(regexp_replace(n, '[^0-9,.'' ]', '', 'g'), '[,.'' ]+'), lambda p: p <> '') AS parts FROM raw) SELECT id, regexp_matches(n, '[0-9]') AS has_digit, substr(regexp_replace(translate(upper(n), 'OQDI|LSBGZ', '0001115862'), '[^0-9]', '', 'g'), 1, 14) AS digits, len(parts) <= 1 OR (length(parts[1]) BETWEEN 1 AND 3 AND len(list_filter(parts[2:], lambda p: length(p) <> 3)) = 0) AS grouping_ok FROM x")
def evidence(spark, d):
    return raw(spark, d).select("id", text.metric_evidence(F.col("n")).alias("e")).select("id", "e.has_digit", "e.digits", "e.grouping_ok")


@query("p15_percent", " SELECT l_orderkey AS run, l_linenumber, l_partkey, l_extendedprice, least(100.0, CASE WHEN l_quantity * 4 - 1 <= 1 THEN greatest(0, (l_quantity * 4 - 1) * 100) ELSE l_quantity * 4 - 1 END) AS percent, least(100, l_discount * 100) AS share FROM lineitem")
def percent(spark, d):
    li = r.t(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("run"), "l_linenumber", "l_partkey", "l_extendedprice", text.percent(F.col("l_quantity") * 4 - 1).alias("percent"), text.percent(F.col("l_discount")).alias("share"))


@query("p16_valid_rank", " SELECT p_partkey AS id, CASE WHEN floor(p_retailprice * 3 - 2000) BETWEEN 1 AND 5000 THEN CAST(floor(p_retailprice * 3 - 2000) AS INTEGER) END AS rank FROM part")
def rank(spark, d):
    return r.t(spark, d, "part").select(F.col("p_partkey").alias("id"), text.valid_rank(F.col("p_retailprice") * 3 - 2000).alias("rank"))


@query("p20_week_identity", """, x AS (SELECT id, observed_at, o FROM obs, (SELECT unnest([0, 180, -300]) AS o)), y AS (SELECT id, o, observed_at + o * INTERVAL 1 MINUTE AS l FROM x)
SELECT id, CAST(o AS INTEGER) AS minutes, strftime(l, '%G-W%V') AS week, strftime(date_trunc('week', l) - o * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M') AS starts_at, strftime(date_trunc('week', l) - o * INTERVAL 1 MINUTE + INTERVAL 7 DAY, '%Y-%m-%d %H:%M') AS ends_at FROM y""")
def week_identity(spark, d):
    o = r.observations(spark, d).withColumn("off", F.explode(F.array(*[F.lit(x) for x in ("+00:00", "+03:00", "-05:00")])))
    m = weeks.offset_minutes(F.col("off"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return o.select("id", m.alias("minutes"), weeks.week_identity(F.col("observed_at"), m).alias("w")).select("id", "minutes", F.col("w.key").alias("week"), at("w.starts_at").alias("starts_at"), at("w.ends_at").alias("ends_at"))


@query("p21_week_range", """, x AS (SELECT player, player % 60 AS w FROM players) SELECT player, CASE WHEN w BETWEEN 1 AND 53 THEN strftime(date_trunc('week', DATE '2024-01-04') + (w - 1) * INTERVAL 7 DAY - INTERVAL 180 MINUTE, '%Y-%m-%d %H:%M') END AS starts_at FROM x""")
def week_range(spark, d):
    p = r.players(spark, d).withColumn("key", F.concat(F.lit("2024-W"), F.lpad((F.col("player") % 60).cast("string"), 2, "0")))
    return p.select("player", F.date_format(weeks.week_range(F.col("key"), F.lit(180))["starts_at"], "yyyy-MM-dd HH:mm").alias("starts_at"))


@query("p22_labels", """, x AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'WEEKLY' WHEN 1 THEN 'KVK_END' WHEN 2 THEN 'OSIRIS' WHEN 3 THEN 'NEW_KIND' ELSE '' END AS k, p_name FROM part)
SELECT id, CASE WHEN k = 'WEEKLY' THEN 'system' WHEN k = 'KVK_END' THEN 'legacy' ELSE 'manual' END AS class, CASE k WHEN 'WEEKLY' THEN 'Weekly Check' WHEN 'KVK_END' THEN 'KvK' WHEN 'OSIRIS' THEN 'Ark of Osiris' WHEN '' THEN 'Unknown' ELSE k END AS label,
  array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM x""")
def labels(spark, d):
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, "WEEKLY").when(k == 1, "KVK_END").when(k == 2, "OSIRIS").when(k == 3, "NEW_KIND").otherwise("")
    return r.t(spark, d, "part").select(F.col("p_partkey").alias("id"), text.event_class(kind).alias("class"), text.event_label(kind).alias("label"), text.board_label(F.col("p_name")).alias("title"))


@query("p23_archetype", ", x AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'Governor PROFILE' WHEN 1 THEN ' my-Ranking board' ELSE p_name END AS h FROM part) SELECT id, CASE WHEN lower(h) LIKE '%profile%' THEN 'governor_profile' WHEN lower(h) LIKE '%ranking%' THEN 'ranking_board' ELSE 'unknown' END AS archetype, CASE WHEN lower(h) LIKE '%ranking%' AND lower(h) NOT LIKE '%profile%' THEN 'RANKING_CAPTURE' ELSE 'PROFILE_SNAPSHOT' END AS domain FROM x")
def archetype(spark, d):
    k = F.col("p_partkey") % 3
    a = text.archetype(F.when(k == 0, "Governor PROFILE").when(k == 1, " my-Ranking board").otherwise(F.col("p_name")))
    return r.t(spark, d, "part").select(F.col("p_partkey").alias("id"), a.alias("archetype"), text.ingestion_domain(a).alias("domain"))


@query("p24_compact", """, v AS (SELECT id, CAST(value * CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 64 ELSE 0 END // CASE WHEN id % 5 = 0 THEN 1000000 ELSE 1 END - 128 AS BIGINT) AS v FROM board UNION ALL SELECT id + 1000000, (id % 10000) * 10 - 50000 FROM board UNION ALL SELECT id + 2000000, (id % 10000) * 50000 FROM board),
y AS (SELECT *, CASE WHEN abs(v) >= 1e9 THEN 1e9 WHEN abs(v) >= 1e6 THEN 1e6 WHEN abs(v) >= 1e3 THEN 1e3 END::DOUBLE AS unit FROM v), x AS (SELECT *, abs(v)::DOUBLE / unit AS x FROM y),
z AS (SELECT *, CASE WHEN x * 4 = floor(x * 4) AND CAST(x * 4 AS BIGINT) % 2 = 1 THEN ((CAST(floor(x * 10) AS BIGINT) + 1) // 10) || '.' || ((CAST(floor(x * 10) AS BIGINT) + 1) % 10) ELSE printf('%.1f', x) END AS s FROM x)
SELECT id, v, CASE WHEN v > 0 THEN '+' ELSE '' END || CASE WHEN unit IS NULL THEN CAST(v AS VARCHAR) ELSE CASE WHEN v < 0 THEN '-' ELSE '' END || regexp_replace(s, '\\.0$', '') || CASE unit WHEN 1e9 THEN 'B' WHEN 1e6 THEN 'M' ELSE 'K' END END AS text FROM z""")
def compact(spark, d):
    b = r.boards(spark, d).withColumn("v", F.expr("value * case id % 3 when 0 then 1 when 1 then 64 else 0 end div case when id % 5 = 0 then 1000000 else 1 end - 128"))
    tens = r.boards(spark, d).select((F.col("id") + 1000000).alias("id"), (F.col("id") % 10000 * 10 - 50000).alias("v"))
    halves = r.boards(spark, d).select((F.col("id") + 2000000).alias("id"), (F.col("id") % 10000 * 50000).alias("v"))
    b = b.select("id", "v").unionByName(tens).unionByName(halves)
    return b.select("id", "v", text.signed_compact(F.col("v")).alias("text"))


@query("p26_correction_reason", """, x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'power' ELSE 'governorName' END AS f, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE CAST(p_partkey AS VARCHAR) || p_name END AS a, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_type || '12345' ELSE CAST(p_partkey + 1 AS VARCHAR) || p_name END AS b FROM part),
y AS (SELECT *, regexp_replace(a, '[^0-9]', '', 'g') AS da, regexp_replace(b, '[^0-9]', '', 'g') AS db FROM x)
SELECT id, CASE WHEN a = b THEN 'no_change' WHEN f = 'power' THEN CASE WHEN da = '' AND db <> '' THEN 'threshold_failure' WHEN abs(length(da) - length(db)) >= 2 THEN 'crop_drift' WHEN length(da) = length(db) THEN 'digit_confusion' ELSE 'numeric_adjustment' END
  ELSE CASE WHEN trim(a) = '' AND trim(b) <> '' THEN 'name_empty_fix' WHEN abs(length(a) - length(b)) >= 4 THEN 'name_crop_drift' ELSE 'name_typo_fix' END END AS reason FROM y""")
def correction(spark, d):
    k = F.col("p_partkey")
    a = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 1, "").otherwise(F.concat(k.cast("string"), "p_name"))
    b = F.when(k % 7 == 0, F.col("p_name")).when(k % 7 == 1, F.concat("p_type", F.lit("12345"))).otherwise(F.concat((k + 1).cast("string"), "p_name"))
    return r.t(spark, d, "part").select(k.alias("id"), text.correction_reason(F.when(k % 2 == 0, "power").otherwise("governorName"), a, b).alias("reason"))


@query("p6_alias_key", " SELECT player, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM players")
def alias_key(spark, d):
    from boardlake.functions.vectorized import normalize_alias

    names = r.players(spark, d).select("player", "name")
    keys = names.select("name").distinct().withColumn("key", normalize_alias("name"))
    return names.join(keys, "name").select("player", "key")
