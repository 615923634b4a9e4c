"""The registry of queries over the driver's tables, and how those tables stand for the domain's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = "WITH RECURSIVE " + CTES + sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Each mapping below has its SQL twin in CTES.

def players(spark: SparkSession, d: str) -> DataFrame:
    """Customers: player, name, alliance (their nation), power (balance in cents)."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("alliance"))
    c = t(spark, d, "customer").join(F.broadcast(n), "c_nationkey")
    return c.select(F.col("c_custkey").alias("player"), F.col("c_name").alias("name"), "alliance", F.round(F.col("c_acctbal") * 100).cast("long").alias("power"))


def period() -> F.Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Events: kinds of events are metrics, weeks are periods, values are hundredths."""
    metric = F.when(F.col("event_type") == "click", "power").when(F.col("event_type") == "view", "kill_points").when(F.col("event_type") == "purchase", "contribution_points").when(F.col("event_type") == "signup", "fort_destroying").otherwise("deads")
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("player"), metric.alias("metric"), F.round(F.col("value") * 100).cast("long").alias("value"), F.col("ts").alias("observed_at"), F.col("event_id").cast("string").alias("ref"), period().alias("period"))


def boards(spark: SparkSession, d: str) -> DataFrame:
    """Orders: priorities are boards, customers identities, totals values."""
    o = t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "UNRESOLVED").otherwise("REJECTED")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.lit("power").alias("metric"), F.col("o_custkey").alias("identity"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("name"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"), F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 50 + 1).cast("int")).alias("source_rank"), status.alias("status"), F.col("o_orderdate").alias("updated_at"), F.date_trunc("month", "o_orderdate").alias("created_at"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Players' weeks: largest value of each kind of event."""
    o = observations(spark, d)
    of = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0))
    return o.groupBy("player", F.col("period").alias("at")).agg(of("power").alias("power"), of("kill_points").alias("kp"), of("contribution_points").alias("t4"), of("fort_destroying").alias("t5"), of("deads").alias("deads"))


def captured(spark: SparkSession, d: str) -> DataFrame:
    """Line items: rows of captured runs (orders); pos numbers a run's rows in a total order of all columns. Runs are dealt once, to
    as many tasks as there are rows for."""
    from boardlake.functions.dealing import dealt

    li = t(spark, d, "lineitem")
    li = dealt(li.withColumnRenamed("l_orderkey", "run"), li.count(), "run")
    from pyspark.sql.window import Window

    pos = F.row_number().over(Window.partitionBy("run").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select("run", pos.alias("pos"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("source_rank"), F.when(F.col("l_partkey") % 11 == 0, "Kill Points").otherwise(F.concat(F.lit("m"), (F.col("l_partkey") % 5).cast("string"))).alias("name"), cents.alias("value"), F.when(F.col("l_suppkey") % 9 == 0, "n/a").otherwise(cents.cast("string")).alias("metric_raw"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(cents.cast("string")).alias("digits"), (F.col("l_quantity") + 50).alias("confidence"))


CTES = """
players AS (SELECT c_custkey AS player, c_name AS name, n_name AS alliance, CAST(round(c_acctbal * 100) AS BIGINT) AS power FROM customer JOIN nation ON c_nationkey = n_nationkey),
obs AS (SELECT event_id AS id, user_id AS player, CASE event_type WHEN 'click' THEN 'power' WHEN 'view' THEN 'kill_points' WHEN 'purchase' THEN 'contribution_points' WHEN 'signup' THEN 'fort_destroying' ELSE 'deads' END AS metric,
  CAST(round(value * 100) AS BIGINT) AS value, ts AS observed_at, CAST(event_id AS VARCHAR) AS ref, strftime(ts, '%G-W%V') AS period FROM events),
board AS (SELECT o_orderkey AS id, o_orderpriority AS type, 'power' AS metric, o_custkey AS identity, 'p' || o_custkey AS name, CAST(round(o_totalprice * 100) AS BIGINT) AS value,
  CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 50 + 1 AS INTEGER) END AS source_rank, CASE o_orderstatus WHEN 'F' THEN 'ACTIVE' WHEN 'O' THEN 'UNRESOLVED' ELSE 'REJECTED' END AS status,
  o_orderdate AS updated_at, date_trunc('month', o_orderdate) AS created_at FROM orders),
snaps AS (SELECT player, period AS "at", coalesce(max(CASE metric WHEN 'power' THEN value END), 0) AS power, coalesce(max(CASE metric WHEN 'kill_points' THEN value END), 0) AS kp,
  coalesce(max(CASE metric WHEN 'contribution_points' THEN value END), 0) AS t4, coalesce(max(CASE metric WHEN 'fort_destroying' THEN value END), 0) AS t5, coalesce(max(CASE metric WHEN 'deads' THEN value END), 0) AS deads FROM obs GROUP BY 1, 2),
captured AS (SELECT l_orderkey AS run, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS pos,
  CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS source_rank, CASE WHEN l_partkey % 11 = 0 THEN 'Kill Points' ELSE 'm' || (l_partkey % 5) END AS name, CAST(round(l_extendedprice * 100) AS BIGINT) AS value,
  CASE WHEN l_suppkey % 9 = 0 THEN 'n/a' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS metric_raw, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS digits,
  l_quantity + 50 AS confidence FROM lineitem)
"""
