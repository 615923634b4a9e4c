"""Upkeep of stored tables: weeks made on demand, traces of stale runs archived in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.functions.weeks import offset_minutes, week_identity
from boardlake.sources.scratch import written

EVENT = ["ws", "event", "week_key", "name", "description", "starts_at", "ends_at", "created_at", "auto"]
DEFAULT_OFFSET = "+00:00"


def missing_weeks(rows: DataFrame, events: DataFrame, settings: DataFrame, now: Column, between: bool = False) -> DataFrame:
    """The weekly events (EVENT) that the workspaces lack for their ``rows`` (ws, at): one for each week, of the workspace's reset
    offset (``settings``: ws, offset; +00:00 where there is none or it is malformed). With ``between`` also for the weeks from the
    first to the last of these. An event's id is made of workspace and week, so what is appended by two runs is the same row."""
    offset = F.coalesce(offset_minutes(F.col("offset")), F.lit(0))
    shown = F.when(offset_minutes(F.col("offset")).isNotNull(), F.col("offset")).otherwise(F.lit(DEFAULT_OFFSET))
    x = rows.filter("at is not null").select("ws", "at").join(settings.select("ws", "offset"), "ws", "left").withColumns({"_m": offset, "_o": shown})
    starts = x.select("ws", "_m", "_o", week_identity(F.col("at"), F.col("_m"))["starts_at"].alias("s")).distinct()
    if between:
        starts = starts.groupBy("ws", "_m", "_o").agg(F.min("s").alias("a"), F.max("s").alias("b")).select("ws", "_m", "_o", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("s"))
    w = week_identity(F.col("s"), F.col("_m"))
    made = starts.select("ws", w["key"].alias("week_key"), w["starts_at"].alias("starts_at"), w["ends_at"].alias("ends_at"), "_o")
    lacking = made.join(events.select("ws", "week_key").distinct(), ["ws", "week_key"], "left_anti")
    name = F.concat(F.lit("Weekly Activity "), "week_key", F.lit(" ("), F.date_format("starts_at", "MMM d"), F.lit(")"))
    text = F.concat(F.lit("Auto-generated weekly roster tracking window ("), "_o", F.lit(" reset)."))
    new = {"event": F.concat_ws(":", F.col("ws").cast("string"), "week_key"), "name": name, "description": text, "created_at": now.cast("timestamp"), "auto": F.lit(True)}
    return lacking.withColumns(new).select(*EVENT)


def with_event(rows: DataFrame, events: DataFrame, settings: DataFrame) -> DataFrame:
    """``rows`` (ws, at, linked_event, job_event) with their event: the linked one, else the job's, else that of the week of ``at``
    (of several for a week the one made last), null without any."""
    offset = F.coalesce(offset_minutes(F.col("_offset")), F.lit(0))
    own = events.groupBy("ws", "week_key").agg(F.max_by("event", F.struct("created_at", "event")).alias("_week_event"))
    x = rows.join(settings.select("ws", F.col("offset").alias("_offset")), "ws", "left").withColumn("week_key", week_identity(F.col("at"), offset)["key"])
    out = x.join(own, ["ws", "week_key"], "left").withColumn("event", F.coalesce("linked_event", "job_event", "_week_event"))
    return out.select(*rows.columns, "event")


def ensure_weeks(spark: SparkSession, path: str, rows: DataFrame, settings: DataFrame, now: Column) -> DataFrame:
    """Append what ``missing_weeks`` finds to the events at ``path``, and read them; events of one id count once."""
    ddl = "ws bigint, event string, week_key string, name string, description string, starts_at timestamp, ends_at timestamp, created_at timestamp, auto boolean"
    rest = [c for c in EVENT if c not in ("ws", "event")]

    def held() -> DataFrame:
        return spark.read.schema(ddl).parquet(path).groupBy("ws", "event").agg(F.min_by(F.struct(*rest), "created_at").alias("r")).select("ws", "event", "r.*").select(*EVENT)

    written(missing_weeks(rows, held(), settings, now), "weeks").write.mode("append").parquet(path)
    return held()


def archive_runs(spark: SparkSession, runs_path: str, rows_path: str, now: str, older_than_days: int | None = None, limit: int | None = None) -> DataFrame:
    """take the traces of stale runs out of two tables in place; returns one row: scanned, archived_runs, archived_rows.

    Stale runs are MERGED or FAILED ones that were processed more than ``older_than_days`` (7 to 365, 45 by default) before ``now``, the
    ``limit`` oldest, or all. ``runs``: month, run, status, processed_at, metadata (a map); ``rows``: month, run, ocr_trace,
    candidates and others; both partitioned by the run's month. Only partitions that hold stale runs are written, each replaced as
    a whole when it is done, so a repeated or interrupted run ends in the same tables. Months of stale runs are few enough to be
    named in a filter."""
    days = max(7, min(365, 45 if older_than_days is None else older_than_days))
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    runs = spark.read.parquet(runs_path)
    old = runs.filter(F.col("status").isin("MERGED", "FAILED") & (F.col("processed_at") < cutoff))
    stale = written((old if limit is None else old.orderBy("processed_at", "run").limit(limit)).select("month", "run"), "stale-runs")
    months = [r.month for r in stale.select("month").distinct().collect()]
    own = stale.select("run", F.lit(True).alias("_stale"))
    stamp = F.create_map(F.lit("archivedRawRowsAt"), F.lit(now), F.lit("archivedRawRowsOlderThanDays"), F.lit(str(days)))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("archivedRawRowsAt", "archivedRawRowsOlderThanDays"))
    counts = spark.read.parquet(rows_path).filter(F.col("month").isin(months)).join(own, "run", "left_semi").agg(F.count("*").alias("archived_rows"))
    counts = written(counts, "archived")
    for path, changes in ((rows_path, ("ocr_trace", "candidates")), (runs_path, ("metadata",))):
        table = spark.read.parquet(path)
        x = table.filter(F.col("month").isin(months)).join(own, "run", "left")
        new = {c: F.when(F.col("_stale"), F.map_concat(kept, stamp) if c == "metadata" else F.lit(None)).otherwise(F.col(c)) for c in changes}
        out = x.withColumns(new).select(*table.columns)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return stale.agg(F.count("*").alias("scanned")).select("scanned", F.col("scanned").alias("archived_runs")).crossJoin(counts)  # one row each
