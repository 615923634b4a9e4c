"""ST5, ST6: a retry queue over Structured Streaming: due rows are tried, failed ones wait, effects are written once.

Everything is kept as tables of versions, one for each batch, below one folder: ``queue`` (rows that the batch brought or tried, as
they are then), ``snapshots`` and ``observations`` (what its successes did). A batch reads the versions before its own and
overwrites its own, so a repeated batch leaves the same tables, and readers fold what is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boardlake.functions.dealing import dealt
from boardlake.operators import observations, ops
from boardlake.sources.scratch import written

MOST_ATTEMPTS = 3
QUEUE = "id bigint, created_at timestamp, player bigint, game_id string, linked_event string, job_event string, power bigint, kp bigint, t4 bigint, t5 bigint, deads bigint, observed_at timestamp, ref string"
STATE = f"{QUEUE}, status string, attempts int, available_at timestamp, event string, error string, processed_at timestamp"
SNAPSHOTS = "event string, player bigint, power bigint, kp bigint, t4 bigint, t5 bigint, deads bigint, confidence int, at timestamp, id bigint"
OBSERVATIONS = "event string, player bigint, metric string, value bigint, ref string, observed_at timestamp"


def is_due(now: Column, most_attempts: int = MOST_ATTEMPTS) -> Column:
    """Whether a row is to be tried ``now``: PENDING or FAILED, available, and tried fewer times than allowed."""
    return F.coalesce(F.col("status").isin("PENDING", "FAILED") & (F.col("available_at") <= now) & (F.col("attempts") < most_attempts), F.lit(False))


def due(queue: DataFrame, now: Column, limit: int | None = None, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Rows that are to be tried ``now`` (``is_due``); of these the ``limit`` that have been available longest (ties by creation, then
    id), or all."""
    rows = queue.filter(is_due(now, most_attempts))
    return rows if limit is None else rows.orderBy("available_at", "created_at", "id").limit(limit)


def tried(rows: DataFrame, players: DataFrame, events: DataFrame, now: Column, current_event: str | None) -> DataFrame:
    """``rows`` of the queue after one try. Metrics without power are skipped as invalid, which counts as a failure; the event is the
    linked one, else the job's, else ``current_event``; players (player, game_id: unique) are found by id, or by game id where the
    row has none. COMPLETED rows hold player and event; FAILED ones their error and when they are available again."""
    # one join: each row has one key, never null, so rows without game id are not gathered
    held = players.select(F.concat(F.lit("p"), "player").alias("_key"), F.col("player").alias("_found"))
    held = held.unionByName(players.filter("game_id is not null").select(F.concat(F.lit("g"), "game_id").alias("_key"), F.col("player").alias("_found")))
    key = F.coalesce(F.concat(F.lit("p"), "player"), F.concat(F.lit("g"), "game_id"), F.concat(F.lit("n"), "id"))
    x = rows.withColumn("_key", key).join(held, "_key", "left")
    event = F.coalesce("linked_event", "job_event", F.lit(current_event))
    x = x.withColumn("_event", event).join(events.select(F.col("event").alias("_event"), F.lit(True).alias("_held")), "_event", "left")
    error = (
        F.when(F.coalesce(F.col("power"), F.lit(0)) <= 0, "Skipped invalid profile metrics: power is zero or missing").when(F.col("_held").isNull(), "Event missing for backlog entry.")
        .when(F.col("_found").isNull(), "Governor mapping missing for backlog entry.")
    )
    x = x.withColumns({"error": error, "attempts": F.col("attempts") + 1})
    ok = F.col("error").isNull()
    again = ops.retry_at(now, F.col("attempts"))
    out = {
        "status": F.when(ok, "COMPLETED").otherwise("FAILED"), "player": F.when(ok, F.col("_found")).otherwise(F.col("player")), "event": F.when(ok, F.col("_event")),
        "available_at": F.when(ok, F.col("available_at")).otherwise(again), "processed_at": F.when(ok, now),
    }
    return x.withColumns(out).select(*rows.columns)


def effects(done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(snapshots, observations) that COMPLETED rows write: one snapshot, and an observation each of power and kill points."""
    ok = done.filter("status = 'COMPLETED'")
    snapshots = ok.select("event", "player", "power", "kp", "t4", "t5", "deads", F.lit(100).alias("confidence"), now.alias("at"), "id")
    both = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.coalesce("ref", F.concat(F.lit("backlog:"), "id", F.lit(f":{m}"))).alias("ref")) for m, c in (("power", "power"), ("kill_points", "kp"))])
    return snapshots, ok.select("event", "player", F.explode(both).alias("o"), "observed_at").select("event", "player", "o.*", "observed_at")


def _versions(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table of versions, with its version ``v``."""
    return spark.read.schema(f"{ddl}, v bigint").parquet(path)


def read_queue(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Each row of the queue as its last version has it (of the versions before ``before``)."""
    rows = _versions(spark, f"{path}/queue", STATE)
    rows = rows if before is None else rows.filter(F.col("v") < before)
    names = [c for c in rows.columns if c not in ("id", "v")]
    rows = dealt(rows, rows.count(), "id")
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "v").alias("r")).select("id", "r.*")


def read_effects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The snapshots that stand (of an event and player the last written, by time and id) and the current observations."""
    s = _versions(spark, f"{path}/snapshots", SNAPSHOTS).drop("v")
    values = ["power", "kp", "t4", "t5", "deads", "confidence"]
    standing = s.groupBy("event", "player").agg(F.max_by(F.struct(*values), F.struct("at", "id")).alias("r")).select("event", "player", "r.*")
    return standing, observations.current(_versions(spark, f"{path}/observations", OBSERVATIONS).drop("v"), ["event", "player", "metric"])


def drain_batch(batch: DataFrame, batch_id: int, path: str, players: DataFrame, events: DataFrame, current_event: str | None = None, limit: int | None = None) -> None:
    """One pass: rows of ``batch`` (QUEUE) enter the queue, what is due is tried, effects and rows are written under ``batch_id``. The clock
    is the newest creation time that the queue has seen, so that passes can be repeated."""
    spark = batch.sparkSession
    columns = spark.createDataFrame([], STATE).columns
    new = batch.withColumns({"status": F.lit("PENDING"), "attempts": F.lit(0), "available_at": F.col("created_at"), "event": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "processed_at": F.lit(None).cast("timestamp")}).select(*columns)
    new = new.withColumn("_new", F.lit(True))
    queue = written(new if batch_id == 0 else read_queue(spark, path, batch_id).select(*columns, F.lit(False).alias("_new")).unionByName(new), "queue")
    now = F.lit(queue.agg(F.max("created_at")).first()[0]).cast("timestamp")
    done = written(tried(due(queue, now, limit), players, events, now, current_event).select(*columns), "tried")
    for name, df in zip(("snapshots", "observations"), effects(done, now), strict=True):
        df.write.mode("overwrite").parquet(f"{path}/{name}/v={batch_id}")
    # rows that came with the batch and were not tried: the mark tells, so that a batch's ids are neither shuffled nor broadcast
    fresh = queue.filter("_new").filter(~is_due(now)) if limit is None else queue.filter("_new").join(done.select("id"), "id", "left_anti")
    fresh.select(*columns).unionByName(done).write.mode("overwrite").parquet(f"{path}/queue/v={batch_id}")


def drain_stream(rows: DataFrame, path: str, checkpoint: str, players: DataFrame, events: DataFrame, current_event: str | None = None, limit: int | None = None) -> StreamingQuery:
    """``drain_batch`` over a stream of rows (QUEUE), until nothing new is there; the queue's ids are unique."""
    each = lambda batch, batch_id: drain_batch(batch, batch_id, path, players, events, current_event, limit)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
