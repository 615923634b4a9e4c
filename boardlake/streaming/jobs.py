"""Structured Streaming jobs: last-write-wins state, idempotent ingest, weekly windows, progress, backlog, late-data audit."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from boardlake.operators import observations, ops


def latest_observations(obs: DataFrame, keys: list[str] = observations.KEYS) -> DataFrame:  # noqa: B006
    """ST1: a streaming aggregate (update or complete mode): late rows lose by precedence, not by clock."""
    return observations.current(obs, keys)


def once(requests: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """ST2: requests (ws, scope, key, at) whose key was not seen within ``ttl``."""
    return requests.withWatermark("at", ttl).dropDuplicatesWithinWatermark(["ws", "scope", "key"])


def key_conflicts(requests: DataFrame) -> DataFrame:
    """ST2: keys that came with more than one payload."""
    return requests.groupBy("ws", "scope", "key").agg(F.count_distinct("payload_hash").alias("payloads")).filter("payloads > 1")


def weekly(obs: DataFrame, reset_minutes: int = 0, late: str = "14 days") -> DataFrame:
    """ST3: largest value and count per player, metric and week. Weeks begin on Monday, ``reset_minutes`` ahead of UTC; the
    epoch was a Thursday, so windows start four days after it."""
    start = f"{4 * 24 * 60 - reset_minutes} minutes"
    return obs.withWatermark("observed_at", late).groupBy(F.window("observed_at", "7 days", "7 days", start).alias("w"), "player", "metric").agg(F.max("value").alias("value"), F.count("*").alias("n")).select(F.col("w.start").alias("week_start"), "player", "metric", "value", "n")


def moved(changes: DataFrame, slots: int = 1024) -> DataFrame:
    """ST4: task changes (task, job, status, low_confidence, updated_at, id) as a stream -> each task's state after every batch
    in which it changed (job, task, status, low_confidence, seen), in update mode. Within a batch changes go by time and id, and
    only those that ``ops.may_change`` allows take effect; a task's first change sets its state. Tasks are dealt to ``slots``
    states by hash, since a state for each task costs a call of Python for every few changes; a slot is rewritten when one of its
    tasks changes, so ``slots`` is to grow with the tasks (thousands a slot)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tasks = {(job, task): now for job, task, *now in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(list(frames)).sort_values(["updated_at", "id"])
        own = {}
        for of, status, low in zip(zip(rows["job"].tolist(), rows["task"].tolist(), strict=True), rows["status"].tolist(), rows["low_confidence"].tolist(), strict=True):
            now = tasks.get(of)
            if now is None or ops.allowed(now[0], status):
                tasks[of] = own[of] = [status, bool(low), (now[2] if now else 0) + 1]
            else:
                now[2] += 1
                own[of] = now
        state.update((json.dumps([[*of, *now] for of, now in tasks.items()]),))
        number = lambda x: x if x is None else int(x)
        yield pd.DataFrame([(number(job), number(task), *now) for (job, task), now in own.items()], columns=["job", "task", "status", "low_confidence", "seen"], dtype=object)

    # ids are texts in Python, as numbers beside nulls would be floats
    ids = [F.col(c).cast("string").alias(c) for c in ("job", "task")]
    rows = changes.select(F.pmod(F.xxhash64("job", "task"), F.lit(slots)).alias("_slot"), *ids, "status", "low_confidence", "updated_at", "id")
    return rows.groupBy("_slot").applyInPandasWithState(step, "job bigint, task bigint, status string, low_confidence boolean, seen bigint", "tasks string", "update", "NoTimeout")


def progress(states: DataFrame) -> DataFrame:
    """ST4: what ``moved`` gave, batch after batch, -> each task's last state -> job progress."""
    last = states.groupBy("task", "job").agg(F.max_by(F.struct("status", "low_confidence"), "seen").alias("t")).select("task", "job", "t.*")
    return ops.job_progress(last)


def drained(backlog: DataFrame, players: DataFrame, periods: DataFrame) -> DataFrame:
    """ST5: one pass over the backlog (id, player, period, value, status, attempts). Rows that wait (PENDING) or failed before
    (FAILED) are tried, which counts an attempt: they fail if the value is suspicious, or the player or the period unknown, and
    succeed otherwise. All others are left as they are. ``tried`` tells which; failed rows wait for the next pass."""
    known = lambda df, c: df.select(c).filter(F.col(c).isNotNull()).distinct().withColumn(f"_{c}", F.lit(True))
    rows = backlog.join(known(players, "player"), "player", "left").join(known(periods, "period"), "period", "left")
    tried = F.col("status").isin("PENDING", "FAILED")
    error = F.when(F.col("value") <= 0, "Skipped invalid profile metrics").when(F.col("_player").isNull(), "unknown player").when(F.col("_period").isNull(), "unknown event")
    rows = rows.withColumns({"tried": tried, "error": F.when(tried, error)})
    rows = rows.withColumns({"attempts": F.col("attempts") + F.when(tried, 1).otherwise(0), "status": F.when(tried, F.when(F.col("error").isNull(), "SUCCEEDED").otherwise("FAILED")).otherwise(F.col("status"))})
    return rows.drop("_player", "_period")


def drain_counts(rows: DataFrame) -> DataFrame:
    """ST5: how many rows of a pass were tried, succeeded and failed."""
    own = F.col("tried")
    return rows.agg(F.count_if(own).alias("processed"), F.count_if(own & (F.col("status") == "SUCCEEDED")).alias("succeeded"), F.count_if(own & (F.col("status") == "FAILED")).alias("failed"))


def upsert_stream(obs: DataFrame, state_path: str, checkpoint: str, keys: list[str] = observations.KEYS, compact_every: int = 16) -> StreamingQuery:  # noqa: B006
    """ST1, S4: keep the current observations as a table of deltas: each batch is folded and written by itself, under its number,
    so a repeated batch gives the same table; every ``compact_every`` batches what stands is folded into one, and a row that
    names it is added last, so readers never see half of it. ``read_state`` folds that and the deltas since."""
    spark = obs.sparkSession
    spark.createDataFrame([(-1,)], "newest bigint").write.mode("overwrite").parquet(f"{state_path}/newest/v=-1")

    def merge(batch: DataFrame, batch_id: int) -> None:
        observations.current(batch, keys).write.mode("overwrite").parquet(f"{state_path}/delta/v={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            read_state(batch.sparkSession, state_path, keys).write.mode("overwrite").parquet(f"{state_path}/whole/v={batch_id}")
            batch.sparkSession.createDataFrame([(batch_id,)], "newest bigint").write.mode("overwrite").parquet(f"{state_path}/newest/v={batch_id}")

    return obs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state_path: str, keys: list[str] = observations.KEYS) -> DataFrame:  # noqa: B006
    """The current observations of ``upsert_stream``; only deltas since the last compaction are read."""
    newest = spark.read.parquet(f"{state_path}/newest").agg(F.max("newest")).first()[0]
    rows = spark.read.parquet(f"{state_path}/delta").filter(F.col("v") > newest).drop("v")
    if newest >= 0:
        rows = spark.read.parquet(f"{state_path}/whole/v={newest}").unionByName(rows)
    return observations.current(rows, keys)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now, write every batch's result under a version, and read the last one (of a stream
    that appends or updates: all of them)."""
    last = {"v": -1}

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        last["v"] = batch_id

    q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = df.sparkSession
    if last["v"] < 0:
        return spark.createDataFrame([], df.schema)
    return spark.read.parquet(path).drop("v") if mode in ("append", "update") else spark.read.parquet(f"{path}/v={last['v']}")
