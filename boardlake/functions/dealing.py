"""Rows dealt by key to as many tasks as their number needs."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task takes on the average, where the session's number of shuffle partitions would give it more.
ROWS = 250_000


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df``, of ``n`` rows, dealt by ``keys``: what a task sorts or holds is bounded, however many rows there are. What groups by the
    keys, and by others besides, needs no further shuffle. Few rows are left to adaptive execution."""
    tasks = -(-n // ROWS)
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*keys)
    return df.repartition(tasks, *keys)
