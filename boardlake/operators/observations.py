"""Observations: last-write-wins by precedence, arrival decisions, latest values, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["period", "player", "metric"]
PRECEDENCE = ["observed_at", "value", "ref"]


def current(obs: DataFrame, keys: list[str] = KEYS) -> DataFrame:  # noqa: B006
    """Per key the observation of highest precedence (time, value, reference); partial sums, so no key is gathered."""
    rest = [c for c in obs.columns if c not in keys]
    order = F.struct("observed_at", "value", F.coalesce("ref", F.lit("")))
    return obs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def decisions(obs: DataFrame, keys: list[str] = KEYS, arrival: str = "arrival") -> DataFrame:  # noqa: B006
    """ST7, W5: what each arrival (with an id) does to the state before it: created, updated, existing-is-newer, equal-precedence.
    Rows that arrive at once go by id."""
    order = Window.partitionBy(*keys).orderBy(arrival, "id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct("observed_at", "value", F.coalesce("ref", F.lit("")).alias("ref"))
    best = F.max(own).over(order)
    return obs.withColumn("decision", F.when(best.isNull(), "created").when(best < own, "updated").when(best == own, "equal-precedence").otherwise("existing-is-newer"))


def directory(obs: DataFrame, period: str, previous: str) -> DataFrame:
    """Per player the latest value of each metric in a period and the one before, as maps."""
    last = obs.filter(F.col("period").isin(period, previous)).groupBy("player", "period", "metric").agg(F.max_by("value", F.struct("observed_at", "value")).alias("value"))
    of = lambda p: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("period") == p, F.struct("metric", "value")))))
    return last.groupBy("player").agg(of(period).alias("now"), of(previous).alias("before"))


def coverage(obs: DataFrame) -> DataFrame:
    """Rows of each (metric, source), with sub-totals and the total (nulls)."""
    return obs.cube("metric", "source").agg(F.count("*").alias("n"))
