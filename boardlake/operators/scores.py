"""Contribution scores and anomalies of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def tier(score: Column) -> Column:
    return F.when(score >= 100, "War Legend").when(score >= 80, "Elite Warrior").when(score >= 50, "Frontline Fighter").when(score >= 20, "Support Role").otherwise("Inactive")


def contribution_scores(deltas: DataFrame, by: list[str], t4: float = 1, t5: float = 2, dead: float = 5, kp_ratio: float = 0.3, dead_ratio: float = 0.02) -> DataFrame:
    """Expected and actual contribution of start_power and deltas (t4, t5, deads, power), share met (120 at most), ratio
    of kills to deads, deadweight flag, tier, place by score (ties by player)."""
    p = F.col("start_power").cast("double")
    want = p * kp_ratio + p * dead_ratio * dead
    got = F.col("t4") * F.lit(float(t4)) + F.col("t5") * F.lit(float(t5)) + F.col("deads") * F.lit(float(dead))
    met = F.when(want > 0, got / want * 100).otherwise(F.when(got > 0, 100.0).otherwise(0.0))
    score = F.least(half_up(met * 10) / 10, F.lit(120.0))
    kills = (F.col("t4") + F.col("t5")).cast("double")
    out = deltas.withColumns({
        "expected": half_up(want).cast("long"), "actual": half_up(got).cast("long"), "score": score,
        "kd": half_up(F.when(F.col("deads") > 0, kills / F.col("deads")).otherwise(kills) * 100) / 100,
        "deadweight": (F.col("power_delta") < -2000000) & (got < 100000),
    })
    out = out.withColumn("tier", F.when(F.col("deadweight"), "Inactive").otherwise(tier(F.col("score"))))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "player")))


def tier_counts(scores: DataFrame) -> DataFrame:
    """A25."""
    return scores.groupBy("tier").agg(F.count("*").alias("n"))


def _found(*rules: tuple[Column, str, str, str, Column]) -> Column:
    """An array of (code, type, severity, context) of the rules that hold."""
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(kind).alias("type"), F.lit(level).alias("severity"), ctx.alias("context"))) for c, code, kind, level, ctx in rules]))


def _text(*cols: str | Column) -> Column:
    return F.concat_ws(",", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])


def comparison_anomalies(snaps: DataFrame) -> DataFrame:
    """A row per anomaly between a player's snapshot and the one before it (by at)."""
    w = Window.partitionBy("player").orderBy("at")
    cols = ["power", "kp", "t4", "t5", "deads"]
    both = snaps.withColumns({f"a_{c}": F.lag(c).over(w) for c in cols}).filter("a_power is not null")
    both = both.withColumns({f"d_{c}": F.col(c) - F.col(f"a_{c}") for c in cols})
    drop = (F.col("a_power") > 0) & (F.col("power").cast("double") / F.col("a_power") < 0.5)
    rules = _found(
        (F.col("d_kp") < 0, "KP_NEGATIVE_DELTA", "REGRESSION", "ERROR", _text("d_kp")),
        (F.col("d_deads") < 0, "DEADS_NEGATIVE_DELTA", "REGRESSION", "ERROR", _text("d_deads")),
        ((F.col("d_t4") < 0) | (F.col("d_t5") < 0), "KILLS_NEGATIVE_DELTA", "REGRESSION", "ERROR", _text("d_t4", "d_t5")),
        (drop, "POWER_DROP_GT_50", "EXTREME_DROP", "WARNING", _text("a_power", "power")),
        ((F.col("d_kp") > 100_000_000) & (F.col("d_t4") == 0) & (F.col("d_t5") == 0), "KP_HIGH_WITHOUT_T4T5", "OCR_INCONSISTENCY", "WARNING", _text("d_kp")),
    )
    return both.select("player", "at", F.explode(rules).alias("x")).select("player", "at", "x.*")


def snapshot_anomalies(snaps: DataFrame) -> DataFrame:
    """A row per anomaly within one snapshot."""
    kills = F.col("t4") + F.col("t5")
    rules = _found(
        (F.col("power") <= 0, "POWER_ZERO_OR_NEGATIVE", "OCR_INCONSISTENCY", "ERROR", _text("power")),
        ((F.col("kp") > 0) & (kills > F.col("kp")), "KILLS_EXCEED_KP", "CROSS_FIELD_INCONSISTENCY", "WARNING", _text("kp", kills)),
        (F.col("deads") > F.col("power"), "DEADS_GT_POWER", "CROSS_FIELD_INCONSISTENCY", "WARNING", _text("deads", "power")),
    )
    return snaps.select("player", "at", F.explode(rules).alias("x")).select("player", "at", "x.*")
