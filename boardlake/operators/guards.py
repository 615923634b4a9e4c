"""Guards and repair of captured leaderboard rows and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fewest digits that a board's metric may have, and words of header rows.
LEAST_DIGITS = {"individual_power": 5, "mad_scientist": 2, "fort_destroyer": 1, "kill_point": 4}
HEADER_NAMES = ["NAME", "RANK", "RANKING", "RANKINGS", "POWER", "CONTRIBUTION", "CONTRIBUTIONPOINTS", "FORT", "FORTS", "FORTDESTROYED", "FORTSDESTROYED", "KILLPOINT", "KILLPOINTS", "METRIC", "GOVERNORPROFILE"]


def row_guard(rows: DataFrame, least: Column) -> DataFrame:
    """``drop_reason`` of each row (run, pos, name, metric_raw, digits, source_rank), null if it stays.

    Header names go, then metrics without a digit, then those of fewer than ``least`` digits, then repeats.
    """
    token = F.regexp_replace(F.upper(F.coalesce("name", F.lit(""))), "[^A-Z0-9]", "")
    reason = F.when((token == "") | token.isin(HEADER_NAMES), "header-row-artifact").when(~F.coalesce("metric_raw", F.lit("")).rlike("[0-9]"), "metric-no-raw-digit").when(F.length("digits") < least, "metric-too-short")
    out = rows.withColumn("_r", reason)
    w = Window.partitionBy("run", F.coalesce("source_rank", F.lit(0)), "name", "digits", F.col("_r").isNull()).orderBy("pos")
    return out.withColumn("drop_reason", F.coalesce("_r", F.when(F.row_number().over(w) > 1, "duplicate"))).drop("_r")


def drop_counts(guarded: DataFrame) -> DataFrame:
    return guarded.groupBy("run").agg(F.count("*").alias("n_rows"), F.count_if(F.col("drop_reason").isNull()).alias("n_kept"), *[F.count_if(F.col("drop_reason") == r).alias("n_" + r.replace("-", "_")) for r in ("header-row-artifact", "metric-no-raw-digit", "metric-too-short", "duplicate")])


def uniformity(rows: DataFrame, least: int = 4, ratio: float = 0.8) -> DataFrame:
    """Per run the most frequent value (the smallest of several), its count and share, and whether it is suspicious."""
    per = rows.groupBy("run", "value").agg(F.count("*").alias("n"))
    g = per.groupBy("run").agg(F.sum("n").alias("total"), F.max_by(F.struct("value", "n"), F.struct("n", -F.col("value"))).alias("m"))
    share = F.col("m.n") / F.col("total")
    return g.select("run", F.col("m.value").alias("dominant"), F.col("m.n").alias("dominant_count"), F.round(share, 6).alias("dominant_ratio"), ((F.col("total") >= least) & (F.col("m.n") >= least) & (share >= ratio)).alias("suspicious"))


def run_guard(guarded: DataFrame, least_rows: int = 3, least: int = 4, ratio: float = 0.8) -> DataFrame:
    """per run the reasons to reject it; counts and uniformity come from one grouping."""
    value = F.when(F.col("drop_reason").isNull(), F.col("digits").cast("decimal(20,0)"))
    per = guarded.groupBy("run", value.alias("value"), F.coalesce("drop_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
    kept = F.col("reason") == ""
    g = per.groupBy("run").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("n_kept"), F.coalesce(F.sum(F.when(F.col("reason") == "header-row-artifact", F.col("n"))), F.lit(0)).alias("headers"), F.coalesce(F.max(F.when(kept, F.col("n"))), F.lit(0)).alias("most"))
    few, uniform = F.col("n_kept") < least_rows, (F.col("n_kept") >= least) & (F.col("most") >= least) & (F.col("most") / F.col("n_kept") >= ratio)
    reasons = F.array_compact(F.array(F.when(few, "insufficient-valid-rows"), F.when(few & (F.col("headers") > 0), "header-row-artifact"), F.when(~few & uniform, "uniform-metric-suspect")))
    return g.select("run", "n_rows", "n_kept", F.array_join(reasons, ",").alias("failures"))


def sync_safety(power: Column, kp: Column) -> Column:
    """reasons not to synchronise a profile, comma-joined; empty if it is safe."""
    return F.concat_ws(",", F.when(power <= 0, "power is zero or missing"), F.when(kp == 111015, "matches known OCR artifact pattern (killPoints=111015)"))


def digit_plausibility(rows: DataFrame, tolerance: int = 1) -> DataFrame:
    """Per run the upper median of the digit counts of metrics that have digits (0 without any); of those, rows further
    than ``tolerance`` from it are outliers and lose 8 of confidence."""
    w = Window.partitionBy("run")
    rows = rows.withColumn("_n", F.length(F.coalesce("digits", F.lit(""))))
    some = F.col("_n") > 0
    place = F.row_number().over(w.orderBy(F.when(some, F.col("_n")).asc_nulls_last(), "pos"))
    ranked = rows.withColumns({"_p": place, "_c": F.count_if(some).over(w)})
    base = F.coalesce(F.max(F.when(some & (F.col("_p") == F.expr("_c div 2 + 1")), F.col("_n"))).over(w), F.lit(0))
    out = ranked.withColumn("baseline", base)
    outlier = some & (F.abs(F.col("_n") - F.col("baseline")) > tolerance)
    return out.withColumn("outlier", outlier).withColumn("confidence", F.greatest(F.lit(0.0), F.col("confidence") - F.when(outlier, 8.0).otherwise(0.0))).drop("_n", "_p", "_c")


def repeated_values(rows: DataFrame) -> DataFrame:
    """Which approvals (job, id, status, power, kp) aren't to be synchronised, since their values repeat: kill points above 0, of 4
    digits at least, in two other APPROVED rows of the job, or power and kill points both, where the power isn't positive."""
    approved = F.col("status") == "APPROVED"

    def peers(*c: str) -> Column:
        return F.count_if(approved).over(Window.partitionBy("job", *c)) - approved.cast("int")

    same_kp = (F.col("kp") > 0) & (F.length(F.col("kp").cast("string")) >= 4) & (peers("kp") >= 2)
    same_pair = (peers("power", "kp") >= 2) & (F.col("power") <= 0)
    return rows.withColumns({"kp_peers": peers("kp"), "skip_sync": same_kp | same_pair})


def rank_repair(rows: DataFrame) -> DataFrame:
    """Ranks of a run in sequence, from its first rank above 0 back to its first row, at 1 at least (1 without any such
    rank); corrected rows lose 5 of confidence."""
    w = Window.partitionBy("run").orderBy("pos")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_i", F.row_number().over(w) - 1)
    base = F.greatest(F.lit(1), F.coalesce(F.first(F.when(F.col("source_rank") > 0, F.col("source_rank") - F.col("_i")), ignorenulls=True).over(every), F.lit(1)))
    out = rows.withColumn("repaired_rank", (base + F.col("_i")).cast("int"))
    out = out.withColumn("corrected", ~F.col("repaired_rank").eqNullSafe(F.col("source_rank")))
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.col("confidence") - F.when(F.col("corrected"), 5.0).otherwise(0.0))).drop("_i")


def monotonic_guard(rows: DataFrame, least_digits: int = 1) -> DataFrame:
    """Rows whose value exceeds the one before. If it is the run's only one, the best of its candidates (an array of
    value, score, confidence; by score, then confidence, then place) that lies between its neighbours and has ``least_digits``
    replaces it, and its confidence becomes the mean of both; otherwise such rows lose 7 of confidence."""
    w = Window.partitionBy("run").orderBy("pos")
    rows = rows.withColumns({"_prev": F.lag("value").over(w), "_next": F.lead("value").over(w)})
    rows = rows.withColumn("violation", F.coalesce(F.col("value") > F.col("_prev"), F.lit(False)))
    rows = rows.withColumn("_n", F.sum(F.col("violation").cast("int")).over(Window.partitionBy("run")))
    fits = lambda c: (c["value"] <= F.col("_prev")) & (F.col("_next").isNull() | (c["value"] >= F.col("_next"))) & (F.length(c["value"].cast("string")) >= least_digits)
    ordered = F.transform("candidates", lambda c, i: F.struct((-c["score"]).alias("a"), (-c["confidence"]).alias("b"), i.alias("i"), c["value"].alias("value"), c["confidence"].alias("confidence")))
    rows = rows.withColumn("_best", F.when(F.col("violation") & (F.col("_n") == 1), F.array_min(F.filter(ordered, fits))))
    corrected = F.col("_best").isNotNull()
    mean = F.least(F.lit(100.0), (F.col("confidence") + F.col("_best.confidence")) / 2)
    lost = F.col("confidence") - F.when(F.col("violation"), 7.0).otherwise(0.0)
    return rows.withColumns({"fixed": F.when(corrected, F.col("_best.value")).otherwise(F.col("value")), "confidence": F.greatest(F.lit(0.0), F.when(corrected, mean).otherwise(lost))}).drop("_prev", "_next", "_n", "_best")


def run_quality(rows: DataFrame, runs: DataFrame, least: float = 72.0) -> DataFrame:
    """Per run of ``runs`` (run, guard_failures: an array) the mean confidence of its rows and whether that is low: below ``least``,
    no rows, a row with reasons of failure (``failed``), or failures of the guard. A row's confidence is the mean of its rank, name,
    metric and sub-name (at weight .35), 7 less (0 at least) for a metric whose separators do not group. ``confidence`` is rounded,
    ``mean`` is not."""
    mean = (F.col("rank_conf") + F.col("name_conf") + F.col("metric_conf") + F.col("title_conf") * 0.35) / 3.35
    conf = F.when(F.col("grouping_ok"), mean).otherwise(F.greatest(F.lit(0.0), mean - 7.0))
    per = rows.withColumn("c", conf).groupBy("run").agg(F.avg("c").alias("mean"), F.bool_or("failed").alias("failed"))
    out = runs.join(per, "run", "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    low = (F.col("mean") < least) | F.coalesce("failed", F.lit(True)) | (F.size(F.coalesce("guard_failures", F.array().cast("array<string>"))) > 0)
    return out.select("run", F.round("mean", 4).alias("confidence"), "mean", low.alias("low_confidence"))
