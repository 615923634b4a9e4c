"""Weekly compliance: metrics of members for this and the week before, standards, statuses, totals and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ["contribution", "fort", "power_growth", "kp_growth"]


def previous_periods(periods: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each period with the key of the latest one that starts before it; null without a start. Periods are few."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("starts_at", "created_at", "period")
    return periods.withColumn("previous", F.when(F.col("starts_at").isNotNull(), F.lag("period").over(w)))


def period_of(rows: DataFrame, periods: DataFrame, ts: str = "observed_at") -> DataFrame:
    """Rows with the period whose interval [starts_at, ends_at) holds them. Weeks are an equi-join on their start."""
    week = F.date_trunc("week", F.col(ts))
    own = periods.select(F.date_trunc("week", "starts_at").alias("_w"), "period", "starts_at", "ends_at")
    hit = rows.withColumn("_w", week).join(own, "_w", "left")
    inside = (F.col(ts) >= F.col("starts_at")) & (F.col(ts) < F.col("ends_at"))
    return hit.withColumn("period", F.when(inside, F.col("period"))).drop("_w", "starts_at", "ends_at")


def weekly_metrics(obs: DataFrame, board: DataFrame, snaps: DataFrame) -> DataFrame:
    """A1, A2: per (period, player) contribution, fort, kp and power, and kills from the snapshot; one grouping for all.

    ``obs``, ``board``: period, player, metric, value (board also type, updated_at); ``snaps``: period, player, power, kp,
    t4, t5, deads. Resets take the largest of both sources; kill points too, else the snapshot; power takes the best board
    row (by board, update, value), else the largest observation, else the snapshot.
    """
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    o = obs.select("period", "player", "metric", "value", *none("string", "type"), *none("timestamp", "updated_at"), F.lit("obs").alias("src"), *none("bigint", "power", "kp", "t4", "t5", "deads"))
    b = board.select("period", "player", "metric", "value", "type", "updated_at", F.lit("board").alias("src"), *none("bigint", "power", "kp", "t4", "t5", "deads"))
    s = snaps.select("period", "player", *none("string", "metric"), *none("bigint", "value"), *none("string", "type"), *none("timestamp", "updated_at"), F.lit("snap").alias("src"), "power", "kp", "t4", "t5", "deads")
    of = lambda metric, *src: F.when((F.col("metric") == metric) & F.col("src").isin(*src), F.col("value"))
    prio = F.when(F.col("type") == "individual_power", 3).when(F.col("type") == "governor_profile_power", 2).otherwise(1)
    best = F.max_by(F.col("value"), F.when((F.col("metric") == "power") & (F.col("src") == "board"), F.struct(prio, "updated_at", "value")))
    g = o.unionByName(b).unionByName(s).filter("player is not null").groupBy("period", "player").agg(
        F.coalesce(F.max(of("contribution_points", "obs", "board")), F.lit(0)).alias("contribution"), F.coalesce(F.max(of("fort_destroying", "obs", "board")), F.lit(0)).alias("fort"),
        F.max(of("kill_points", "obs", "board")).alias("_kp"), F.max("kp").alias("_skp"), best.alias("_bp"), F.max(of("power", "obs")).alias("_op"), F.max("power").alias("_sp"),
        *[F.max(c).alias(f"_{c}") for c in ("t4", "t5", "deads")],
    )
    kills = [F.when(F.col("_kp").isNull(), F.coalesce(f"_{c}", F.lit(0))).otherwise(0).alias(c) for c in ("t4", "t5", "deads")]
    return g.select("period", "player", "contribution", "fort", F.coalesce("_kp", "_skp").alias("kp"), F.coalesce("_bp", "_op", "_sp").alias("power"), *kills)


def growth(metrics: DataFrame, periods: DataFrame) -> DataFrame:
    """Metrics with the growth since the previous period; null unless both weeks are known. Players of the week before
    alone have a row too, with nothing known of this week.

    A row is sent to its own and to the following period, so both weeks meet in one grouping.
    """
    nxt = periods.select(F.col("previous").alias("period"), F.col("period").alias("following")).filter("period is not null")
    both = metrics.join(nxt, "period", "left")
    now = both.withColumn("_of", F.explode(F.array_compact(F.array(F.struct("period", F.lit(True).alias("now")), F.when(F.col("following").isNotNull(), F.struct(F.col("following").alias("period"), F.lit(False).alias("now")))))))
    cols = ["contribution", "fort", "kp", "power", "t4", "t5", "deads"]
    own = lambda c, now_: F.max(F.when(F.col("_of.now") == now_, F.col(c))).alias(c if now_ else f"p_{c}")
    g = now.groupBy(F.col("_of.period").alias("period"), "player").agg(*[own(c, n) for c in cols for n in (True, False)])
    ready = F.col("kp").isNotNull() & F.col("p_kp").isNotNull()
    grown = [F.when(ready, F.col(c) - F.coalesce(f"p_{c}", F.lit(0))).alias(f"{c}_growth") for c in ("t4", "t5", "deads")]
    return g.select("period", "player", "contribution", "fort", "kp", "p_kp", "power", "p_power", (F.col("power") - F.col("p_power")).alias("power_growth"), (F.col("kp") - F.col("p_kp")).alias("kp_growth"), *grown)


def report(grown: DataFrame, members: DataFrame, periods: DataFrame) -> DataFrame:
    """A5: ``grown`` for each period and tracked member (player, name, alliance), also for members without a row that week:
    they contributed nothing, and their growth is unknown. As many rows as members times periods; periods are few."""
    every = members.crossJoin(F.broadcast(periods.select("period")))
    flags = {"power_baseline": F.col("power_growth").isNotNull(), "kp_baseline": F.col("kp_growth").isNotNull()}
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("contribution", "fort", "power", "p_power", "kp", "p_kp")}
    return every.join(grown, ["period", "player"], "left").withColumns(flags | zero)


def report_summary(scored_rows: DataFrame, unresolved: DataFrame, pending: DataFrame) -> DataFrame:
    """A5: per period the members, those without a baseline of power or kill points, and all rows that wait for an identity
    (``unresolved``) or for synchronisation (``pending``), which are counted apart."""
    out = scored_rows.groupBy("period").agg(F.count("*").alias("members"), F.count_if(~F.col("power_baseline")).alias("no_power_baseline"), F.count_if(~F.col("kp_baseline")).alias("no_kp_baseline"))
    waiting = unresolved.agg(F.count("*").alias("unresolved")).crossJoin(pending.agg(F.count("*").alias("pending")))  # one row
    return out.crossJoin(F.broadcast(waiting))


def metric_status(value: Column, least: Column) -> Column:
    """A3: NO_BASELINE without a value, NO_STANDARD without a minimum, else PASS or FAIL."""
    return F.when(value.isNull(), "NO_BASELINE").when(least.isNull(), "NO_STANDARD").when(value >= least, "PASS").otherwise("FAIL")


def overall_status(statuses: Column) -> Column:
    """A3: of an array of statuses: FAIL if any fails, PASS if all pass, PARTIAL if some do, else NO_STANDARD."""
    passes = lambda s: s == "PASS"
    return F.when(F.exists(statuses, lambda s: s == "FAIL"), "FAIL").when(F.forall(statuses, passes), "PASS").when(F.exists(statuses, passes), "PARTIAL").otherwise("NO_STANDARD")


def scored(members: DataFrame, standards: DataFrame) -> DataFrame:
    """Members (alliance and the four metrics) with minimums, statuses and the overall status. Standards are few:
    (alliance, metric, minimum), pivoted to a row for each alliance."""
    wide = standards.groupBy("alliance").agg(*[F.max(F.when(F.col("metric") == m, F.col("minimum"))).alias(f"min_{m}") for m in METRICS])
    out = members.join(wide, "alliance", "left")
    out = out.withColumns({f"status_{m}": metric_status(F.col(m), F.col(f"min_{m}")) for m in METRICS})
    return out.withColumn("overall", overall_status(F.array(*[f"status_{m}" for m in METRICS])))


def alliance_summary(scored_rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """A4: members, counts by overall status and totals of each (period, alliance) of the catalog, also without members."""
    n = lambda s: F.count_if(F.col("overall") == s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    own = scored_rows.groupBy("period", "alliance").agg(F.count("*").alias("members"), n("PASS").alias("passed"), n("FAIL").alias("failed"), n("PARTIAL").alias("partial"), n("NO_STANDARD").alias("no_standard"), total("contribution").alias("contribution"), total("power_growth").alias("power_growth"), total("fort").alias("fort"), total("kp_growth").alias("kp_growth"))
    counts = ["members", "passed", "failed", "partial", "no_standard", "contribution", "power_growth", "fort", "kp_growth"]
    return catalog.join(own, ["period", "alliance"], "left").select("period", "alliance", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def insights(scored_rows: DataFrame) -> DataFrame:
    """Of each alliance and over all (alliance null): members, passed and failed, pass rate and baseline coverage in whole
    percent, totals, and the alliance's place: by pass rate, then passed, members and name."""
    rate = lambda c: F.floor(100 * F.count_if(c) / F.count("*") + 0.5).cast("int")
    passed = F.col("overall") == "PASS"
    out = scored_rows.groupingSets([["period", "alliance"], ["period"]], "period", "alliance").agg(
        F.count("*").alias("members"), F.count_if(passed).alias("passed"), F.count_if(F.col("overall") == "FAIL").alias("failed"), rate(passed).alias("pass_rate"), rate(F.col("power_growth").isNotNull()).alias("baseline_coverage"),
        F.sum("contribution").alias("contribution"), F.coalesce(F.sum("power_growth"), F.lit(0)).alias("power_growth"),
    )
    w = Window.partitionBy("period", F.col("alliance").isNull()).orderBy(F.desc("pass_rate"), F.desc("passed"), F.desc("members"), "alliance")
    return out.withColumn("place", F.when(F.col("alliance").isNotNull(), F.row_number().over(w)))


def top_by_metric(scored_rows: DataFrame, k: int = 5, metrics: list[str] = METRICS) -> DataFrame:  # noqa: B006
    """Per period and metric the ``k`` best members; a growth that is null counts 0."""
    long = scored_rows.unpivot(["period", "player", "name"], metrics, "metric", "value").withColumn("value", F.coalesce("value", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("period", "metric").orderBy(F.desc("value"), "name", "player"))
    return long.withColumn("place", place).filter(F.col("place") <= k)


def leaders(scored_rows: DataFrame) -> DataFrame:
    """The lists that are broadcast: per period the five members with the largest growth in kill points, and the three with the
    largest in deads; growths that are null count 0."""
    best = top_by_metric(scored_rows, 5, ["kp_growth", "deads_growth"])
    return best.filter((F.col("metric") == "kp_growth") | (F.col("place") <= 3))


def inactive(scored_rows: DataFrame) -> DataFrame:
    """Members that fail, without growth in kill points and without forts."""
    return scored_rows.filter((F.col("overall") == "FAIL") & (F.coalesce("kp_growth", F.lit(0)) <= 0) & (F.col("fort") <= 0))


def performance(rows: DataFrame) -> DataFrame:
    """Per period the share of the best in four metrics, weighed 45, 30, 15, 10 and cut to thousandths."""
    parts = {"contribution": 45, "power_growth": 30, "fort": 15, "kp_growth": 10}
    most = rows.groupBy("period").agg(*[F.max(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))).alias(f"_{c}") for c in parts])
    out = rows.join(most, "period")
    share = lambda c: F.when(F.col(f"_{c}") > 0, F.expr(f"(greatest(coalesce({c}, 0), 0) * 1000) div _{c}")).otherwise(0) / 1000.0
    total = sum((share(c) * w for c, w in parts.items()), F.lit(0.0))
    return out.withColumn("score", F.round(total, 3)).drop(*[f"_{c}" for c in parts])


def movement(scores: DataFrame, periods: DataFrame, k: int = 4) -> DataFrame:
    """Change of score since the previous period, where a player has both; of those that rose and of those that fell
    the ``k`` with the greatest change, and how many were compared. A task passes on its own best ``k`` of a period only."""
    w = Window.partitionBy("player").orderBy("period")
    both = scores.withColumns({"_was": F.lag("score").over(w), "_then": F.lag("period").over(w)}).join(periods.select("period", "previous"), "period")
    moved = both.filter(F.col("_then") == F.col("previous")).withColumn("delta", F.round(F.col("score") - F.col("_was"), 1)).select("period", "player", "score", "delta")
    compared = moved.groupBy("period").agg(F.count("*").alias("compared"))

    def best(sign: int, side: str) -> DataFrame:
        order = Window.partitionBy("period").orderBy(F.col("delta") * -sign, "player")
        return moved.filter(F.col("delta") * sign > 0).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).withColumn("side", F.lit(side))

    return best(1, "up").unionByName(best(-1, "down")).join(compared, "period")


def history(scores: DataFrame, weeks: int) -> DataFrame:
    """The last ``weeks`` periods of every player, and the share of the player's own best over them, rounded as a double in SQL:
    at the scaled value (``round`` with places goes by its shortest text, and may go the other way at a tie)."""
    w = Window.partitionBy("player").orderBy(F.desc("period"))
    out = scores.withColumn("back", F.dense_rank().over(w)).filter(F.col("back") <= weeks)
    best = F.max("score").over(Window.partitionBy("player"))
    return out.withColumn("of_best", F.when(best > 0, F.round(F.col("score") / best * 10000) / 10000).otherwise(0.0))
