"""Operations: job progress, retention, metering, calibration, uploads, index queues, overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def job_progress(tasks: DataFrame, jobs: DataFrame | None = None, extractions: DataFrame | None = None) -> DataFrame:
    """Per job tasks by status, how many are processed, the job's status and low-confidence extractions.

    A job is PROCESSING while any task is neither COMPLETED nor FAILED, FAILED if all of them failed, else in REVIEW; those of ``jobs``
    without tasks are QUEUED. Low confidence is counted from ``extractions`` (job, low_confidence), or from the tasks where none
    are given."""
    n = lambda s: F.count_if(F.col("status") == s)
    low = F.count_if(F.col("low_confidence")).alias("low_confidence")
    g = tasks.groupBy("job").agg(F.count("*").alias("total"), n("QUEUED").alias("queued"), n("PROCESSING").alias("processing"), n("COMPLETED").alias("completed"), n("FAILED").alias("failed"), *([low] if extractions is None else []))
    if jobs is not None:
        g = jobs.select("job").distinct().join(g, "job", "left")
    if extractions is not None:
        g = g.join(extractions.groupBy("job").agg(low), "job", "left")
    g = g.na.fill(0, [c for c in g.columns if c != "job"])
    g = g.withColumn("processed", F.col("completed") + F.col("failed"))
    status = F.when(F.col("total") == 0, "QUEUED").when(F.col("processed") < F.col("total"), "PROCESSING").when(F.col("failed") == F.col("total"), "FAILED").otherwise("REVIEW")
    return g.withColumn("job_status", status)


def retention(rows: DataFrame, settings: DataFrame, now: Column, terminal: list[str], default_days: int = 180) -> DataFrame:
    """terminal rows older than their workspace's retention (settings: ws, days; few)."""
    days = F.coalesce("days", F.lit(default_days))
    return rows.join(settings, "ws", "left").filter(F.col("status").isin(terminal) & (F.col("created_at") < now - F.make_dt_interval(days))).drop("days")


def metering(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """The outcome of each request (id, ws, at, ok) in order of time. ``settings`` (ws, enabled, budget, cost; few): in
    whole units. Only successes that got through cost anything, so what is spent before a request is the cost of the successes
    before it in its workspace and month, up to as many as the budget pays for. Free requests (cost 0) always get through."""
    w = Window.partitionBy("ws", "month").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.join(settings, "ws", "left").withColumn("month", F.date_format("at", "yyyy-MM"))
    open_ = F.coalesce("enabled", F.lit(False)) & (F.coalesce("budget", F.lit(0)) > 0)
    paid = F.when(open_, F.least(F.coalesce(F.sum(F.col("ok").cast("long")).over(w), F.lit(0)), F.expr("budget div nullif(cost, 0)")) * F.col("cost")).otherwise(0)
    reason = (
        F.when(~F.coalesce("enabled", F.lit(False)), "fallback-disabled").when(F.coalesce("budget", F.lit(0)) <= 0, "monthly-budget-cap-zero")
        .when(F.col("spent") + F.col("cost") > F.col("budget"), "monthly-budget-exceeded").when(~F.col("ok"), "provider-failed").otherwise("ok")
    )
    return rows.withColumn("spent", paid.cast("long")).withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok")


def best_profile(images: DataFrame, profiles: DataFrame, archetype: str | None = None, preferred: str | None = None, exact: float = 0.06) -> DataFrame:
    """The calibration profile (profile, place, archetype, min_width, max_width, min_aspect, max_aspect; few, each bound may
    be null) of least penalty for each image size; the first of equals by ``place``. A known ``preferred`` profile is taken as
    it is (``manual``)."""
    ratio = F.col("width") / F.greatest(F.lit(1), F.col("height"))
    beyond = lambda low, high, scale: F.coalesce(F.when(low < high, (high - low) / scale + 0.2), F.lit(0.0))
    at_least_1 = lambda c: F.greatest(F.lit(1), F.col(c))
    centre = F.coalesce((F.col("min_width") + F.col("max_width")) / 2, F.col("width"))
    penalty = (
        beyond(F.col("width"), F.col("min_width"), at_least_1("min_width")) + beyond(F.col("max_width"), F.col("width"), at_least_1("max_width"))
        + beyond(ratio, F.col("min_aspect"), F.lit(1.0)) + beyond(F.col("max_aspect"), ratio, F.lit(1.0)) + F.abs(F.col("width") - centre) / F.greatest(F.lit(1.0), centre) * 0.05
    )
    sizes = images.select("width", "height").distinct()
    if preferred is not None and len(own := profiles.filter(F.col("profile") == preferred).limit(1).collect()):
        profiles, kind = profiles.filter(F.col("profile") == own[0].profile), F.lit("manual")
    else:
        if archetype is not None:
            penalty = penalty + F.when(F.col("archetype").isNull(), 0.0).when(F.col("archetype") == archetype, -0.08).otherwise(0.25)
        kind = F.when(F.col("b.penalty") <= exact, "exact").otherwise("nearest")
    scored = sizes.crossJoin(F.broadcast(profiles)).withColumn("penalty", penalty)
    best = scored.groupBy("width", "height").agg(F.min_by(F.struct("profile", "penalty"), F.struct("penalty", "place")).alias("b"))
    return images.join(best, ["width", "height"], "left").select("id", "width", "height", "b.profile", "b.penalty", kind.alias("match"))


def manifest_gaps(jobs: DataFrame, manifest: DataFrame, tasks: DataFrame, listed: int = 200) -> DataFrame:
    """What each finished upload lacks: job, expected, enqueued, missing, entries (at most ``listed`` of the failed ones, in order
    of ``place``, as row, file, status, reason), status and error.

    ``jobs``: job, total, expected, status; ``manifest``: job, place, row, file, task, status, error; ``tasks``: job. The larger of both
    numbers of files is expected. Entries without a task that failed, or have an error, are told only where there are fewer tasks
    than expected; then at least as many are missing, and the job FAILED."""
    lost = manifest.filter(F.col("task").isNull() & ((F.lower("status") == "failed") | (F.coalesce("error", F.lit("")) != "")))
    entry = F.struct("place", "row", F.nullif("file", F.lit("")).alias("file"), F.coalesce(F.nullif("status", F.lit("")), F.lit("failed")).alias("status"), F.coalesce(F.nullif("error", F.lit("")), F.lit("not-enqueued")).alias("reason"))
    first = F.row_number().over(Window.partitionBy("job").orderBy("place"))
    told = lost.select("job", entry.alias("e"), first.alias("n")).filter(F.col("n") <= listed).groupBy("job").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    counts = lost.groupBy("job").agg(F.count("*").alias("lost"))
    have = tasks.groupBy("job").agg(F.count("*").alias("enqueued"))
    out = jobs.join(have, "job", "left").join(counts, "job", "left").join(told, "job", "left").na.fill(0, ["enqueued", "lost"])
    expected = F.greatest("total", "expected")
    short = F.greatest(F.lit(0), expected - F.col("enqueued"))
    missing = F.when(short > 0, F.greatest(short, F.col("lost"))).otherwise(0).cast("long")
    error = F.concat(F.lit("Upload finalize mismatch: expected "), F.col("expected"), F.lit(" files but enqueued "), F.col("enqueued"), F.lit(" ingestion tasks."))
    out = out.withColumns({"missing": missing, "expected": expected.cast("long")})
    gap = F.col("missing") > 0
    entries = F.when(gap, F.transform("entries", lambda e: e.dropFields("place")))
    return out.select("job", "expected", "enqueued", "missing", entries.alias("entries"), F.when(gap, "FAILED").otherwise(F.col("status")).alias("status"), F.when(gap, error).alias("error"))


def with_child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of rows of each child table, counted before the join."""
    for name, child in children.items():
        parents = parents.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return parents


def overview(jobs: DataFrame, extractions: DataFrame, board_rows: DataFrame, identities: DataFrame, last_jobs: int = 8, **tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each of ``tables`` and of ``jobs`` (created_at, id, total, processed), extractions that
    wait for review, board rows and identities (status) that wait for a player, files that the last jobs have still to process,
    and the pressure on the queue: these and the waiting identities."""
    one = [t.agg(F.count("*").alias(n)) for n, t in {**tables, "jobs": jobs}.items()]
    one.append(extractions.agg(F.count_if(F.col("status").isin("RAW", "REVIEWED")).alias("profiles_pending")))
    one.append(board_rows.agg(F.count_if(F.col("status") == "UNRESOLVED").alias("rows_pending")))
    one.append(identities.agg(F.count_if(F.col("status") == "PENDING").alias("identities_pending")))
    last = jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(last_jobs)
    one.append(last.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col("total") - F.col("processed"))), F.lit(0)).alias("scan_backlog")))
    out = reduce(lambda a, b: a.crossJoin(b), one)  # one row each
    return out.withColumn("queue_pressure", F.col("scan_backlog") + F.col("identities_pending"))


def player_figures(players: DataFrame, weekly: DataFrame) -> DataFrame:
    """Players, mean power, total power, contribution and forts of the week (``weekly``: player, contribution, fort), and the
    alliances."""
    own = players.join(weekly, "player", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return own.agg(F.count("*").alias("n"), F.round(F.avg("power"), 4).alias("mean_power"), total("power"), total("contribution"), total("fort"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("alliance") != "", F.col("alliance")))), ",").alias("alliances"))


def index_tasks(entities: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Index tasks (corpus, entity_type, entity) from several id sets, by (corpus, entity type); ids are told apart once."""
    parts = [df.select(F.lit(c).alias("corpus"), F.lit(k).alias("entity_type"), F.col(df.columns[0]).cast("string").alias("entity")).filter("entity is not null").distinct() for (c, k), df in entities.items()]
    return reduce(DataFrame.unionByName, parts)


def index_status(documents: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """One row: documents of the index in all and by corpus (a map), tasks that wait, run or failed, and that were completed within
    a day. ``documents``: corpus; ``tasks``: status, completed_at. Corpora are few."""
    n = lambda s: F.count_if(F.col("status") == s)
    counts = tasks.agg(n("PENDING").alias("pending"), n("PROCESSING").alias("processing"), n("FAILED").alias("failed"), F.count_if((F.col("status") == "COMPLETED") & (F.col("completed_at") >= now - F.expr("interval 24 hours"))).alias("completed_24h"))
    by = documents.groupBy("corpus").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("corpus", "n")))).alias("by_corpus"))
    return by.crossJoin(counts)  # one row each


def retry_at(now: Column, attempts: Column) -> Column:
    """ST6: now and 2^attempts seconds (attempts 12, an hour at most)."""
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.least(F.lit(3600), F.pow(F.lit(2), F.least(attempts, F.lit(12))).cast("int")).cast("decimal(18,6)"))


def failure_status(attempts: Column, most: int = 3) -> Column:
    return F.when(attempts >= most, "FAILED").otherwise("QUEUED")


#: The status changes that a task may make, beside staying as it is.
CHANGES = [("QUEUED", "PROCESSING"), ("QUEUED", "FAILED"), ("PROCESSING", "QUEUED"), ("PROCESSING", "COMPLETED"), ("PROCESSING", "FAILED"), ("FAILED", "QUEUED")]


def may_change(before: Column, after: Column) -> Column:
    """ST4: whether a task's status may change so."""
    ok = before == after
    for a, b in CHANGES:
        ok = ok | ((before == a) & (after == b))
    return ok


def allowed(before: str, after: str) -> bool:
    """``may_change`` of two values."""
    return before == after or (before, after) in CHANGES


def members(players: DataFrame, *keys: DataFrame) -> DataFrame:
    """Players that any of the key sets (player) names."""
    every = reduce(DataFrame.unionByName, [k.select("player") for k in keys]).filter("player is not null").distinct()
    return players.join(every, "player", "left_semi")
