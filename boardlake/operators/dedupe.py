"""Exact and near-duplicate captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.functions.ranks import numbered
from boardlake.sources.scratch import scratch


def exact_duplicates(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each run with the newest earlier run of the same keys, if there is one."""
    w = Window.partitionBy(*keys).orderBy("created_at", "run")
    return runs.withColumn("duplicate_of", F.lag("run").over(w))


def near_duplicates(items: DataFrame, runs: DataFrame, back: int = 8, least: float = 0.9) -> DataFrame:
    """(run, other, similarity): Jaccard of the item sets of a run and one of the ``back`` runs before it on its board.

    ``items``: run, item; ``runs``: run, board, created_at. Runs are numbered within boards (over ranges, so a hot board is
    not one task). Bands of numbers bound the pairs: a run meets its own band and the one before, so at most ``back`` others;
    sets whose sizes alone rule out ``least`` are dropped before any set is moved. Per run the best similarity, the newest
    on ties.
    """
    places = numbered(runs.select("run", "board", "created_at"), ["board"], ["created_at", "run"]).drop("created_at")
    path = scratch(items.sparkSession, "sets")  # made once, read three times
    items.groupBy("run").agg(F.collect_set("item").alias("s")).write.parquet(path)
    sets = items.sparkSession.read.parquet(path)
    sized = places.join(sets.select("run", F.size("s").alias("size")), "run")
    new = sized.select("board", F.col("run").alias("new"), F.col("nth").alias("n1"), F.col("size").alias("s1"), F.explode(F.array(F.expr(f"nth div {back}"), F.expr(f"nth div {back} - 1"))).alias("band"))
    old = sized.select("board", F.col("run").alias("other"), F.col("nth").alias("n0"), F.col("size").alias("s0"), F.expr(f"nth div {back}").alias("band"))
    apart = F.col("n1") - F.col("n0")
    alike = F.least("s1", "s0") >= F.greatest("s1", "s0") * least
    pairs = new.join(old, ["board", "band"]).filter((apart >= 1) & (apart <= back) & alike).select("new", "other", "n0", "s1", "s0")
    both = pairs.join(sets.select(F.col("run").alias("new"), F.col("s").alias("a")), "new").join(sets.select(F.col("run").alias("other"), F.col("s").alias("b")), "other")
    same = F.size(F.array_intersect("a", "b"))
    scored = both.select("new", "other", "n0", (same / (F.col("s1") + F.col("s0") - same)).alias("similarity")).filter(F.col("similarity") >= least)
    best = scored.groupBy("new").agg(F.max_by(F.struct("other", "similarity"), F.struct("similarity", "n0")).alias("b"))
    return best.select(F.col("new").alias("run"), "b.other", F.round("b.similarity", 6).alias("similarity"))


def first_artifacts(tasks: DataFrame) -> DataFrame:
    """The artifacts of a job's COMPLETED tasks (job, task, status, created_at, artifact, url, meta, task_meta), each under its first
    task that has a URL for it (by created_at, then task); rows without an id or a URL go. Metadata maps are joined, the task's wins."""
    own = tasks.withColumn("artifact", F.trim("artifact")).filter((F.col("status") == "COMPLETED") & (F.col("artifact") != "") & (F.col("url") != ""))
    first = own.groupBy("job", "artifact").agg(F.min_by(F.struct("task", "created_at", "url", "meta", "task_meta"), F.struct("created_at", "task")).alias("a"))
    empty = F.create_map().cast("map<string,string>")
    theirs = F.coalesce("a.task_meta", empty)
    kept = F.map_filter(F.coalesce("a.meta", empty), lambda k, v: ~F.array_contains(F.map_keys(theirs), k))
    return first.select("job", "artifact", "a.task", "a.created_at", "a.url", F.map_concat(kept, theirs).alias("meta"))
