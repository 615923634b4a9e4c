"""Reconciling captured runs with the tables that stand: decisions, snapshots, observations and the runs' status.

Rows arrive run after run. What a row meets is decided by what stands under its key then, so a key's rows are a chain. The chain
is cut: rows are dealt by ranges of (key, arrival), each range sums up what it leaves (latest row, latest ACTIVE row, and the latest
ACTIVE row that comes in after everything before it), and these sums are carried on. No key is gathered, and a stored table is simply
what arrived first, so a second instalment goes on where the first one ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.operators import observations
from boardlake.sources.scratch import written

# The metrics that are kept as observations, and the boards that follow from them.
BOARD_OF = {"power": "individual_power", "kill_points": "kill_point"}
OBSERVED = ["power", "kill_points"]

ARRIVAL = ["arrival", "run", "updated_at", "id"]
KEYS = ["event", "type", "identity_key"]
SNAPSHOT = [*KEYS, "metric", "player", "name", "name_key", "source_rank", "value", "status", "last_run", "last_row", "run_at", "row_at"]
OBSERVATION = ["event", "player", "metric", "value", "source_rank", "ref", "observed_at"]


def routed(rows: DataFrame) -> DataFrame:
    """``rows`` (id, run, run_at, arrival, event, type, metric, player, name, name_key, source_rank, value, identity_status,
    updated_at) with identity_key, status, and ``route``: none (the run has no event), observation (a linked player's metric that a
    board follows), else board."""
    status = F.when(F.col("identity_status").isin("REJECTED", "UNRESOLVED"), F.col("identity_status")).otherwise("ACTIVE")
    key = F.when(F.col("player").isNotNull(), F.concat(F.lit("gov:"), "player")).otherwise(F.concat(F.lit("name:"), "name_key"))
    route = F.when(F.col("event").isNull(), "none").when(F.col("player").isNotNull() & F.col("metric").isin(*BOARD_OF), "observation").otherwise("board")
    return rows.withColumns({"status": status, "identity_key": key, "route": route})


def _stands(since: Column, active: Column, every: Column) -> Column:
    return F.when(since, active).otherwise(every)


def merged(rows: DataFrame) -> DataFrame:
    """``rows`` of one table (KEYS, run_at, updated_at, status, ``fresh``: 0 for stored rows, ARRIVAL) with the decision on each: created,
    updated, existing-run-is-newer, existing-row-is-newer, non-active-row-cannot-overwrite-active."""
    order = ["fresh", *ARRIVAL]
    dealt = written(rows.repartitionByRange(*KEYS, *order).withColumn("_range", F.spark_partition_id()), "arrivals")
    own, active = F.struct("run_at", "updated_at"), F.col("status") == "ACTIVE"
    w = Window.partitionBy("_range", *KEYS).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumns({"_own": own, "_act": F.when(active, own)})
    dealt = dealt.withColumns({"_all": F.max("_own").over(before), "_active": F.max("_act").over(before)})
    # an ACTIVE row that nothing before it in its range outdoes gets in, unless an earlier range holds a later row
    dealt = dealt.withColumn("_in", F.when(F.col("_all").isNull() | (F.col("_act") >= F.col("_all")), F.col("_act")))
    dealt = dealt.withColumn("_in_before", F.max("_in").over(before))
    sums = dealt.groupBy("_range", *KEYS).agg(F.max("_own").alias("m"), F.max("_act").alias("a"), F.max("_in").alias("e"))
    past = Window.partitionBy(*KEYS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"all0": F.max("m").over(past), "active0": F.max("a").over(past)})
    sums = sums.withColumn("entered", F.coalesce(F.col("e").isNotNull() & (F.col("all0").isNull() | (F.col("e") >= F.col("all0"))), F.lit(False)))
    sums = sums.withColumn("since0", F.coalesce(F.max("entered").over(past), F.lit(False))).select("_range", *KEYS, "all0", "active0", "since0")
    x = dealt.join(sums, ["_range", *KEYS])
    latest = lambda a, b: F.array_max(F.array(a, b))
    since = F.col("since0") | F.coalesce(F.col("_in_before").isNotNull() & (F.col("all0").isNull() | (F.col("_in_before") >= F.col("all0"))), F.lit(False))
    x = x.withColumn("_since", since)
    x = x.withColumn("_stands", _stands(F.col("_since"), latest("active0", "_active"), latest("all0", "_all")))
    decision = (
        F.when(F.col("_stands").isNull(), "created").when(F.col("_stands.run_at") > F.col("run_at"), "existing-run-is-newer")
        .when((F.col("_stands.run_at") == F.col("run_at")) & (F.col("_stands.updated_at") > F.col("updated_at")), "existing-row-is-newer")
        .when(F.col("_since") & (F.col("status") != "ACTIVE"), "non-active-row-cannot-overwrite-active").otherwise("updated")
    )
    return x.select(*rows.columns, decision.alias("decision"))


def reconcile(rows: DataFrame, snapshots: DataFrame | None = None, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(decisions, snapshots, observations, runs) after ``rows`` arrived at the stored ``snapshots`` (SNAPSHOT) and observations
    (``stored``, OBSERVATION).

    Linked rows of a power or kill-point metric go to the observations, where the latest by (time, value, reference) stands, and the
    board takes over what stands, under the name that came last; each of them counts as merged. All others meet the rule of
    ``merged``. A run's status is MERGED, or REVIEW while it has no event or rows that are UNRESOLVED. Keys must not be null but for
    ``event`` and ``player``.
    """
    x = written(routed(rows), "routed")
    spark = rows.sparkSession
    seen = x.filter("route <> 'none' and player is not null").filter(F.col("metric").isin(*OBSERVED))
    new = seen.select("event", "player", "metric", "value", "source_rank", F.col("id").cast("string").alias("ref"), F.col("updated_at").alias("observed_at"))
    stood = stored if stored is not None else spark.createDataFrame([], new.schema)
    observed = observations.current(stood.unionByName(new), ["event", "player", "metric"]).select(*OBSERVATION)

    board = x.filter("route = 'board'").select(*ARRIVAL, *KEYS, "metric", "player", "name", "name_key", "source_rank", "value", "status", "run_at", F.lit(1).alias("fresh"))
    old = None
    if snapshots is not None:
        held = snapshots.filter("last_row is not null").select(F.lit(0).cast("long").alias("arrival"), F.col("last_run").alias("run"), F.col("row_at").alias("updated_at"), F.col("last_row").alias("id"), *[c for c in SNAPSHOT if c not in ("last_run", "last_row", "row_at")], F.lit(0).alias("fresh"))
        old = snapshots.filter("last_row is null")
        board = board.unionByName(held)
    judged = written(merged(board), "merged")
    took = judged.filter(F.col("decision").isin("created", "updated"))
    last = F.max_by(F.struct(*[c for c in judged.columns if c not in KEYS]), F.struct("fresh", *ARRIVAL)).alias("r")
    of = {"last_run": F.col("r.run"), "last_row": F.col("r.id"), "row_at": F.col("r.updated_at")}
    plain = took.groupBy(*KEYS).agg(last).select(*[of.get(c, F.col(c if c in KEYS else f"r.{c}")).alias(c) for c in SNAPSHOT])

    kind = F.create_map(*[F.lit(v) for kv in BOARD_OF.items() for v in kv])
    named = x.filter("route = 'observation'").groupBy("event", "player", "metric").agg(F.max_by(F.struct("name", "name_key"), F.struct(*ARRIVAL)).alias("n"))
    given = named.join(observed, ["event", "player", "metric"])
    types = dict(plain.dtypes)
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    followed = given.select("event", kind[F.col("metric")].alias("type"), F.concat(F.lit("gov:"), "player").alias("identity_key"), "metric", "player", "n.name", "n.name_key", "source_rank", "value", F.lit("ACTIVE").alias("status"), none("last_run"), none("last_row"), none("run_at"), none("row_at"))
    if old is not None:
        followed = followed.unionByName(old.join(followed.select(*KEYS), KEYS, "left_anti"))

    # what the observations say wins over what a run left under the same key
    state = plain.join(followed.select(*KEYS), KEYS, "left_anti").unionByName(followed)
    fresh = judged.filter("fresh = 1").select("run", "id", "decision")
    other = x.filter("route <> 'board'").select("run", "id", F.when(F.col("route") == "none", "missing-event").otherwise("observation").alias("decision"))
    decisions = written(fresh.unionByName(other), "decisions")
    applied = F.col("decision").isin("created", "updated", "observation")
    counts = decisions.groupBy("run").agg(F.count_if(applied).alias("merged"), F.count_if(~applied).alias("skipped"), F.count_if(applied).alias("revisions"))
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    runs = x.groupBy("run").agg(F.max("event").alias("event"), is_("UNRESOLVED"), is_("REJECTED")).join(counts, "run")
    status = F.when(F.col("event").isNull() | (F.col("unresolved") > 0), "REVIEW").otherwise("MERGED")
    return decisions, state, observed, runs.select("run", "merged", "skipped", "revisions", "unresolved", "rejected", status.alias("status"))
