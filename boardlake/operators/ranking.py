"""Leaderboards: filters, stable order, all-time latest rows, summaries. A board row has id, type, metric, identity, name,
value, source_rank, status, updated_at, created_at as far as an operator names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.functions.ranks import stable_ranks


def stable_ranking(rows: DataFrame, by: list[str]) -> DataFrame:
    """stable_index, display_rank and tie_group within ``by``: value down, source rank up (nulls last), name, id.

    A tie group also ends where the values are equal but the source rank differs from a known one before. A board of any size
    is ranked over many tasks.
    """
    return stable_ranks(rows, by)


def page_after(ranked: DataFrame, by: list[str], cursor_id: object | None, size: int) -> DataFrame:
    """The ``size`` rows of each group after the row with ``cursor_id``; from the start where it isn't found."""
    at = ranked.filter(F.col("id") == F.lit(cursor_id)).select(*by, F.col("stable_index").alias("_at"))
    page = ranked.join(at.dropDuplicates(by), by, "left").withColumn("_from", F.coalesce("_at", F.lit(0)))
    return page.filter((F.col("stable_index") > F.col("_from")) & (F.col("stable_index") <= F.col("_from") + size)).drop("_at", "_from")


def with_tie_flag(page: DataFrame, by: list[str]) -> DataFrame:
    """Whether another row of the page is in the same tie group."""
    return page.withColumn("is_tie", F.count("*").over(Window.partitionBy(*by, "tie_group")) > 1)


def latest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ``max_by`` of a struct where all of the order descends, so partial sums apply."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def all_time_latest(rows: DataFrame, keys: list[str] = ["type", "metric", "identity"]) -> DataFrame:  # noqa: B006
    """Per key the row that was updated last; then created last, of the largest value, of the largest id."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("updated_at", "created_at", "value", "id"))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merged_power(rows: DataFrame, primary: str, legacy: str, keys: list[str]) -> DataFrame:
    """Boards ``primary`` and ``legacy`` as one: per identity by board, update time, value, id."""
    rows = rows.withColumn("_p", F.when(F.col("type") == primary, 2).when(F.col("type") == legacy, 1).otherwise(0)).filter("_p > 0")
    rest = [c for c in rows.columns if c not in keys and c != "_p"]
    best = F.max_by(F.struct(*rest), F.struct("_p", "updated_at", "value", "id"))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def filtered(rows: DataFrame, statuses: list[str] | None = None, types: list[str] | None = None, metric: str | None = None, alliances: list[str] | None = None, text: str | None = None) -> DataFrame:
    """rows of the statuses (ACTIVE by default), types, metric, any of the alliances (contained, case-insensitive), and
    with ``text`` in the name or its digits in the identity."""
    out = rows.filter(F.col("status").isin(statuses or ["ACTIVE"]))
    if types:
        out = out.filter(F.col("type").isin(types))
    if metric:
        out = out.filter(F.col("metric") == metric)
    if alliances:
        any_of = F.lit(False)
        for a in alliances:
            any_of = any_of | F.lower("alliance").contains(a.lower())
        out = out.filter(any_of)
    if text:
        digits = "".join(c for c in text if c.isdigit())
        hit = F.lower("name").contains(text.lower())
        out = out.filter(hit | F.col("identity").cast("string").contains(digits) if digits else hit)
    return out


def absent_players(fallback: DataFrame, board: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``fallback`` whose keys the board lacks, marked with where they come from."""
    known = board.select(*keys).filter(" and ".join(f"{k} is not null" for k in keys)).distinct()
    return fallback.join(known, keys, "left_anti")


def status_counts(rows: DataFrame) -> DataFrame:
    """Counts by status."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def board_counts(rows: DataFrame, top: int = 25) -> DataFrame:
    """Rows and last update of each (type, metric), the ``top`` largest."""
    return rows.groupBy("type", "metric").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_update")).orderBy(F.desc("n"), "type", "metric").limit(top)


def distribution(rows: DataFrame) -> DataFrame:
    """Count, least, most and integer mean of the values of each (type, metric)."""
    total = F.sum(F.col("value").cast("decimal(38,0)"))
    return rows.groupBy("type", "metric").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.expr("sum(cast(value as decimal(38,0))) div count(value)").cast("long").alias("mean"), total.cast("string").alias("total"))


def top_buckets(rows: DataFrame, by: list[str], limits: list[int] = [100, 200, 400]) -> DataFrame:  # noqa: B006
    """Count, total and integer mean of each group's top rows, for several limits in one pass."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "id"))
    top = rows.withColumn("_n", place).filter(F.col("_n") <= max(limits))
    aggs = []
    for k in limits:
        own = F.when(F.col("_n") <= k, F.col("value"))
        aggs += [F.count(own).alias(f"n_{k}"), F.sum(own).alias(f"total_{k}"), F.expr(f"sum(case when _n <= {k} then value end) div count(case when _n <= {k} then 1 end)").alias(f"mean_{k}")]
    return top.groupBy(*by).agg(*aggs)


def totals_by_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A10: rows and total of each label that a row's alliance contains; labels without rows count 0. Labels are few."""
    hit = F.lower(F.col("alliance")).contains(F.lower(F.col("label")))
    own = rows.select("alliance", "value").groupBy("alliance").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return F.broadcast(labels).join(own, hit, "left").groupBy("label").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


def review_summary(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows of the given statuses by (type, metric), and over all (type and metric null)."""
    return rows.filter(F.col("status").isin(statuses)).groupingSets([["type", "metric"], []], "type", "metric").agg(F.count("*").alias("n"))


def review_groups(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """Per run the count of each status and its row ids in order."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in statuses]
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("source_rank", F.lit(1 << 30)), "id")))
    return rows.groupBy("run").agg(*counts, F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda r: r["id"].cast("string")), ",").alias("ids"))


def merge_decisions(rows: DataFrame, keys: list[str], arrival: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """Each row's fate when a key's rows arrive in order of ``arrival``: its run (created_at) must not be older than that of
    the row that stands, nor, within one run time, its own update (updated_at); and a row that is not ACTIVE cannot replace an
    ACTIVE one. What stands is the latest (run, row) of those that arrived: of all until the first ACTIVE row gets in, of the
    ACTIVE ones from then on.
    """
    before = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    own, active = F.struct("created_at", "updated_at"), F.col("status") == "ACTIVE"
    rows = rows.withColumns({"_own": own, "_all": F.max(own).over(before), "_active": F.max(F.when(active, own)).over(before)})
    enters = active & (F.col("_all").isNull() | (F.col("_own") >= F.col("_all")))
    rows = rows.withColumn("_since", F.coalesce(F.max(enters).over(before), F.lit(False)))
    stands = F.when(F.col("_since"), F.col("_active")).otherwise(F.col("_all"))
    decision = (
        F.when(stands.isNull(), "created").when(stands["created_at"] > F.col("created_at"), "existing-run-is-newer")
        .when((stands["created_at"] == F.col("created_at")) & (stands["updated_at"] > F.col("updated_at")), "existing-row-is-newer")
        .when(F.col("_since") & ~active, "non-active-row-cannot-overwrite-active").otherwise("updated")
    )
    return rows.withColumn("decision", decision).drop("_own", "_all", "_active", "_since")


def latest_revisions(revisions: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` revisions of each row."""
    w = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return revisions.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def bars(rows: DataFrame, page: list[str], now: Column) -> DataFrame:
    """Rows with the length of their bar, in hundredths of a per cent of the page's largest value (0 to 10,000), and the tone of
    the page by the age of its newest row: good up to 24 whole hours, warn up to 72, else bad."""
    g = rows.groupBy(*page).agg(F.greatest(F.lit(0), F.max("value")).alias("_most"), F.max("updated_at").alias("_newest"))
    hours = F.floor((F.unix_micros(now) - F.unix_micros("_newest")) / 3_600_000_000)
    tone = F.when(hours <= 24, "good").when(hours <= 72, "warn").when(hours.isNotNull(), "bad")
    share = F.expr("cast(cast(value as decimal(38,0)) * 10000 div nullif(_most, 0) as bigint)")
    length = F.greatest(F.lit(0), F.least(F.lit(10000), F.coalesce(share, F.lit(0))))
    return rows.join(g, page).withColumns({"hundredths": length.cast("long"), "tone": tone}).drop("_most", "_newest")
