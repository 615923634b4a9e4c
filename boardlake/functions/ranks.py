"""Row numbers of large groups, over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.sources.scratch import scratch


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """``df`` with each row's number within its group, however large: rows are dealt by ranges of (``by``, ``order``), numbered
    within ranges, and shifted by the rows that the group has in the ranges before. ``order`` must be a total one.

    The dealt rows are written to the shared folder, so ranges are the same for both passes and survive lost executors.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    sizes = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", *by, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    joined = dealt.withColumn("_own", own).alias("d").join(before.alias("b"), (F.col("d._range") == F.col("b._range")) & _same(by))
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in df.columns], (F.col("b._before") + F.col("d._own")).alias(name))


def stable_ranks(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` (value, source_rank, name, id) with stable_index, display_rank and tie_group within ``by``, as ``stable_ranking`` of
    the operators defines them, for groups of any size: rows are dealt by ranges of the order, ranked within ranges, and what a
    range leaves to the next (rows, tie groups, its last row, and where the run of its last value began) is carried on."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranked")
    order = [F.desc("value"), F.asc_nulls_last("source_rank"), F.asc("name"), F.asc("id")]
    df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    w = Window.partitionBy("_range", *by).orderBy(*order)
    before = F.lag("source_rank").over(w)
    new = F.coalesce((F.lag("value").over(w) != F.col("value")) | (before.isNotNull() & ~before.eqNullSafe(F.col("source_rank"))), F.lit(False))
    first = F.row_number().over(w) == 1
    own = dealt.withColumns({"_n": F.row_number().over(w), "_new": new.cast("int"), "_first": first, "_rank": F.rank().over(Window.partitionBy("_range", *by).orderBy(F.desc("value")))})
    head, last = F.struct("value", "source_rank"), F.struct("value", "source_rank", "_rank")
    ends = own.groupBy("_range", *by).agg(F.count("*").alias("rows"), F.sum("_new").alias("news"), F.min_by(head, "_n").alias("head"), F.max_by(last, "_n").alias("last"))
    r = Window.partitionBy(*by).orderBy("_range")
    past, prev = r.rowsBetween(Window.unboundedPreceding, -1), F.lag("last").over(r)
    ends = ends.withColumns({"prev": prev, "skip": F.coalesce(F.sum("rows").over(past), F.lit(0))})
    goes_on = F.col("prev").isNotNull() & (F.col("prev.value") == F.col("head.value"))
    breaks = F.col("prev").isNotNull() & (~goes_on | (F.col("prev.source_rank").isNotNull() & ~F.col("prev.source_rank").eqNullSafe(F.col("head.source_rank"))))
    ends = ends.withColumns({"goes_on": F.coalesce(goes_on, F.lit(False)), "breaks": F.coalesce(breaks, F.lit(False)).cast("int")})
    began = F.when(~F.col("goes_on") | (F.col("last._rank") > 1), F.col("skip") + F.col("last._rank"))  # of the last value's run
    ends = ends.withColumn("_began", began)
    ends = ends.withColumns({"began": F.last("_began", ignorenulls=True).over(past), "ties": F.coalesce(F.sum(F.col("news") + F.col("breaks")).over(past), F.lit(0)) + F.col("breaks")})
    carried = ends.select("_range", *by, "skip", "goes_on", "began", "ties")
    joined = own.alias("d").join(carried.alias("b"), (F.col("d._range") == F.col("b._range")) & _same(by))
    display = F.when(F.col("b.goes_on") & (F.col("d._rank") == 1), F.col("b.began")).otherwise(F.col("b.skip") + F.col("d._rank"))
    ties = 1 + F.col("b.ties") + F.sum("d._new").over(Window.partitionBy("d._range", *[f"d.{c}" for c in by]).orderBy("d._n").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in df.columns], (F.col("b.skip") + F.col("d._n")).cast("int").alias("stable_index"), display.cast("int").alias("display_rank"), ties.cast("int").alias("tie_group"))


def _same(by: list[str]):
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out
