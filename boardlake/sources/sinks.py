"""Writers: CSV exports, keyed upserts, change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """S3: ordered CSV with a header; quotes where needed, doubled within."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def upserted(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert-or-replace by key: of a key's rows the last by ``order``, incoming over existing on ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def change_log(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, action, previous, next) of rows that were created, updated or deleted; rows as JSON, nulls kept."""
    rest = [c for c in before.columns if c not in keys]
    as_json = lambda df, name: df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias(name))
    both = as_json(before, "previous").join(as_json(after, "next"), keys, "full_outer")
    action = F.when(F.col("previous").isNull(), "created").when(F.col("next").isNull(), "deleted").when(F.col("previous") != F.col("next"), "updated")
    return both.withColumn("action", action).filter("action is not null")


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
