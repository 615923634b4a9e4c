"""Readers: tables with a given schema, scoped to a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, workspace: str | None = None, scope: str = "workspace_id", fmt: str = "parquet", **options: str) -> DataFrame:
    """A table of any format Spark reads (parquet, orc, csv, json, jdbc); the filter on ``scope`` reaches the scan."""
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.filter(F.col(scope) == workspace) if workspace is not None else df


def read_jdbc(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of ``key``."""
    return spark.read.jdbc(url, name, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
