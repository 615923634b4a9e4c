"""A keyed table in hash buckets; an upsert writes the buckets that it touches and no others.

``data/version=v/bucket=b`` holds a bucket as version v wrote it, ``manifest/n=i`` tells which version of each bucket counts after i
upserts. A new manifest is the last thing that is written, and counts once Spark has marked it as a success, so readers see all
of an upsert or nothing of it, and one that broke off leaves files that no manifest names. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boardlake.sources.scratch import written
from boardlake.sources.sinks import upserted

BUCKETS = 64


def _newest(spark: SparkSession, path: str) -> int:
    """The number of the last manifest that was written to its end; -1 before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{path}/manifest")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [int(n[2:]) for n in names if n.startswith("n=") and fs.exists(hadoop.Path(f"{path}/manifest/{n}/_SUCCESS"))]
    return max(done, default=-1)


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, str]:
    """Which version of each bucket counts; there are as many rows as buckets."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/manifest/n={n}").collect()} if n >= 0 else {}


def _rows(spark: SparkSession, path: str, versions: dict[int, str], schema: StructType | str) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())])


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table as the last upsert left it (``schema``: of its columns); empty before the first."""
    return _rows(spark, path, _versions(spark, path, _newest(spark, path)), schema)


def upsert(incoming: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> list[int]:
    """Insert or replace by key, as ``upserted`` does; returns the buckets that were written. All rows of a key, whose parts may be null,
    are in one bucket; ``buckets`` must stay as it was."""
    spark, schema = incoming.sparkSession, incoming.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fresh = written(incoming, "incoming")
    touched = sorted(r.b for r in fresh.select(bucket.alias("b")).distinct().collect())
    if not touched:
        return []
    n = _newest(spark, path)
    versions = _versions(spark, path, n)
    old = _rows(spark, path, {b: v for b, v in versions.items() if b in set(touched)}, schema)
    version = uuid.uuid4().hex
    folded = upserted(old, fresh, keys, order).select(*incoming.columns)
    folded.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/version={version}")
    now = versions | dict.fromkeys(touched, version)
    spark.createDataFrame(sorted(now.items()), "bucket int, version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/n={n + 1}")
    return touched
