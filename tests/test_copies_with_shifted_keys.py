"""Queries on tables whose ids are not those of the small ones, against their SQL, and the rounding and ties that come with them."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from boardlake.operators import activity, guards
from boardlake.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"


def differences(spark, name, folder, **tables):
    """Rows of the query on ``tables`` that its SQL does not give, and the other way round."""
    db = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    for t in ("nation", "customer", "events", "lineitem"):
        if t not in tables:
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
        path = f"{folder}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = all_queries()[name](spark, str(folder))
    want = db.sql(all_oracles()[name])
    got = {tuple(r) for r in df.select(*want.columns).collect()}
    return got ^ set(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_review_of_players_with_shifted_ids(spark, tmp_path):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    more = c.unionByName(c.withColumn("c_custkey", F.col("c_custkey") + 100000).withColumn("c_name", F.concat(F.lit("x"), "c_name")))
    assert not differences(spark, "j10_review_queue", tmp_path, customer=more)


def test_quality_is_not_rounded(spark):
    rows = spark.createDataFrame([(1, 80.00686, 80.00686, 80.00686, 80.00686, True, False)], "run bigint, rank_conf double, name_conf double, metric_conf double, title_conf double, grouping_ok boolean, failed boolean")
    got = guards.run_quality(rows, rows.select("run", F.lit(None).cast("array<string>").alias("guard_failures"))).first()
    assert got.confidence == 80.0069 and abs(got["mean"] - 80.00686) < 1e-9


def test_share_of_best_at_a_tie(spark):
    df = spark.createDataFrame([("a", 1, 1.12), ("b", 1, 0.063)], "period string, player bigint, score double")
    assert {r.period: r.of_best for r in activity.history(df, 3).collect()} == {"a": 1.0, "b": 0.0563}  # .05625
