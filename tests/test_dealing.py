"""Rows of large tables go to more tasks than the session has shuffle partitions, with the same results; nothing is computed twice."""

import os

import pytest

from boardlake.functions import dealing
from boardlake.plans import all_queries, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_captured_runs_are_dealt_once(spark, monkeypatch):
    want = sorted(all_queries()["f4_run_guard"](spark, SF).collect())
    monkeypatch.setattr(dealing, "ROWS", 500)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    got = all_queries()["f4_run_guard"](spark, SF)
    assert got.rdd.getNumPartitions() == -(-n // 500) > 4
    assert sorted(got.collect()) == want
    assert registry.captured(spark, SF).count() == n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_an_instalment_reads_what_the_first_one_stored(spark):
    """Nothing of the first instalment is reconciled again for the second."""
    from boardlake.plans import boards

    state = boards.reconciled(spark, SF)[1][1]
    folders = {f.rsplit("/", 2)[-2].split("-")[0]: 0 for f in state.inputFiles()}
    for f in {f.rsplit("/", 2)[-2] for f in state.inputFiles()}:
        folders[f.split("-")[0]] += 1
    assert folders["snapshots"] == folders["observed"] == folders["merged"] == folders["routed"] == 1
