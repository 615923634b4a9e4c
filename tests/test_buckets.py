"""Upserts in place."""

import os
import random
import shutil

from boardlake.sources import buckets, sinks

SCHEMA = "k bigint, part string, v bigint, at bigint"


def files(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(f"{path}/data") for n in names if n.startswith("part-")}


def test_upserts_write_the_touched_buckets_only(spark, tmp_path):
    r, path = random.Random(3), str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    want = frame([])
    assert buckets.read(spark, path, SCHEMA).count() == 0
    first = [(k, "a", k, 0) for k in range(200)] + [(None, None, 7, 0)]
    batches = [first, [(k, "a", -k, r.choice([-1, 1])) for k in (3, 4, 5)] + [(None, None, 8, 1), (3, "b", 1, 0)], [(500, "a", 1, 1)], []]
    for batch in batches:
        before = files(path)
        touched = buckets.upsert(frame(batch), path, ["k", "part"], ["at", "v"], 16)
        after = files(path)
        assert all(after[f] == before[f] for f in before)  # nothing that was there is written again
        new = {int(f.split("bucket=")[1].split("/")[0]) for f in after if f not in before}
        assert new == set(touched) and (len(touched) < 16 or batch is first)
        want = sinks.upserted(want, frame(batch), ["k", "part"], ["at", "v"]).select("k", "part", "v", "at")
        assert sorted(map(str, buckets.read(spark, path, SCHEMA).collect())) == sorted(map(str, want.collect()))


def test_an_upsert_that_broke_off_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (1, 2):
        buckets.upsert(spark.createDataFrame([(1, "a", v, v)], SCHEMA), path, ["k", "part"], ["at"], 4)
    os.remove(f"{path}/manifest/n=1/_SUCCESS")
    assert [x.v for x in buckets.read(spark, path, SCHEMA).collect()] == [1]
    buckets.upsert(spark.createDataFrame([(1, "a", 3, 3)], SCHEMA), path, ["k", "part"], ["at"], 4)
    assert [x.v for x in buckets.read(spark, path, SCHEMA).collect()] == [3]
    shutil.rmtree(path)
