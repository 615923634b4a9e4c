"""Streams with state: one batch, many batches and a restart give the same, which is what a row-by-row version gives."""

import datetime as dt
import os
import random


from boardlake.operators import observations, ops
from boardlake.streaming import jobs, retry, stateful

START = dt.datetime(2024, 1, 1)
REQUEST = "id bigint, ws bigint, scope string, key string, payload_hash string, at timestamp, took_ms bigint, ok boolean"


def files(spark, rows, schema, folder, cuts, first=0):
    """``rows`` as Parquet files, one for each batch, older ones first."""
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        path = f"{folder}/b={first + n}"
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(path)
        for root, _, names in os.walk(path):
            for x in names:
                os.utime(f"{root}/{x}", (1_700_000_000 + 10 * (first + n),) * 2)


def read(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def requests(n=400):
    rng = random.Random(2)
    at, rows = START, []
    for i in range(n):
        at += dt.timedelta(minutes=rng.choice([1, 5, 30, 120]))
        rows.append((i, rng.randint(0, 1), "s", rng.choice(["a", "b", "c", None]), rng.choice(["x", "x", "x", "y"]), at, rng.choice([0, 60_000, 3_600_000]), rng.random() < 0.8))
    return rows


def answered(rows, ttl_ms=stateful.TTL_MS):
    held, out = {}, {}
    for i, ws, scope, key, payload, at, took, ok in rows:
        ms = int((at - START).total_seconds() * 1000)
        if key is None:
            out[i] = ("processed", i)
            continue
        h = held.get((ws, scope, key))
        if h is None or ms >= h["expires"] or (not h["ok"] and ms >= h["done"]):
            held[ws, scope, key] = {"payload": payload, "id": i, "done": ms + took, "expires": ms + ttl_ms, "ok": ok}
            out[i] = ("processed", i)
        elif h["payload"] != payload:
            out[i] = ("PAYLOAD_MISMATCH", None)
        elif h["ok"] and ms >= h["done"]:
            out[i] = ("replayed", h["id"])
        else:
            out[i] = ("IN_PROGRESS", None)
    return out


def test_idempotent_requests(spark, tmp_path):
    rows = requests()
    want = answered(rows)
    assert {o for o, _ in want.values()} == {"processed", "replayed", "PAYLOAD_MISMATCH", "IN_PROGRESS"}
    for name, cuts in (("one", []), ("many", [50, 60, 200, 201])):
        d = f"{tmp_path}/{name}"
        files(spark, rows, REQUEST, f"{d}/in", cuts)
        got = jobs.run_to_table(stateful.idempotent(read(spark, REQUEST, f"{d}/in")), f"{d}/out", f"{d}/c", "append").collect()
        assert {r.id: (r.outcome, r.answer_of) for r in got} == want and len(got) == len(want)


def test_idempotent_requests_after_a_restart(spark, tmp_path):
    rows, d = requests(), str(tmp_path)
    for part, (a, b) in enumerate([(0, 150), (150, 400)]):
        files(spark, rows[a:b], REQUEST, f"{d}/in", [40], first=2 * part)
        got = jobs.run_to_table(stateful.idempotent(read(spark, REQUEST, f"{d}/in")), f"{d}/out", f"{d}/c", "append").collect()
    assert {r.id: (r.outcome, r.answer_of) for r in got} == answered(rows)


def test_arrivals(spark, tmp_path):
    rng = random.Random(3)
    schema = "period string, player bigint, metric string, id bigint, observed_at timestamp, value bigint, ref string, arrival bigint"
    rows = [("p", rng.randint(0, 3), "m", i, START + dt.timedelta(days=rng.randint(0, 4)), rng.randint(0, 3), rng.choice(["a", "b", None]), i) for i in range(300)]
    want = {r.id: r.decision for r in observations.decisions(spark.createDataFrame(rows, schema)).collect()}
    assert set(want.values()) == {"created", "updated", "equal-precedence", "existing-is-newer"}
    for name, cuts in (("one", []), ("many", [1, 7, 130])):
        d = f"{tmp_path}/{name}"
        files(spark, rows, schema, f"{d}/in", cuts)
        got = jobs.run_to_table(stateful.decided(read(spark, schema, f"{d}/in")), f"{d}/out", f"{d}/c", "append").collect()
        assert {r.id: r.decision for r in got} == want and len(got) == len(want)


def test_arrivals_at_once(spark, tmp_path):
    """Rows that arrive at once go by id, however they lie in files."""
    schema = "period string, player bigint, metric string, id bigint, observed_at timestamp, value bigint, ref string, arrival bigint"
    rows = [("p", i % 2, "m", i, START + dt.timedelta(days=i * 7 % 5), i * 3 % 4, None, 0) for i in range(40)]
    got = []
    for n, own in enumerate((rows, rows[::-1])):
        got.append({r.id: r.decision for r in observations.decisions(spark.createDataFrame(own, schema).coalesce(1)).collect()})
        files(spark, own, schema, f"{tmp_path}/in{n}", [])
        out = jobs.run_to_table(stateful.decided(read(spark, schema, f"{tmp_path}/in{n}")), f"{tmp_path}/out{n}", f"{tmp_path}/c{n}", "append")
        got.append({r.id: r.decision for r in out.collect()})
    assert all(x == got[0] for x in got) and got[0][0] == got[0][1] == "created"


def test_arrivals_of_many_keys(spark, tmp_path):
    """A slot holds what stands for many keys, over batches and a restart; parts of keys, times and values may be null."""
    rng = random.Random(6)
    schema = "period string, player bigint, metric string, id bigint, observed_at timestamp, value bigint, ref string, arrival bigint"
    one = lambda i: (rng.choice(["p", "", None]), rng.choice([1, 2**60, 2**60 + 1, None]), rng.choice(["m", None]), i, rng.choice([START, START + dt.timedelta(microseconds=1), None]), rng.choice([-5, 2**60, 2**60 + 1, None]), rng.choice(["a", "\uff5e", "\U0001f600", "", None]), i)
    rows = [one(i) for i in range(600)]
    want = {r.id: r.decision for r in observations.decisions(spark.createDataFrame(rows, schema)).collect()}
    assert set(want.values()) == {"created", "updated", "equal-precedence", "existing-is-newer"}
    for part, (a, b) in enumerate([(0, 200), (200, 600)]):
        files(spark, rows[a:b], schema, f"{tmp_path}/in", [150], first=2 * part)
        out = stateful.decided(read(spark, schema, f"{tmp_path}/in"), slots=3)
        got = jobs.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/c", "append").collect()
    assert {r.id: r.decision for r in got} == want and len(got) == len(want)
    q = stateful.decided(read(spark, schema, f"{tmp_path}/in"), slots=2).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # one for each key before


def test_task_changes(spark, tmp_path):
    """A slot holds many tasks, of which each has a state of its own; ids may be null."""
    rng = random.Random(5)
    schema = "job bigint, task bigint, status string, low_confidence boolean, updated_at timestamp, id bigint"
    rows = [(rng.choice([1, 2, 2**60 + 1, None]), rng.choice([7, 8, 2**60 + 1, None]), rng.choice(["QUEUED", "PROCESSING", "COMPLETED", "FAILED"]), rng.random() < 0.5, START + dt.timedelta(hours=i // 40, minutes=rng.randint(0, 9)), i) for i in range(400)]
    want = {}
    cuts = [40, 80, 200]  # hours, so that batches are in order of time
    for job, task, status, low, _, _ in sorted(rows, key=lambda r: r[4:]):
        now = want.get((job, task))
        allowed = now is None or status == now[0] or (now[0], status) in ops.CHANGES
        want[job, task] = (status, low, now[2] + 1 if now else 1) if allowed else (*now[:2], now[2] + 1)
    for name, at in (("one", []), ("many", cuts)):
        d = f"{tmp_path}/{name}"
        files(spark, rows, schema, f"{d}/in", at)
        got = {}
        for r in jobs.run_to_table(jobs.moved(read(spark, schema, f"{d}/in")), f"{d}/out", f"{d}/c", "update").collect():
            if r.seen > got.get((r.job, r.task), ("", False, 0))[2]:
                got[r.job, r.task] = (r.status, r.low_confidence, r.seen)
        assert got == want
    q = jobs.moved(read(spark, schema, f"{tmp_path}/one/in"), 2).writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # one for each task before


def drained(batches, players, events, current, limit):
    """Pass by pass over a list of rows."""
    queue, snapshots, seen = {}, {}, {}
    for batch in batches:
        for r in batch:
            queue[r["id"]] = {**r, "status": "PENDING", "attempts": 0, "available_at": r["created_at"], "error": None}
        now = max(q["created_at"] for q in queue.values())
        ready = [q for q in queue.values() if q["status"] in ("PENDING", "FAILED") and q["available_at"] <= now and q["attempts"] < 3]
        for q in sorted(ready, key=lambda q: (q["available_at"], q["created_at"], q["id"]))[:limit]:
            q["attempts"] += 1
            event = q["linked_event"] or q["job_event"] or current
            player = q["player"] if q["player"] in players else None if q["player"] is not None else next((p for p, g in players.items() if g == q["game_id"]), None)
            error = "invalid" if q["power"] <= 0 else "event" if event not in events else "player" if player is None else None
            q["error"] = error
            if error:
                q |= {"status": "FAILED", "available_at": now + dt.timedelta(seconds=min(3600, 2 ** q["attempts"]))}
                continue
            q["status"] = "COMPLETED"
            snapshots[event, player] = max(snapshots.get((event, player), (dt.datetime.min, -1)), (now, q["id"], q["power"], q["kp"]))
            for m, v in (("power", q["power"]), ("kill_points", q["kp"])):
                own = (q["observed_at"], v, q["ref"] or f"backlog:{q['id']}:{m}")
                seen[event, player, m] = max(seen.get((event, player, m), own), own)
    return queue, snapshots, seen


def test_retry_queue(spark, tmp_path):
    """Each pass is repeated, as after a lost driver; players become known between passes."""
    rng = random.Random(4)
    names = [c.split()[0] for c in retry.QUEUE.split(", ")]
    players = {1: "g1", 2: "g2", 3: "g3"}
    batches = []
    for n in range(4):
        batch = []
        for i in range(n * 10, n * 10 + (10 if n < 3 else 1)):
            p = rng.randint(1, 5)
            at = START + dt.timedelta(seconds=n * 3 + i % 3)
            batch.append(dict(zip(names, (i, at, *((p, None) if rng.random() < 0.6 else (None, f"g{p}")), rng.choice(["e1", None, "gone"]), rng.choice(["e2", None]), rng.randint(-1, 9), rng.randint(0, 9), 1, 2, 3, START + dt.timedelta(days=rng.randint(0, 2)), rng.choice([None, "own"])), strict=True)))
        batches.append(batch)
    known = spark.createDataFrame(list(players.items()), "player bigint, game_id string")
    events = spark.createDataFrame([("e1",), ("e2",), ("now",)], "event string")
    for limit in (None, 6):
        path = f"{tmp_path}/q{limit}"
        for n, batch in enumerate(batches):
            df = spark.createDataFrame([tuple(r[c] for c in names) for r in batch], retry.QUEUE)
            for _ in range(2):
                retry.drain_batch(df, n, path, known, events, "now", limit)
        queue, snapshots, seen = drained(batches, players, {"e1", "e2", "now"}, "now", limit)
        got = {r.id: (r.status, r.attempts, r.available_at) for r in retry.read_queue(spark, path).collect()}
        assert got == {i: (q["status"], q["attempts"], q["available_at"]) for i, q in queue.items()}
        s, o = retry.read_effects(spark, path)
        assert {(r.event, r.player): (r.power, r.kp) for r in s.collect()} == {k: v[2:] for k, v in snapshots.items()}
        assert {(r.event, r.player, r.metric): (r.observed_at, r.value, r.ref) for r in o.collect()} == seen
        done = sum(q["status"] == "COMPLETED" for q in queue.values())
        assert spark.read.parquet(f"{path}/observations").count() == 2 * done  # none twice, although each pass ran twice
    assert max(q["attempts"] for q in queue.values()) > 1


def test_ids_of_a_batch_are_not_joined(spark, tmp_path, monkeypatch):
    """What came with a batch is known by a mark; the queue meets the tables of players and events only, once each."""
    names = [c.split()[0] for c in retry.QUEUE.split(", ")]
    row = lambda i, p, g: dict.fromkeys(names) | {"id": i, "created_at": START, "player": p, "game_id": g, "power": 5, "kp": i}
    batch = spark.createDataFrame([tuple(row(*r)[c] for c in names) for r in [(1, 1, None), (2, None, "g1"), (3, None, None), (4, 9, "g1"), (5, None, "g7")]], retry.QUEUE)
    known, events = spark.createDataFrame([(1, "g1"), (2, None)], "player bigint, game_id string"), spark.createDataFrame([("now",)], "event string")
    joined, join = [], type(batch).join
    monkeypatch.setattr(type(batch), "join", lambda self, other, *a: joined.append(other.columns) or join(self, other, *a))
    retry.drain_batch(batch, 0, f"{tmp_path}/q", known, events, "now")
    assert joined == [["_key", "_found"], ["_event", "_held"]]
    assert {r.id: (r.status, r.player) for r in retry.read_queue(spark, f"{tmp_path}/q").collect()} == {1: ("COMPLETED", 1), 2: ("COMPLETED", 1), 3: ("FAILED", None), 4: ("FAILED", 9), 5: ("FAILED", None)}
