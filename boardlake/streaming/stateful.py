"""Structured Streaming with state of our own for each key: idempotent requests with a time to live, and decisions on arrivals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boardlake.operators import observations

TTL_MS = 24 * 3600 * 1000


def idempotent(requests: DataFrame, ttl_ms: int = TTL_MS, late: str = "1 hour") -> DataFrame:
    """ST2: each request's outcome (id, outcome, answer_of), in append mode.

    ``requests``: id, ws, scope, key, payload_hash, at (timestamp), took_ms (until it is answered, or fails), ok. A key is reserved by
    the first request, for ``ttl_ms``. Until then the same key gives IN_PROGRESS while that request runs, ``replayed`` (with
    its answer) once it is answered, and PAYLOAD_MISMATCH for another payload. A failure frees the key at once, an expiry later;
    the next request reclaims it. A request without a key is always ``processed``, and so are those that reserve or reclaim.

    Requests of a key take effect in order of (at, id) within a batch, and batch after batch. State is one row a live key: a timer
    removes it when the watermark passes its expiry, which changes no outcome, as an expired key is as good as none. Requests
    are taken to end before their key expires.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        out = []
        for r in pd.concat(list(frames)).sort_values(["at_ms", "id"]).itertuples():
            live = now is not None and r.at_ms < now[3]
            if not live:
                outcome, answer = "processed", r.id
                done = r.at_ms + r.took_ms
                now = (r.payload_hash, r.id, done, r.at_ms + ttl_ms if r.ok else done, bool(r.ok))
            elif now[0] != r.payload_hash:
                outcome, answer = "PAYLOAD_MISMATCH", None
            elif now[4] and r.at_ms >= now[2]:
                outcome, answer = "replayed", now[1]
            else:
                outcome, answer = "IN_PROGRESS", None
            out.append((r.id, outcome, answer))
        state.update(now)
        state.setTimeoutTimestamp(max(int(now[3]), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [o[0] for o in out], "outcome": [o[1] for o in out], "answer_of": pd.array([o[2] for o in out], "Int64")})

    cols = requests.withWatermark("at", late).select("id", "ws", "scope", "key", "payload_hash", "at", F.unix_millis("at").alias("at_ms"), "took_ms", "ok")
    keyed = cols.filter("key is not null").groupBy("ws", "scope", "key")
    done = keyed.applyInPandasWithState(step, "id bigint, outcome string, answer_of bigint", "payload_hash string, id bigint, done_ms bigint, expires_ms bigint, ok boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return done.unionByName(cols.filter("key is null").select("id", F.lit("processed").alias("outcome"), F.col("id").alias("answer_of")))


def decided(obs: DataFrame, keys: list[str] = observations.KEYS, arrival: str = "arrival", slots: int = 1024) -> DataFrame:  # noqa: B006
    """ST7: (id, decision) of every arrival, as ``observations.decisions`` has them, in append mode. State is the precedence of what
    stands for each key: time, value, reference. Within a batch rows arrive in order of ``arrival`` and id, and batches one after the other.
    Keys are dealt to ``slots`` states by hash, since a state for each key costs a call of Python for every few arrivals; a slot is
    rewritten when one of its keys gets a row, so ``slots`` is to grow with the keys (thousands a slot)."""
    of = [f"_key{n}" for n in range(len(keys))]
    order = ["at_us", "value", "ref"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["_arrival", "id"], na_position="first")
        held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else rows.iloc[:0]
        both = pd.concat([held[of + order], rows[of + order]], ignore_index=True) if len(held) else rows[of + order]
        owner = both.groupby(of, dropna=False, sort=False).ngroup().to_numpy()
        place = both.groupby(order, sort=True).ngroup().to_numpy()  # of a precedence among all of the slot
        by = np.argsort(owner, kind="stable")  # what stands, then arrivals in order, key after key
        own = owner[by] * len(by) + place[by]
        best = np.maximum.accumulate(own)  # starts anew with each key, as owners ascend
        first = np.diff(owner[by], prepend=-1) > 0
        before = np.roll(best, 1)
        decision = np.select([first, before < own, before == own], ["created", "updated", "equal-precedence"], "existing-is-newer")
        last = np.roll(first, -1)
        at = np.empty(len(by), dtype="int64")
        at[place] = np.arange(len(by))  # a row of each precedence
        stands = pd.concat([both[of].iloc[by[last]].reset_index(drop=True), both[order].iloc[at[best[last] % len(by)]].reset_index(drop=True)], axis=1)
        table = pa.Table.from_pandas(stands, preserve_index=False)
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
        new = by >= len(held)
        yield pd.DataFrame({"id": rows["id"].to_numpy()[by[new] - len(held)], "decision": decision[new]})

    # keys are texts in Python, as numbers beside nulls would be floats; nulls come first in an order
    parts = [F.col(c).cast("string").alias(k) for c, k in zip(keys, of, strict=True)]
    least = lambda c: F.coalesce(c, F.lit(-(2**63)))
    rows = obs.select(F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("_slot"), *parts, "id", least(F.unix_micros("observed_at")).alias("at_us"), least(F.col("value")).alias("value"), F.coalesce("ref", F.lit("")).alias("ref"), F.col(arrival).alias("_arrival"))
    return rows.groupBy("_slot").applyInPandasWithState(step, "id bigint, decision string", "stands binary", "append", GroupStateTimeout.NoTimeout)
