"""Operator 5: best-fit packing of tokenised documents by exact-complement hashing.

Documents become token pieces of at most ``capacity``. What the plan needs of them is the number of pieces of each length
(at most ``capacity`` counts), so it is made on the driver from that histogram: sums of one, two and three available
lengths are indexed, and for each length in descending order combinations that exactly fill its gap are consumed, as
often as the counts allow; what remains is packed by best fit. The plan is a bounded list of patterns with multiplicities.
Pieces of one length are interchangeable: each takes the place of its rank among them. Ranks come from counts within the
tasks that wrote the pieces and prefix sums over tasks, so no length, however common, is gathered anywhere.

Defined cases: null text is empty, and an empty document is the end-of-document id alone; rows with a null ``doc_id``
and repeated rows are packed as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.llm.common import materialize, only, table
from boardlake.llm.tokens import public_path, token_ids

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Texts that are tokenised in one go.
_TEXTS = 256
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """A row per piece; ``task`` and ``nth``: the task that made it and its place among that task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids(tokenizer)
        task, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        rows: list[tuple] = []
        size = 0

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

        for b in batches:
            for first in range(0, b.num_rows, _TEXTS):
                some = b.slice(first, _TEXTS)
                every, offs = encode.many(some.column(1).to_pylist(), end_id)
                raw, offs = every.astype("<u4").tobytes(), offs.tolist()
                for doc_id, a, z in zip(some.column(0).to_pylist(), offs[:-1], offs[1:], strict=True):
                    for k, at in enumerate(range(a, z, capacity)):
                        n = min(capacity, z - at)
                        part = raw[4 * at : 4 * (at + n)]
                        rows.append((doc_id, k, at - a, n, zlib.crc32(part), task, made[n], *([part] if keep_ids else [])))
                        made[n] += 1
                        size += len(part) if keep_ids else 64
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


class _Lengths:
    """How many pieces of each length are left, and how many pairs of available lengths have each sum."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = counts.astype(np.int64).copy()
        self.capacity = capacity
        self.pairs = np.zeros(2 * capacity + 1, np.int64)
        have = np.flatnonzero(self.left)
        for a in have.tolist():
            self.pairs[a + have[have <= a]] += 1
            self.pairs[2 * a] -= self.left[a] < 2

    def take(self, length: int, n: int) -> None:
        was = int(self.left[length])
        now = was - n
        if was >= 2 > now:
            self.pairs[2 * length] -= 1
        if was >= 1 > now:
            others = np.flatnonzero(self.left)
            self.pairs[length + others[others != length]] -= 1
        self.left[length] = now

    def times(self, combo: tuple[int, ...]) -> int:
        """How often ``combo`` can be taken."""
        return min(int(self.left[x]) // combo.count(x) for x in set(combo))

    def pair(self, total: int, first: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The two available lengths of sum ``total`` with the largest greater one, such that ``first`` can be taken too."""
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange(min(total - 1, self.capacity), (total + 1) // 2 - 1, -1)
        for x in a[(self.left[a] > 0) & (self.left[total - a] > 0)].tolist():
            if self.times((*first, x, total - x)):
                return x, total - x
        return None

    def fill(self, length: int) -> tuple[int, ...] | None:
        """Available lengths, one to three, that exactly fill the gap beside ``length``."""
        gap = self.capacity - length
        if gap < 1:
            return ()
        if self.left[gap] and self.times((length, gap)):
            return (gap,)
        if two := self.pair(gap, (length,)):
            return two
        a = np.arange(gap - 2, 0, -1)
        for x in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
            if (two := self.pair(gap - x, (length, x))) is not None:
                return (x, *two)
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence, number of such sequences) that use up ``counts`` (index: length)."""
    lengths, out = _Lengths(counts, capacity), []
    rest: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        while n := int(lengths.left[length]):
            combo = lengths.fill(length)
            if combo is None:
                rest.append((length, n))
                lengths.take(length, n)
                continue
            pattern = (length, *combo)
            times = lengths.times(pattern)
            for x in set(pattern):
                lengths.take(x, times * pattern.count(x))
            out.append((pattern, times))
    # best fit of what has no exact complement, in descending order, many equal bins at once
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            bins.setdefault(gap, []).append((pattern, n))
            gaps[gap] = True

    for length, n in rest:
        while n:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                each = capacity // length
                put(capacity - each * length, (length,) * each, n // each)
                put(capacity - n % each * length, (length,) * (n % each), 1 if n % each else 0)
                break
            gap = int(fits[0]) + length
            pattern, have = bins[gap].pop()
            used = min(n, have)
            if have > used:
                bins[gap].append((pattern, have - used))
            gaps[gap] = bool(bins[gap])
            put(gap - length, (*pattern, length), used)
            n -= used
    return out + [x for b in bins.values() for x in b]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """By length and rank: where ranks from ``rank`` on of ``length`` go: key (length << 44 | rank), first sequence, offset."""
    used: dict[int, int] = {}
    key, seq, off, at = [], [], [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            used[length] = rank + n
            key.append((length << 44) | rank)
            seq.append(at)
            off.append(offset)
            offset += length
        at += n
    order = np.argsort(np.array(key, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (key, seq, off))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if they are to be kept)."""
    spark = docs.sparkSession
    made = materialize(pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    by_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    shared = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    ranked = made.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("task", "nth", "before")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, off = shared.value
        for b in batches:
            want = (np.asarray(b.column("length")) << 44) | np.asarray(b.column("rank"))
            at = np.searchsorted(key, want, "right") - 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq[at] + (want - key[at])), pa.array(off[at])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "") + ", sequence_id bigint, offset bigint")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_path(TOKENIZER))
