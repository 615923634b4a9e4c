"""Operator 8: SimHash fingerprints and near-duplicate components by covering locality-sensitive hashing.

Fingerprints are linked when they differ in at most ``radius`` bits. The candidate search is exact: ``2^(radius+1) - 1``
bit masks are made from a linear map of bit positions to vectors of ``radius + 1`` bits, as in covering LSH (Pagh, 2016).
Whatever ``radius`` positions two fingerprints differ in, some mask leaves all of them out, so each such pair meets in
some table. A table's buckets are compared in numpy, and each bucket gives a spanning set of links rather than all pairs.
Buckets above ``block`` fingerprints are dealt as pairs of blocks over many tasks, so no bucket is held by one task; those
above ``DEEP`` blocks are first cut by a second family of masks, which again covers every pair within the radius.

Defined cases: null text has no words (fingerprint zero, linked like any other); rows with a null ``doc_id`` keep their
fingerprint and take their component's smallest id, null if it has none; repeated rows come back repeated; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boardlake.llm.common import discard, materialize, only, scratch, table

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints of one bucket that one task compares with one another.
BLOCK = 4096
#: Buckets of more than this many blocks are cut by more masks before all their pairs are compared.
DEEP = 32
#: Hot buckets are broadcast up to this many rows (24 bytes each); above, they are joined by a shuffle.
MOST_BROADCAST = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    h64, join = xxhash.xxh64_intdigest, b" ".join
    h = [h64(join(words[i : i + k]), seed) for i in range(len(words) - k + 1)]
    n = len(h)
    # in pieces, so that a very long text needs little memory
    count = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        part = np.array(h[i : i + 8192], dtype="<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def _printed(keyed: DataFrame, shingle: int, seed: int) -> DataFrame:
    """The columns of ``keyed`` with ``fp bigint`` in place of the last one, the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], [*b.schema.names[:-1], "fp"])

    return keyed.mapInArrow(run, T.StructType([*keyed.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp bigint) of every row."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _printed(docs, shingle, seed)


def masks(radius: int = RADIUS, bits: int = 64, family: int = 0) -> list[int]:
    """One mask for each nonzero v in GF(2)^(radius+1): bit i is kept if <phi(i), v> = 1.

    The phi(i) of differing bits span at most ``radius`` dimensions, so some v is orthogonal to all of them.
    phi runs through the nonzero vectors in turn, so every mask keeps about half of the bits; each ``family`` in another order.
    """
    size = 1 << (radius + 1)
    phi = [1 + (i * (7 + 4 * family) + i // (size - 1) + 5 * family) % (size - 1) for i in range(bits)]
    out = []
    for v in range(1, size):
        m = sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, other) that span the components of the distinct fingerprints of one bucket."""
    left = np.unique(fps)
    a, b = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 256):
                near |= (np.bitwise_count(front[i : i + 256, None] ^ left[None, :]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            a.append(np.full(len(front), root))
            b.append(front)
    none = np.zeros(0, fps.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _bucket_links(radius: int):
    """Over batches sorted by bucket (columns t, key, i, j, fp): the links within each run of rows of the same bucket."""

    def runs(batches):
        kept = None
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in range(5)]
            cols[4] = cols[4].view(np.uint64)  # bits of a signed number are counted without its sign
            if kept is not None:
                cols = [np.concatenate([p, q]) for p, q in zip(kept, cols, strict=True)]
            t, key, i, j, fp = cols
            if not len(fp):
                continue
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            kept = [c[last:] for c in cols]
            if last:
                yield fp[:last], np.concatenate([[0], new])
        if kept is not None and len(kept[4]):
            yield kept[4], np.array([0, len(kept[4])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, edge in runs(batches):
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            a, b = [fp[two][near]], [fp[two + 1][near]]
            for k in np.flatnonzero(size > 2):
                x, y = _links(fp[edge[k] : edge[k + 1]], radius)
                a.append(x)
                b.append(y)
            a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _among(keyed: DataFrame, buckets: DataFrame, how: str) -> DataFrame:
    """Rows of ``keyed`` in (left_semi) or out of (left_anti) the few ``buckets`` (t, key)."""
    side = buckets.select("t", "key")
    return keyed.join(F.broadcast(side) if buckets.count() <= MOST_BROADCAST else side, ["t", "key"], how)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, deep: int = DEEP) -> DataFrame:
    """(a, b): links that span all components of the distinct values of ``fps.fp`` under ``radius`` differing bits."""
    first, second = masks(radius), masks(radius, family=1)
    longs = lambda ms: F.array(*[F.lit(m).cast("long") for m in ms])
    keyed = fps.select("fp", F.posexplode(longs(first)).alias("t", "m")).select("t", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    hot = materialize(keyed.groupBy("t", "key").count().filter(F.col("count") > block), "hot-buckets")
    very = hot.filter(F.col("count") > deep * block)
    if very.count():
        # both keys agree exactly where the fingerprints do on the bits of either mask
        both = F.get(longs(first), F.col("t")).bitwiseOR(F.col("m"))
        inner = _among(keyed, very, "left_semi").select("t", "fp", F.posexplode(longs(second)).alias("u", "m"))
        inner = inner.select(((F.col("t") + 1) * len(first) + F.col("u")).alias("t"), F.col("fp").bitwiseAND(both).alias("key"), "fp")
        keyed = _among(keyed, very, "left_anti").unionByName(inner)
        hot = materialize(keyed.groupBy("t", "key").count().filter(F.col("count") > block), "hot-buckets")
    n_hot = hot.count()
    cut = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if n_hot:
        side = hot.select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("n"))
        dealt = keyed.join(F.broadcast(side) if n_hot <= MOST_BROADCAST else side, ["t", "key"], "left")
        own = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n"), F.lit(1)) - 1))
        cut = dealt.withColumn("own", own).withColumn("o", others).select("t", "key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "fp")
    sorted_ = cut.select("t", "key", "i", "j", "fp").repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return sorted_.mapInArrow(_bucket_links(radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each linked node's component, by alternating large and small stars.

    Each round is joins and grouped minima only, with partial sums on the map side, and is written to the shared
    folder, and the round before is removed. The number of rounds grows with the logarithm of the longest path.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "star")
        df.write.parquet(path)
        return spark.read.schema("a bigint, b bigint").parquet(path), path

    edges, path = written(edges.select("a", "b").filter("a <> b"))
    before = None
    for _ in range(most_rounds):
        for large in (True, False):
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            moved = both.join(low, "a")
            new = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
            old = path
            edges, path = written(new.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
            discard(spark, old)  # all of it went into the new table
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    prints = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    comp = components(links(reps.select("fp"), radius, block))
    joined = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = joined.join(comp.select(F.col("node").alias("fp")), "fp", "left_semi")
    ids = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = joined.join(ids, "root", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, of rows that repeat it that of the smallest text
    hash, then of the smallest row number. Null ids come last, so a row without one stays only where the component has no other.

    Components are told apart by their smallest fingerprint, so an id that stands in several keeps a row in each. Row
    numbers are written with the rows, so that the choice survives retries.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))]).withColumn("_row", F.monotonically_increasing_id())
    rows = materialize(numbered, "rows")
    own, text = F.col(f"_c{names.index('doc_id')}").cast("long"), F.col(f"_c{names.index('text')}").cast("string")
    prints = _printed(rows.select("_row", own.alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")), shingle, seed)
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash", "_row")
    reps = materialize(prints.groupBy("fp").agg(F.min(row).alias("kept")), "distinct-fingerprints")
    comp = components(links(reps.select("fp"), radius, block)).withColumnRenamed("node", "fp")
    rooted = reps.join(comp, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
    kept = rooted.agg(F.min("kept").alias("kept")).select("kept._row")
    return rows.join(kept, "_row", "left_semi").select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
