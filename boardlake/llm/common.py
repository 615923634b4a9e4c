"""What the operators of this subpackage share: scratch tables, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised helpers look at in one go; it bounds their memory.
SLICE_BYTES = 1 << 20
#: Rows whose texts are looked at together, at most.
_ROWS = 512
#: Words that are hashed in one go; it bounds what a very long text takes.
_WORDS = 1 << 16


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); a local one of our own where none is named and all
    runs on one machine. On a cluster it has to be named, as executors don't see one another's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        path = _own_dir[0]
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; names that clash only by case are told apart by exact spelling."""
    exact = {c: i for i, c in enumerate(df.columns)}
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*names)
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{exact[n]}").alias(n) for n in names])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_bucket(mod: int):
    """crc32 of ``doc_id`` as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod


def labelled_texts(docs: DataFrame, sample: DataFrame, most: int, most_chars: int) -> DataFrame:
    """(doc_id, y, text): the distinct rows of ``docs`` whose id is in ``sample`` (doc_id, y; so few that they are broadcast), in
    order of a hash at most ``most`` rows, and only as many as have ``most_chars`` characters in all. Texts are whole.

    What reaches the driver is a hash and a length of at most ``most`` rows.
    """
    base = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = base.join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("doc_id", "text")).dropDuplicates(["h"])
    rows = materialize(own.select("doc_id", "y", "text", "h"), "fit-rows")
    last, chars = None, 0
    for r in rows.select("h", F.length("text").alias("n")).orderBy("h").limit(most).collect():
        chars += r.n
        if chars > most_chars and last is not None:
            break
        last = r.h
    return rows.filter(F.col("h") <= (last if last is not None else 0)).select("doc_id", "y", "text")


# --- text columns of Arrow batches -------------------------------------------------------------


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows with about ``most`` bytes of text: (rows, bytes, offsets). Null texts are empty."""
    for first in range(0, batch.num_rows, _ROWS):  # texts are copied a few rows at a time
        part = batch.slice(first, _ROWS)
        texts = pc.fill_null(part.column(column), "").cast(pa.large_string())
        n = len(texts)
        bufs = texts.buffers()
        offs = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield part.slice(at, to - at), data[offs[at] : offs[to]], (offs[at : to + 1] - offs[at])
            at = to


def _lut(keep) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if keep(c):
            t[b] = c
    return t


#: Lower-cases A-Z; 0 marks separators. ALNUM keeps digits, letters and all non-ASCII bytes; SPACED all but ASCII white space.
ALNUM = _lut(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
SPACED = _lut(lambda c: c > 0 and c != 32 and not 9 <= c <= 13)

_rng = np.random.Generator(np.random.PCG64(20240607))
_POW = _rng.integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of a run of texts: hash, first byte and end of each, the first word of each text, hashes of first bytes."""

    __slots__ = ("hash", "start", "end", "doc", "lower", "stems")

    def __init__(self, data: np.ndarray, offs: np.ndarray, lut: np.ndarray = ALNUM, stems: tuple[int, ...] = ()):
        self.lower = lc = lut[data]
        isw = lc != 0
        n = len(lc)
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        first = isw.copy()
        first[1:] &= ~isw[:-1]
        first[inner] = isw[inner]
        self.start = starts = np.flatnonzero(first)
        last = isw.copy()
        last[:-1] &= ~isw[1:]
        last[inner - 1] = isw[inner - 1]
        self.end = ends = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(starts, offs)
        self.hash = np.zeros(0, np.uint64)
        self.stems = [self.hash for _ in stems]
        if not len(starts):
            return
        parts = [_hashed(lc, starts[a : a + _WORDS], ends[a : a + _WORDS], stems) for a in range(0, len(starts), _WORDS)]
        self.hash, *self.stems = (np.concatenate(p) for p in zip(*parts, strict=True))


def _hashed(lc: np.ndarray, starts: np.ndarray, ends: np.ndarray, stems: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the words lc[start:end], and of their first ``stems`` bytes."""
    lens = ends - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    terms = _POW[pos & 511] * (lc[pos + np.repeat(starts, lens)].astype(np.uint64) + (pos >> 9).astype(np.uint64) * np.uint64(257))
    whole = mix(np.add.reduceat(terms, at) + lens.astype(np.uint64))
    return [whole, *[mix(np.add.reduceat(np.where(pos < n, terms, np.uint64(0)), at)) for n in stems]]
